"""Targets named in a TOML file: which source, which matcher, which lexicons."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from equivox.sources import html, markdown, tabular

LEXICONS = ("wordnet", "umls", "spec", "fuzzy")


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    label: str
    path: str
    matcher: str = "none"
    findings: str | None = None
    lexicons: tuple[str, ...] = ("spec",)
    options: dict = field(default_factory=dict)

    def units(self, spark: SparkSession) -> DataFrame:
        return SOURCES[self.kind](spark, self)


SOURCES = {
    "dicom": lambda s, t: html.docbook(html.read_pages(s, t.path), t.label),
    "fhir": lambda s, t: html.fhir_site(html.read_pages(s, t.path), t.label),
    "epub": lambda s, t: html.epub(html.read_books(s, t.path), t.label),
    "pdf": lambda s, t: tabular.layout(s.read.parquet(t.path), t.label, from_page=t.options.get("from_page", 0)),
    "markdown": lambda s, t: markdown.markdown(markdown.read(s, t.path), t.label),
    "jsonl": lambda s, t: tabular.read_units(s, t.path),
}


def lexicon_names(names: str | list[str]) -> tuple[str, ...]:
    found = tuple(n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names) if n.strip())
    if unknown := set(found) - set(LEXICONS):
        raise ValueError(f"unknown lexicons: {', '.join(sorted(unknown))}")
    return found


def load(path: str) -> dict[str, Target]:
    with open(Path(path).expanduser(), "rb") as f:
        tables = tomllib.load(f).get("target", {})
    out = {}
    for name, t in tables.items():
        if t.get("kind") not in SOURCES:
            raise ValueError(f"{name}: unknown kind {t.get('kind')!r}")
        findings = t.get("findings")
        matcher = t.get("matcher", t["kind"] if t["kind"] in ("dicom", "fhir") else "none")
        if findings is None or not Path(findings).expanduser().exists():
            matcher = "none"
        out[name] = Target(name, t["kind"], t.get("label", name), str(Path(t["path"]).expanduser()), matcher, findings, lexicon_names(t.get("lexicons", "spec")), t.get("options", {}))
    return out
