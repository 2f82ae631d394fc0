"""Building lexicons and findings lists."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equivox.functions.text import lexicon_key
from equivox.operators.segment import dedup_first

# fixed values
VRS = "AE AS AT CS DA DS DT FL FD IS LO LT OB OD OF OL OV OW PN SH SL SQ SS ST SV TM UC UI UL UN UR US UT UV".split()
DICOM_KEYWORDS = ("IVLE", "Implicit VR", "Explicit VR", "disjunctive", "struct", "Group Length", "Defined Term")


def dedup(terms: DataFrame, order: list) -> DataFrame:
    """The first term of each (norm, concept_id); empty norms go."""
    return dedup_first(terms.where("norm is not null and norm != ''"), ["norm", "concept_id"], order)


def kinds(terms: DataFrame) -> DataFrame:
    return terms.groupBy("kind").agg(F.count("*").alias("n"))


def umls_strings(conso: DataFrame) -> DataFrame:
    """MRCONSO fields c0.. -> (norm, cui): English, not suppressed."""
    rows = conso.where("c1 = 'ENG' and c16 != 'O'").select(F.lower(F.trim("c14")).alias("norm"), F.col("c0").alias("cui"))
    return rows.where("norm != ''").distinct()


def umls_types(sty: DataFrame) -> DataFrame:
    return sty.select(F.col("c0").alias("cui"), F.col("c1").alias("tui")).distinct()


def elements(table: DataFrame, compat: bool = False) -> DataFrame:
    """DICOM elements(tag, keyword, name, vr, ord) and uids alike -> terms: keyword and name share an id."""
    of = lambda c: table.select(lexicon_key(F.col(c), compat).alias("norm"), F.col(c).alias("term"), F.concat(F.lit("DICOM-DE:"), "tag").alias("concept_id"), F.lit("attribute").alias("kind"), F.lit("dictionary").alias("source"), F.lit("").alias("definition"), "ord")
    return of("keyword").unionByName(of("name"))


def structure_terms(resources: DataFrame, compat: bool = False) -> DataFrame:
    """resources(name, url, description, kind) of structure definitions -> terms."""
    return resources.select(lexicon_key(F.col("name"), compat).alias("norm"), F.col("name").alias("term"), F.concat(F.lit("FHIR:"), "name").alias("concept_id"), F.lit("structure").alias("kind"), F.col("url").alias("source"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("definition"))


def flatten_codes(systems: DataFrame) -> DataFrame:
    """systems(url, json: a code system's concepts, nested) -> terms, one for each concept at any depth."""
    import json

    def walk(concepts: list) -> Iterator[tuple[str, str, str]]:
        stack = list(reversed(concepts))
        while stack:
            c = stack.pop()
            yield c.get("code", ""), c.get("display") or c.get("code", ""), (c.get("definition") or "")[:300]
            stack += reversed(c.get("concept", []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *c) for u, j in zip(batch["url"], batch["json"], strict=True) for c in walk(json.loads(j or "[]"))]
            yield pd.DataFrame(rows, columns=["url", "code", "display", "definition"])

    flat = systems.select("url", "json").mapInPandas(run, "url string, code string, display string, definition string")
    return flat.select(lexicon_key(F.col("display")).alias("norm"), F.col("display").alias("term"), F.concat("url", F.lit("#"), "code").alias("concept_id"), F.lit("code").alias("kind"), F.col("url").alias("source"), "definition")


def cases(files: DataFrame) -> DataFrame:
    """files(path, toml) -> (path, ok, id, title, cites, strings): cites is the case's spec list, strings all those
    of build and control; files that can't be read are kept with ok = false."""

    def strings(x) -> Iterator[str]:
        if isinstance(x, str):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from strings(y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["toml"], strict=True):
                try:
                    d = tomllib.loads(text)
                    c = d.get("case", {})
                    cites = c.get("spec", [])
                    out.append((path, True, c.get("id", ""), c.get("title", ""), [cites] if isinstance(cites, str) else list(cites), [*strings(d.get("build", {})), *strings(d.get("control", {}))]))
                except (tomllib.TOMLDecodeError, TypeError):
                    out.append((path, False, None, None, [], []))
            yield pd.DataFrame(out, columns=["path", "ok", "id", "title", "cites", "strings"])

    return files.select("path", "toml").mapInPandas(run, "path string, ok boolean, id string, title string, cites array<string>, strings array<string>")


def dicom_prefix(cite: Column) -> Column:
    """'PS3.5 §T6.2-1' -> 'PS3.5 Table 6.2-1'; other parts, and cites of a note alone, give null."""
    c = F.trim(cite)
    part, place = F.regexp_extract(c, r"^(PS3\.[57])\s", 1), F.regexp_replace(c, r"^\S+\s+§*\s*(?:Annex\s+)?", "")
    place = F.trim(F.regexp_replace(place, r"^T(?=\d)", "Table "))
    return F.when((part != "") & ~F.lower(place).startswith("note"), F.concat_ws(" ", part, place))


def each_of(read: DataFrame, kind: str, values: Column) -> DataFrame:
    return read.where("ok").select(F.lit(kind).alias("kind"), F.explode(values).alias("value"))


def dicom_findings(read: DataFrame) -> DataFrame:
    """cases -> findings(kind, value): section prefixes cited; data element tags that the builds and controls name
    (upper case) and fixed words, as keywords; value representations in ids and titles, whatever their case."""
    prefixes = each_of(read, "prefix", F.transform("cites", dicom_prefix))
    tags = each_of(read, "keyword", F.transform(F.filter("strings", lambda x: x.rlike("^[0-9A-Fa-f]{4},[0-9A-Fa-f]{4}$")), F.upper))
    vr = each_of(read, "vr", F.regexp_extract_all(F.upper(F.concat_ws(" ", "id", "title")), F.lit(r"\b[A-Z]{2}\b"), F.lit(0))).where(F.col("value").isin(*VRS))
    words = read.sparkSession.createDataFrame([("keyword", k) for k in DICOM_KEYWORDS], "kind string, value string")
    return prefixes.unionByName(tags).unionByName(vr).unionByName(words).where("value is not null").distinct()


SECTION, INVARIANT = r"\d+(?:\.\d+)+", r"\b[a-z]{2,5}-\d+\b"  # fixed values


def fhir_findings(read: DataFrame) -> DataFrame:
    """cases -> findings(kind, value): section numbers and invariants cited, and what is left of a cite as a concept if it has 3
    to 40 characters, a letter, and no bracket, slash or 'regex'."""
    cites = lambda pattern: F.flatten(F.transform("cites", lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))
    name = F.trim(F.col("c"))
    for pattern in (r"(?i)^(?:HL7\s+)?(?:FHIR|CDA)\s+(?:R\d\s+)?", r"(?i)\bsection\b|§", SECTION, r"\([^)]*\)", r"\s+"):
        name = F.regexp_replace(name, pattern, "" if pattern.startswith("(?i)^") else " ")
    name = F.regexp_replace(name, r"^[ .-]+|[ .-]+$", "")
    concept = read.where("ok").select(F.explode("cites").alias("c")).select(F.lit("concept").alias("kind"), name.alias("value"))
    concept = concept.where(F.length("value").between(3, 40) & ~F.col("value").rlike(r"(?i)\[|regex|/") & F.col("value").rlike("[A-Za-z]"))
    return each_of(read, "section", cites(SECTION)).unionByName(each_of(read, "invariant", cites(INVARIANT))).unionByName(concept).distinct()


def findings_lists(findings: DataFrame, read: DataFrame) -> DataFrame:
    """(kind, n_cases, n, list): a row for each kind with its values in order and their number, and the number of
    case files; write it with ``write.json``."""
    counted = read.agg(F.count("*").alias("n_cases"))
    lists = findings.groupBy("kind").agg(F.array_sort(F.collect_set("value")).alias("list"))
    return lists.crossJoin(F.broadcast(counted)).select("kind", "n_cases", F.size("list").alias("n"), "list")
