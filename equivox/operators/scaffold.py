"""Skeletons of test cases for ambiguous rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equivox.functions.text import slug, toml_string
from equivox.operators.rank import sort_key

READINGS = "array<struct<parser:string,kind:string,locus:string,resolution:string,signature:string>>"
SIGNALS = "array<struct<name:string,points:double,reasons:array<string>>>"
TRAILER = "(written automatically; a person has to confirm it)"


def picked(rows: DataFrame, limit: int = 50, all_verdicts: bool = False, order: tuple = ("uid",)) -> DataFrame:
    rows = rows.where(F.col("verdict").isNotNull() & (F.lit(all_verdicts) | (F.col("verdict") == "nocuous")))
    return rows.orderBy(*sort_key(order)).limit(limit)


def with_ids(rows: DataFrame, project: str) -> DataFrame:
    """case_id and file name; later rows of one name get underscores."""
    s = slug(F.col("text"))
    where = F.when(F.col("section") == "", F.lit("none")).otherwise(F.col("section"))
    rows = rows.withColumn("case_id", F.concat(F.lit(f"{project}/"), where, F.lit("-"), s))
    base = F.concat(F.lit(f"{project}_"), F.regexp_replace(where, "[^A-Za-z0-9]+", "_"), F.lit("_"), s)
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*sort_key()))
    rows = rows.withColumn("_base", base).withColumn("_n", n)
    return rows.withColumn("file", F.concat("_base", F.repeat(F.lit("_"), F.col("_n") - 1), F.lit(".toml"))).drop("_base", "_n")


def with_ambiguity(rows: DataFrame) -> DataFrame:
    """ambiguity: the first two loci whose readings differ, the first reason of each signal, a trailer;
    evidence: all differing loci, as comment lines."""
    readings = F.from_json(F.coalesce(F.nullif(F.col("divergent_readings"), F.lit("")), F.lit("[]")), READINGS)
    signals = F.from_json(F.coalesce(F.nullif(F.col("triage_signals"), F.lit("")), F.lit("[]")), SIGNALS)
    loci = F.array_distinct(F.transform(readings, lambda r: F.struct(r["kind"].alias("kind"), r["locus"].alias("locus"))))

    def described(l):
        own = F.array_distinct(F.transform(F.filter(readings, lambda r: (r["kind"] == l["kind"]) & (r["locus"] == l["locus"])), lambda r: r["resolution"]))
        return F.struct(l["kind"].alias("kind"), l["locus"].alias("locus"), own.alias("resolutions"))

    rows = rows.withColumn("_loci", F.filter(F.transform(loci, described), lambda d: F.size(d["resolutions"]) > 1)).withColumn("_signals", signals)
    places = F.transform(F.slice("_loci", 1, 2), lambda d: F.concat(d["kind"], F.lit(" at "), d["locus"], F.lit(": "), F.array_join(d["resolutions"], " / ")))
    reasons = F.transform("_signals", lambda s: F.element_at(s["reasons"], 1))
    lines = F.transform("_loci", lambda d: F.format_string("#       %-11s %s: %s", d["kind"], d["locus"], F.array_join(d["resolutions"], " / ")))
    return rows.withColumns({"ambiguity": F.array_join(F.concat(places, reasons, F.array(F.lit(TRAILER))), " || "), "evidence": F.array_join(lines, "\n")}).drop("_loci", "_signals")


def rendered(rows: DataFrame, project: str) -> DataFrame:
    """(file, case_id, toml)."""
    rows = with_ambiguity(with_ids(rows, project))
    t = lambda c: toml_string(F.coalesce(F.col(c).cast("string"), F.lit("")))
    lines = [
        F.concat(F.lit("# unit "), "uid"), F.lit("# readings that differ:"), F.when(F.col("evidence") != "", F.col("evidence")), F.lit("[case]"), F.concat(F.lit("id = "), t("case_id")),
        F.concat(F.lit("title = "), t("section_title")), F.concat(F.lit("spec = ["), t("anchor"), F.lit("]")), F.concat(F.lit("text = "), t("text")), F.concat(F.lit("ambiguity = "), t("ambiguity")),
        F.concat(F.lit("verdict = "), t("verdict")), F.lit(""), F.lit("[build]"), F.lit("# how to build an input that the readings treat differently"), F.lit(""), F.lit("[control]"), F.lit("# an input that all readings treat alike"), F.lit(""),
    ]
    return rows.select("file", "case_id", F.concat_ws("\n", *lines).alias("toml"))


def write(files: DataFrame, folder: str) -> int:
    """One file a row (a bounded number of rows), in a folder of the driver."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for row in files.toLocalIterator():
        Path(folder, row["file"]).write_text(row["toml"], encoding="utf-8")
        n += 1
    return n
