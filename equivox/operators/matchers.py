"""Matching units with known findings.

Each rule yields candidate matches with a class and the finding's place in its list; the least
(class, place) of a unit is its match.  Section prefixes match through the unit's own ancestors, so
that is an equi join, not a scan of all pairs; findings are a list of config size and are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING_ROWS = 20_000  # findings lists up to this length are broadcast


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FINDING_ROWS else df


def ancestors(section: Column) -> Column:
    """6.2.1 -> [6, 6.2, 6.2.1]."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def depth(section: Column) -> Column:
    return F.size(F.split(section, r"\."))


def first(units: DataFrame, rules: list[DataFrame], keys: list[str]) -> DataFrame:
    """units with match_tag and precise of the least (class, place); null and false without a match."""
    every = reduce(DataFrame.unionByName, [r.select(*keys, "cls", "ord", "tag", "precise") for r in rules])
    best = every.groupBy(*keys).agg(F.min(F.struct("cls", "ord", "tag", "precise")).alias("m"))
    best = best.select(*keys, F.col("m.tag").alias("match_tag"), F.col("m.precise").alias("precise"))
    return units.join(best, keys, "left").fillna({"precise": False})


def none(units: DataFrame) -> DataFrame:
    return units.withColumns({"match_tag": F.lit(None).cast("string"), "precise": F.lit(False)})


def of_kind(findings: DataFrame, kind: str, name: str) -> DataFrame:
    return small(findings.where(F.col("kind") == kind).select(F.col("value").alias(name), "ord"))


def dicom(units: DataFrame, findings: DataFrame, compat: bool = False, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """findings(kind: prefix | keyword | vr, value, ord).  By default the part must agree and an exact match
    goes before a broad one; with compat the part is ignored and the list's order decides."""
    keys = list(keys)
    p = of_kind(findings, "prefix", "prefix").withColumns({"label": F.split("prefix", " ")[0], "rest": F.regexp_replace("prefix", r"^\S+\s+", "")})
    p = p.withColumn("is_table", F.col("rest").startswith("Table "))
    same_part = F.lit(True) if compat else F.col("spec") == F.col("label")
    place = lambda c: (F.lit(0) if compat else F.lit(c)).alias("cls")
    tag = F.concat(F.lit("anchor:"), "prefix").alias("tag")
    yes = F.lit(True).alias("precise")
    tables = units.join(p.where("is_table"), F.col("anchor") == F.col("prefix")).select(*keys, place(0), "ord", tag, yes)
    plain = p.where("not is_table")
    exact = units.join(plain, F.col("section") == F.col("rest")).where(same_part).select(*keys, place(0), "ord", tag, yes)
    up = units.where("subref is null").select(*keys, "spec", "section", F.explode(ancestors(F.col("section"))).alias("up")).where("up != section")
    below = up.join(plain, F.col("up") == F.col("rest")).where(same_part)
    precise = depth(F.col("rest")) >= 3
    below = below.select(*keys, (F.lit(0) if compat else F.when(precise, 1).otherwise(2)).alias("cls"), "ord", tag, precise.alias("precise"))
    words = of_kind(findings, "keyword", "word")
    keyword = units.join(words, F.contains(F.lower("text"), F.lower("word"))).select(*keys, F.lit(3).alias("cls"), "ord", F.concat(F.lit("kw:"), "word").alias("tag"), yes)
    vrs = of_kind(findings, "vr", "vr")
    near = F.concat(F.lit(r"(?:Value Representation|\bVR\b).{0,40}\b"), "vr", F.lit(r"\b|\b"), "vr", F.lit(r"\b.{0,15}(?:Value Representation|\()"))
    vr = units.join(vrs, F.rlike("text", near)).select(*keys, F.lit(4).alias("cls"), "ord", F.concat(F.lit("vr:"), "vr").alias("tag"), yes)
    return first(units, [tables, exact, below, keyword, vr], keys)


def fhir(units: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """findings(kind: section | concept | invariant, value, ord)."""
    keys = list(keys)
    s = of_kind(findings, "section", "number")
    yes, no = F.lit(True).alias("precise"), F.lit(False).alias("precise")
    exact = units.join(s, F.col("section") == F.col("number")).select(*keys, F.lit(0).alias("cls"), "ord", F.concat(F.lit("sect:"), "number").alias("tag"), yes)
    up = units.select(*keys, "section", F.explode(ancestors(F.col("section"))).alias("up")).where("up != section")
    below = up.join(s, F.col("up") == F.col("number")).select(*keys, F.lit(1).alias("cls"), "ord", F.concat(F.lit("sect>:"), "number").alias("tag"), (depth(F.col("number")) >= 4).alias("precise"))
    over = small(s.select("number", "ord", F.explode(ancestors(F.col("number"))).alias("over")).where("over != number"))
    above = units.join(over, F.col("section") == F.col("over")).select(*keys, F.lit(2).alias("cls"), "ord", F.concat(F.lit("sect<:"), "number").alias("tag"), no)
    c = of_kind(findings, "concept", "concept")
    low = F.lower("concept")
    title = units.join(c, F.contains(F.lower("section_title"), low)).select(*keys, F.lit(3).alias("cls"), "ord", F.concat(F.lit("concept:"), low).alias("tag"), yes)
    i = of_kind(findings, "invariant", "inv")
    inv = units.join(i, F.rlike("text", F.concat(F.lit(r"\b\Q"), "inv", F.lit(r"\E\b")))).select(*keys, F.lit(4).alias("cls"), "ord", F.concat(F.lit("inv:"), "inv").alias("tag"), yes)
    body = units.join(c.where(F.length("concept") > 4), F.contains(F.lower("text"), low)).select(*keys, F.lit(5).alias("cls"), "ord", F.concat(F.lit("concept~:"), low).alias("tag"), no)
    return first(units, [exact, below, above, title, inv, body], keys)
