"""Output rows, their ranking, and the overlap with findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equivox.operators.oracle import RANK

COLUMNS = ("uid", "spec", "section", "subref", "anchor", "section_title", "triage_score", "triage_signals", "disagreement_score", "verdict", "n_loci", "n_nocuous_loci", "semantic_distance", "divergent_readings", "overlap", "overlap_precise", "text")


def output_rows(units: DataFrame, triage: DataFrame, oracle: DataFrame | None, matched: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """All units with triage (uid, score, signals), oracle results where there are any, and the match."""
    keys = list(keys)
    rows = units.join(triage.select(*keys, "score", "signals"), keys, "left").join(matched.select(*keys, "match_tag", F.col("precise").alias("is_precise")), keys, "left")
    if oracle is None:
        empty = {"disagreement_score": "double", "verdict": "string", "n_loci": "bigint", "n_nocuous_loci": "bigint", "semantic_distance": "double"}
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | {"divergent_readings": F.lit(None).cast("string")})
    else:
        facts = oracle.select(*keys, F.round("disagreement_score", 3).alias("disagreement_score"), "verdict", "n_loci", "n_nocuous_loci", F.round("semantic_distance", 3).alias("semantic_distance"), F.to_json("readings").alias("divergent_readings"))
        rows = rows.join(facts, keys, "left")
    overlap = F.coalesce(F.col("match_tag"), F.lit(""))
    return rows.withColumns({
        "subref": F.coalesce("subref", F.lit("")), "triage_score": F.round("score", 3), "triage_signals": F.to_json("signals"), "overlap": overlap,
        "overlap_precise": F.when(overlap == "", "").when(F.col("is_precise"), "yes").otherwise("broad"),
    }).select(*[c for c in keys if c not in COLUMNS], *COLUMNS)


def sort_key(order: tuple = ("uid",)) -> list:
    """Precise overlap, scored by the oracle, verdict, nocuous loci, disagreement; triage score among
    rows that were not scored; then the given order."""
    scored = F.col("verdict").isNotNull()
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("verdict")]
    keys = [(F.col("overlap_precise") == "yes").cast("int"), scored.cast("int"), F.coalesce(rank, F.lit(-1)), F.coalesce("n_nocuous_loci", F.lit(0)), F.coalesce("disagreement_score", F.lit(0.0)), F.when(scored, 0.0).otherwise(F.col("triage_score"))]
    return [k.desc() for k in keys] + [F.col(c) for c in order]


def ranked(rows: DataFrame, order: tuple = ("uid",)) -> DataFrame:
    return rows.orderBy(*sort_key(order))


def top_ranked(rows: DataFrame, n: int, order: tuple = ("uid",)) -> DataFrame:
    """The first n rows with their rank; only n rows meet in one task."""
    first = rows.orderBy(*sort_key(order)).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*sort_key(order))))


def overlaps(rows: DataFrame) -> DataFrame:
    return rows.where("overlap != ''")


def view(rows: DataFrame, spec: str | None = None, contains: str | None = None, limit: int = 50, order: tuple = ("uid",)) -> DataFrame:
    """Rows of a spec whose text contains a string (in any case), as lines to read; limit 0: all."""
    if spec:
        rows = rows.where(F.col("spec") == spec)
    if contains:
        rows = rows.where(F.contains(F.lower("text"), F.lit(contains.lower())))
    rows = rows.orderBy(*order)
    rows = rows.limit(limit) if limit else rows
    scored = F.format_string("[%s] %s  verdict=%s score=%.3f loci=%d", "anchor", "uid", "verdict", "disagreement_score", "n_loci")
    plain = F.format_string("[%s] %s  triage=%.3f", "anchor", "uid", "triage_score")
    return rows.withColumn("header", F.when(F.col("verdict").isNotNull(), scored).otherwise(plain))
