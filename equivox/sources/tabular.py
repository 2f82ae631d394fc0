"""Tables and line files: units, decisions, results, pipe-delimited exports, layout items; and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equivox.operators.rank import overlaps
from equivox.operators.segment import fill_forward, units
from equivox.schema import UNIT


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return parse_units(spark.read.text(path))


def parse_units(raw: DataFrame) -> DataFrame:
    """Lines (value) of JSON -> units; malformed lines fail, and so do lines with keys that units lack."""
    known = [part.split()[0] for part in UNIT.split(",")]
    keys = F.json_object_keys("value")
    odd = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0
    short = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in known]))) < len(known)
    checked = F.when(keys.isNull() | odd | short, F.raise_error(F.concat(F.lit("not a unit: "), "value"))).otherwise(F.col("value"))
    return raw.where("trim(value) != ''").select(F.from_json(checked, UNIT, {"mode": "FAILFAST"}).alias("u")).select("u.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Ranked rows as CSV, all strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_rrf(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited rows as c0, c1, ...; quotes are plain characters."""
    raw = spark.read.csv(path, sep="|", quote="", inferSchema=False)
    return raw.toDF(*[f"c{k}" for k in range(len(raw.columns))])


def layout(items: DataFrame, label: str, least: int = 25, from_page: int = 0) -> DataFrame:
    """items(doc, page, pos, label, text) of a page-layout model -> units: section headers set the clause or
    the title, prose is kept, dot leaders go; subref is the page."""
    clause = F.nullif(F.regexp_extract("text", r"^([A-Z]?\d+(?:\.\d+)*)\s+", 1), F.lit(""))
    header = F.col("label") == "section_header"
    order = ["page", "pos"]
    b = fill_forward(items, F.when(header, clause), ["doc"], order, "section")
    b = fill_forward(b, F.when(header, F.regexp_replace("text", r"^[A-Z]?\d+(?:\.\d+)*\s+", "")), ["doc"], order, "section_title", F.lit(""))
    b = b.where(F.col("label").isin("text", "list_item") & ~F.col("text").rlike(r"(\.\s*){4,}") & (F.col("page") >= from_page) & F.col("section").isNotNull())
    b = b.select(F.col("doc").alias("source_id"), (F.col("page") * 100_000 + F.col("pos")).cast("int").alias("pos"), "section", "section_title", F.concat(F.lit("p"), "page").alias("subref"), "text", F.lit(False).alias("is_list"))
    return units(b, F.lit(label), F.lit(label), least)


def write_results(rows: DataFrame, path: str) -> None:
    """CSV and JSON of the rows in their order, and the overlap beside them; an old overlap is replaced."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}.csv")
    rows.write.mode("overwrite").json(f"{path}.json")
    overlaps(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}_overlap.csv")


def write_units(rows: DataFrame, path: str) -> None:
    rows.select(*[part.split()[0] for part in UNIT.split(",")]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
