"""Markdown source: a line state machine in window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equivox.functions.text import heading_slug, markdown_inline
from equivox.operators.segment import units


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path (or matching a pattern) as (path, content)."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, pos, line, kind): fence, code, table, heading, blank, item, quote, text."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    so_far = F.sum(fence.cast("int")).over(Window.partitionBy("path").orderBy("pos"))
    kind = (
        F.when(fence, "fence").when(so_far % 2 == 1, "code").when(F.col("line").rlike(r"^\s*\||^\s*([-*_])(\s*\1){2,}\s*$"), "table")
        .when(F.col("line").rlike(r"^#{1,6}\s+\S"), "heading").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "item")
        .when(F.col("line").rlike(r"^\s*>"), "quote").otherwise("text")
    )
    return rows.withColumn("kind", kind)


def paragraphs(files: DataFrame) -> DataFrame:
    """(path, pos, section, section_title, text, is_list): section is the slugs of the open headings."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = lines(files)
    depth = F.length(F.regexp_extract("line", r"^(#{1,6})", 1))
    title = markdown_inline(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s+#+\s*$", ""))
    heading = F.when(F.col("kind") == "heading", F.struct(depth.alias("depth"), heading_slug(title).alias("slug"), title.alias("title")))
    # headings open at each heading are folded once per heading, not per line
    heads = rows.withColumn("h", heading).where("h is not null")
    seen = F.collect_list("h").over(w)
    stack = F.aggregate(seen, F.array().cast("array<string>"), lambda acc, h: F.concat(F.slice(acc, 1, F.least(F.size(acc), h["depth"] - 1)), F.array(h["slug"])))
    heads = heads.select("path", F.col("pos").alias("h_pos"), F.array_join(stack, "/").alias("section"), F.col("h.title").alias("section_title"))
    rows = rows.withColumn("h_pos", F.last(F.when(F.col("kind") == "heading", F.col("pos")), ignorenulls=True).over(w))
    breaks = F.col("kind").isin("fence", "table", "heading", "blank", "item")
    rows = rows.withColumn("par", F.sum(breaks.cast("int")).over(w)).where(F.col("kind").isin("item", "quote", "text"))
    body = F.when(F.col("kind") == "item", F.regexp_replace("line", r"^\s*([-*+]|\d+[.)])\s+", "")).when(F.col("kind") == "quote", F.regexp_replace("line", r"^\s*>\s?", "")).otherwise(F.trim("line"))
    parts = rows.groupBy("path", "par", "h_pos").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", body.alias("body")))).alias("b"), F.max((F.col("kind") == "item").cast("int")).alias("li"))
    parts = parts.select("path", "pos", "h_pos", markdown_inline(F.array_join(F.transform("b", lambda x: x["body"]), " ")).alias("text"), (F.col("li") == 1).alias("is_list"))
    out = parts.join(heads, ["path", "h_pos"], "left")
    return out.select("path", "pos", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("section_title", F.lit("")).alias("section_title"), "text", "is_list").where("text != ''")


def markdown(files: DataFrame, label: str, least: int = 25) -> DataFrame:
    """files(path, content) -> units; subref is the file's name."""
    b = paragraphs(files).withColumn("section", F.when(F.col("section") == "", "0").otherwise(F.col("section")))
    b = b.select(F.col("path").alias("source_id"), "pos", "section", "section_title", F.regexp_extract("path", r"([^/]*)$", 1).alias("subref"), "text", "is_list")
    stem = F.regexp_replace(F.regexp_extract("source_id", r"([^/]*)$", 1), r"\.md$", "")
    anchor = F.concat(F.lit(f"{label} "), "subref", F.lit("#"), F.regexp_extract("section", r"([^/]*)$", 1))
    return units(b, F.lit(label), F.concat_ws(":", F.regexp_replace(F.lit(label), " ", "-"), stem), least, anchor)
