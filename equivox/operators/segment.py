"""Paragraphs to sentence units: split, floor, dedup, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_CHARS = 25
END = r"(?<=[.!?])\s+"
SQL_END = r"(?<=[.!?])[ \t\n\f\r]+"  # white space as SQL has it


def sentences(text: Column, end: str = END) -> Column:
    """array<struct<n, text, start, end>>: sentences end at . ! or ? before white space; offsets are the
    paragraph's."""
    parts = F.split(text, end)
    # the white space between sentences is one character in cleaned text
    started = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, p: F.struct((acc["at"] + F.length(p) + 1).cast("int").alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
    return F.zip_with(parts, started["starts"], lambda p, s: F.struct(p.alias("text"), s.alias("start"), (s + F.length(p)).cast("int").alias("end")))


def explode_sentences(paragraphs: DataFrame, text: str = "text", end: str = END) -> DataFrame:
    """A row for each sentence, with sent_no, char_start, char_end; text is the sentence's."""
    others = [c for c in paragraphs.columns if c != text]
    rows = paragraphs.select(*others, F.posexplode(sentences(F.col(text), end)).alias("sent_no", "s"))
    return rows.select(*others, "sent_no", F.col("s.text").alias(text), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"))


def floor(df: DataFrame, least: int = MIN_CHARS, text: str = "text") -> DataFrame:
    return df.where(F.length(text) >= least)


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def number(df: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fill_forward(df: DataFrame, value: Column, keys: list[str], order: list, name: str, default: Column | None = None) -> DataFrame:
    """The last value seen up to each row, else default."""
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.coalesce(seen, default) if default is not None else seen)


def units(blocks: DataFrame, spec: Column, uid_prefix: Column, least: int = MIN_CHARS, anchor: Column | None = None, by_subref: bool = False) -> DataFrame:
    """blocks(source_id, pos, section, section_title, subref, text, is_list) -> units with source_id.

    Paragraphs and sentences under `least` characters go (list items are exempt); a sentence that its
    section has already had goes; the rest is numbered within its section, with by_subref within the section and
    subref, which the uid then names.  The key is (source_id, uid), as uids of different sources may collide."""
    kept = blocks.where("section is not null and section != ''").where((F.length("text") >= least) | F.col("is_list"))
    rows = explode_sentences(kept).where((F.length("text") >= least) | (F.col("is_list") & (F.length("text") > 0)))
    rows = dedup_first(rows, ["source_id", "section", "text"], ["pos", "sent_no"])
    rows = number(rows, ["source_id", "section", *["subref"] * by_subref], ["pos", "sent_no"])
    within = F.coalesce(F.concat("subref", F.lit(".")), F.lit("")) if by_subref else F.lit("")
    uid = F.concat_ws(":", uid_prefix, F.col("section"), F.concat(within, F.col("n").cast("string")))
    place = anchor if anchor is not None else F.concat_ws(" ", spec, F.col("section"))
    return rows.select("source_id", uid.alias("uid"), spec.alias("spec"), "section", "section_title", "subref", place.alias("anchor"), "text", "char_start", "char_end", "pos", "sent_no")
