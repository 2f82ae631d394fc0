"""Benchmark decontamination: MinHash containment search, partitioned by size, verified exactly.

An item is contained in a document when at least ``threshold`` of its distinct word shingles occur
there.  A sketch of both sides would drown a short item in a long document, so only the smaller side,
the item, is sketched, and the whole document is tested for the sketch's shingles.

Both sides are partitioned by size.  The class of an item is its number n of shingles, rounded up to a power of
two.  A contained item misses at most floor((1 - threshold) * n) shingles, so of the shingles with the smallest
hashes, one more than that, at least one is in the document: all items of a class get a sketch of as many minima as
the class's largest possible item needs, and no contained item is lost.  A document is searched only for the classes
that it is long enough for: with fewer shingles than the threshold's share of the class's smallest item it can hold
none of them.  Documents with a sketch shingle are candidates; they are verified on all shingles of the item.  Only
DataFrame functions are used.

Words are runs of letters and digits, in lower case.  An item of fewer than ``words`` words is a single
shingle of all its words, searched among the documents' shingles of that length; an item without
words is in nothing.

Nulls and edge cases: a null text is empty; ids need not be unique: items and documents go by a key of
id and text, so each text is judged alone, and a pair gives a row for each different text; rows equal in
id and text are one; a null id is kept; very long texts are read whole; empty tables give an empty result; other
columns are ignored (and pass through ``drop_contaminated``, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivox.llm.session import bounded, cut

WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 200_000  # a table of at most so many (hash, item) rows, some MB, is broadcast
BREAK = r"[^\p{L}\p{N}]+"


def tokens(text) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK), lambda w: w != "")


def shingles(of, n: int) -> F.Column:
    """Hashes of all runs of n words in the array of words."""
    run = lambda w, i: F.xxhash64(w, *[F.get(of, i + k) for k in range(1, n)])
    return F.slice(F.transform(of, run), F.lit(1), F.greatest(F.size(of) - (n - 1), F.lit(0)))


def item_shingles(items: DataFrame, words: int) -> DataFrame:
    """items(item_key, text) -> (item_key, length, h): distinct shingles; length: words in a shingle."""
    split = items.select("item_key", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    of_length = [F.when(F.size("w") == n, shingles(F.col("w"), n)) for n in range(1, words)]
    split = split.select("item_key", F.least(F.size("w"), F.lit(words)).alias("length"), F.explode(F.array_distinct(F.coalesce(*of_length, shingles(F.col("w"), words)))).alias("h"))
    return split.distinct()


def sketches(of_items: DataFrame, threshold: float) -> DataFrame:
    """(item_key, length, h, n, least): the smallest hashes of each item, as many as its class by size needs; least:
    shingles that a document has if it contains an item of the class."""
    arrays = of_items.groupBy("item_key", "length").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    n = F.size("hs")
    arrays = arrays.select("*", n.alias("n"), F.ceil(F.log2(n)).cast("int").alias("class"))
    largest = F.call_function("shiftleft", F.lit(1), F.col("class"))
    slots = F.floor((1 - threshold) * largest + 1e-9).cast("int") + 1
    smallest = F.floor(largest / 2) + 1
    least = F.ceil(threshold * smallest - 1e-9).cast("int")
    return arrays.select("item_key", "length", "n", least.alias("least"), F.explode(F.slice("hs", F.lit(1), slots)).alias("h"))


def row_key(id_column: str) -> F.Column:
    """A key of id and text; a null id differs from all others."""
    return F.xxhash64(F.col(id_column).isNull(), F.col(id_column), F.col("text").cast("string"))


def document_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """docs(row_id, text) -> (row_id, length, h, n_own), a row for each distinct shingle of each length, and how many
    of that length the text has."""
    split = docs.select("row_id", tokens(F.col("text")).alias("w"))

    def of_length(n: int) -> F.Column:
        with_size = lambda hs: F.transform(hs, lambda h: F.struct(F.lit(n).alias("length"), h.alias("h"), F.size(hs).alias("n_own")))
        return F.get(F.transform(F.array(F.array_distinct(shingles(F.col("w"), n))), with_size), F.lit(0))

    each = [of_length(n) for n in lengths]
    return split.select("row_id", F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("s")).select("row_id", "s.*")


def contained(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, n_shingles, n_found, containment)
    for each contained item; each row is taken by its own text, whatever its id."""
    found = docs.select(row_key("doc_id").alias("row_id"), "doc_id", "text")
    pairs = cut(contained_rows(found, items, words, threshold))
    doc_ids = found.join(bounded(cut(pairs.select("row_id").distinct()), BROADCAST_ROWS), "row_id", "left_semi").select("row_id", "doc_id").distinct()
    item_ids = items.select(row_key("item_id").alias("item_key"), "item_id").distinct()
    return pairs.join(doc_ids, "row_id").join(bounded(item_ids, BROADCAST_ROWS), "item_key").select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def contained_rows(found: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """found(row_id, text, ...), items(item_id, text) -> (row_id, item_key, n_shingles, n_found, containment)."""
    of_items = cut(item_shingles(items.select(row_key("item_id").alias("item_key"), "text"), words))
    lengths = [r[0] for r in of_items.select("length").distinct().collect()]  # at most `words` values
    if not lengths:
        return found.limit(0).selectExpr("row_id", "row_id as item_key", "0 as n_shingles", "0 as n_found", "0D as containment")
    sketch = cut(sketches(of_items, threshold))
    counts = sketch.select("item_key", "length", "n").distinct()
    wanted = bounded(sketch.groupBy("length", "h").agg(F.min("least").alias("least")), BROADCAST_ROWS)
    all_items = of_items.join(counts, ["item_key", "length"])
    near = document_shingles(found, lengths).join(wanted, ["length", "h"])
    hits = cut(near.where("n_own >= least").select("row_id").distinct())
    hit = found.join(bounded(hits, BROADCAST_ROWS), "row_id", "left_semi")
    known = bounded(of_items.select("length", "h").distinct(), BROADCAST_ROWS)
    there = document_shingles(hit, lengths).join(known, ["length", "h"], "left_semi")
    both = there.join(bounded(all_items, BROADCAST_ROWS), ["length", "h"])
    of_pair = both.groupBy("row_id", "item_key").agg(F.count_distinct("h").alias("n_found"), F.first("n").alias("n_shingles"))
    checked = of_pair.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold - 1e-9)
    return checked.select("row_id", "item_key", F.col("n_shingles").cast("int").alias("n_shingles"), F.col("n_found").cast("int").alias("n_found"), "containment")


def op4(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    return contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that contain an item; each row goes by its own text, whatever its doc_id."""
    found = docs.select(row_key("doc_id").alias("row_id"), F.struct(*docs.columns).alias("row"))
    bad = contained_rows(found.select("row_id", F.col("row.text").alias("text")), items).select("row_id").distinct()
    return found.join(bounded(cut(bad), BROADCAST_ROWS), "row_id", "left_anti").select("row.*")


ORACLE_OP4 = r"""
with it as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
di as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
ln as (select distinct least(5, len(w)) as l from it where len(w) > 0),
si as (select distinct item_id, l, array_to_string(w[i:i+l-1], ' ') as s
       from (select item_id, w, least(5, len(w)) as l, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from it where len(w) > 0)),
sd as (select distinct doc_id, l, array_to_string(w[i:i+l-1], ' ') as s
       from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from di, ln where len(w) >= l)),
n as (select item_id, count(*)::int as n_shingles from si group by 1),
f as (select doc_id, item_id, count(*)::int as n_found from sd join si using (l, s) group by 1, 2)
select doc_id, item_id, n_shingles, n_found, n_found::double / n_shingles as containment
from f join n using (item_id) where n_found >= 0.8 * n_shingles - 1e-9
"""
