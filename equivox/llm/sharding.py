"""Sharding by extendible hashing.

A document's key is the first 60 bits of the MD5 of its doc_id.  The directory is indexed by a prefix
of those bits; it starts with one bucket, and only a bucket over the byte limit splits on one more
bit, until every bucket fits or holds a single key.  Sizes are summed by key, then by a prefix a few
bits longer than the mean bucket needs (a cell); all shorter prefixes are summed from those, partly before they
are shuffled, and the shards are the prefixes that fit and whose parents do not.  Cells find their shard by a join on
the levels that hold shards only, so no key of that join stands for a large part of the cells.  Cells that are
still too large go round again with more bits, so the work follows the data and not the depth.

Nulls and edge cases: a null text has no bytes; a null doc_id is hashed like an empty id; rows of one
doc_id share a key and so a shard; a single key over the limit (a very long text, or a hot id) is a shard of its
own, marked oversized; an empty table gives an empty result; other columns pass through, whatever their names
(``shard``, ``shard_depth``, ``shard_bytes`` and ``shard_oversized`` are replaced).
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivox.llm.session import bounded, cut

BITS = 60
MAX_BYTES = 8 << 20
QUERY_BYTES = 1 << 20  # the limit of op9's query, so low that small tables split, too
BROADCAST_ROWS = 50_000  # a directory of at most so many rows (under 10 MB) is broadcast


def key(doc_id) -> F.Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(of, depth) -> F.Column:
    return F.call_function("shiftright", of, (F.lit(BITS) - depth).cast("int"))


def prefixes_of(cells: DataFrame, top: int, depth: int) -> DataFrame:
    """cells(cell, ...) -> with each prefix (d, p) from top to depth bits."""
    each = cells.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(depth))))
    return each.withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("d")).cast("int")))


def leaves(cells: DataFrame, top: int, depth: int, max_bytes: int) -> DataFrame:
    """cells(cell, bytes, low, high) -> (d, p, shard_bytes): prefixes that fit, or hold one key, and whose parents do not."""
    sums = prefixes_of(cells, top, depth).groupBy("d", "p").agg(F.sum("bytes").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    fit = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("low") == F.col("high"))).select("d", "p", "shard_bytes")
    fit = fit.withColumn("parent", F.call_function("shiftright", F.col("p"), F.lit(1)))
    parents = fit.select((F.col("d") + 1).alias("d"), F.col("p").alias("parent"))
    return fit.join(parents, ["d", "parent"], "left_anti").drop("parent")


def directory(keys: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """keys(h, bytes), one row a key -> for each round the number of bits and a table
    (cell, depth, p, shard_bytes, oversized); depth is null where a later round decides."""
    total, n = keys.agg(F.sum("bytes"), F.count("*")).first()
    if not n:
        return []
    depth = min(BITS, max(0, ceil(log2(max(1, total) / max_bytes))) + 5)
    rounds, top = [], 0
    while True:
        cells = cut(keys.groupBy(prefix(F.col("h"), F.lit(depth)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")))
        found = cut(leaves(cells, top, depth, max_bytes))
        held = [r[0] for r in found.select("d").distinct().collect()]  # at most 61 levels
        placed = prefixes_of(cells.select("cell"), top, depth).where(F.col("d").isin(held)).join(found, ["d", "p"])
        placed = placed.select("cell", F.col("d").alias("depth"), "p", "shard_bytes", (F.col("shard_bytes") > max_bytes).alias("oversized"))
        cells = cut(cells.select("cell").join(placed, "cell", "left"))
        rounds.append((depth, cells))
        undone = cells.where("depth is null").select("cell")
        if undone.isEmpty():
            return rounds
        keys = keys.withColumn("cell", prefix(F.col("h"), F.lit(depth))).join(undone, "cell", "left_semi").select("h", "bytes")
        top, depth = depth + 1, min(BITS, depth + 10)


def shard(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> its rows with shard (the prefix in bits, empty for the whole), its
    depth, the shard's bytes and whether it is over the limit."""
    names = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes", "shard_oversized")]
    h, size = key(F.col("doc_id")), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    keys = cut(docs.select(h.alias("h"), size.alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes")))
    rows = docs.select(F.struct(*names).alias("row"), h.alias("h"))
    found = []
    for k, (bits, cells) in enumerate(directory(keys, max_bytes)):
        side = cells.where("depth is not null").select(F.col("cell").alias(f"cell{k}"), F.struct("depth", "p", "shard_bytes", "oversized").alias(f"leaf{k}"))
        rows = rows.withColumn(f"cell{k}", prefix(F.col("h"), F.lit(bits))).join(bounded(side, BROADCAST_ROWS), f"cell{k}", "left")
        found.append(F.col(f"leaf{k}"))
    blank = F.lit(None).cast("struct<depth:int,p:bigint,shard_bytes:bigint,oversized:boolean>")
    leaf = F.coalesce(*found, blank)
    rows = rows.select("row", leaf.alias("leaf"))
    bits = F.when(F.col("leaf.depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("leaf.p"), F.col("leaf.depth"), F.lit("0")))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], bits.alias("shard"), F.col("leaf.depth").alias("shard_depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.oversized").alias("shard_oversized"))


def op9(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard(docs, QUERY_BYTES)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes", "shard_oversized")


ORACLE_OP9 = f"""
with k as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {BITS // 4}))::bigint as h
  from documents),
d as (select unnest(range(0, {BITS + 1})) as depth),
s as (
  select depth, h >> ({BITS} - depth) as p, sum(n_bytes)::bigint as b, min(h) as low, max(h) as high
  from k, d group by all),
ok as (select * from s where b <= {QUERY_BYTES} or low = high),
leaf as (
  select k.doc_id, k.n_bytes, k.h, min(ok.depth) as depth
  from k join d on true join ok on ok.depth = d.depth and ok.p = k.h >> ({BITS} - d.depth)
  group by all)
select leaf.doc_id, leaf.n_bytes,
       case when leaf.depth = 0 then '' else substr(lpad(bin(leaf.h >> ({BITS} - leaf.depth)), 64, '0'), 65 - leaf.depth::int) end as shard,
       leaf.depth::int as shard_depth, ok.b as shard_bytes, ok.b > {QUERY_BYTES} as shard_oversized
from leaf join ok on ok.depth = leaf.depth and ok.p = leaf.h >> ({BITS} - leaf.depth)
"""
