"""Mixing sources to target weights.

Targets: sources, by code point with null last, weigh 5, 2, 1 and so on again; they share
``share`` times all words; a target stops at ``most`` times its source's words and the excess goes to
the others by weight.

Draw: a source's documents fall into blocks by a hash of doc_id.  A source takes whole passes over
its blocks, then of one more pass permuted blocks as far as they fit into what is left of the target:
this fixes the source's quota, an exact number of blocks.  A splitting tree deals the quotas to the
output shards: at each node the vector of quotas is split by a multivariate hypergeometric draw
between the two halves of the shards, as if all blocks were shuffled and cut.  A shard draws its
blocks from the source's permuted order, in ranges that no other shard has, and shuffles its
documents locally.

Only sums by source and the quotas reach the driver: a few numbers for each source (sources are as many as
there are weights to give, a list of config size).  Blocks are at most ``blocks`` for a source, so a hot source's
rows meet in no task.  The number of shards follows the words drawn.  The table of blocks is broadcast if it has at most
``BROADCAST_ROWS`` rows, so texts move once, to their shards.

Nulls and edge cases: a null text has no words and is taken as often as its block (taken 0); a block without words
is drawn with the whole passes only; a null source is a source, the last; a null doc_id hashes like an empty id;
repeated rows share a block; very long texts are sizes like any other (one larger than what is left of a
target is not drawn again); an empty table gives an empty result; other columns pass through, whatever their
names (``mix_shard`` is replaced).
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivox.llm.session import bounded, cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCKS = 2048
SHARDS = 16  # at least
SHARD_WORDS = 1 << 26  # in a shard of a large mixture, on average
BROADCAST_ROWS = 200_000  # a table of at most so many blocks, some MB, is broadcast
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of the sources in their order."""
    caps = [most * s for s in sizes]
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        unit = total / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * unit > caps[k]}
        if not full:
            for k in open_:
                out[k] = weight[k] * unit
            break
        for k in full:
            out[k] = caps[k]
            total -= caps[k]
        open_ -= full
    return out


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quota of each source -> shards x sources; rows add up to quota, and differ in size by one at most."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    n = int(quota.sum()) * left // shards
    half = rng.multivariate_hypergeometric(quota, n, method="marginals") if quota.sum() else quota
    return np.concatenate([split(half, left, rng), split(quota - half, shards - left, rng)])


def order_of(name: str | None) -> tuple:
    return (name is None, name or "")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sizes (doc_id, source, size, block), and the blocks (source, block, source_size, target,
    draws: the shards that drew it, one entry a draw)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), block_of(blocks, seed)))
    by_block = cut(sized.groupBy("source", "block").agg(F.sum("size").alias("words")))
    sources = sorted(by_block.groupBy("source").agg(F.sum("words")).collect(), key=lambda r: order_of(r[0]))
    sizes = [int(r[1]) for r in sources]
    goals = targets(sizes, weights, share, most)
    goal = {r[0]: (k, size, target) for k, (r, size, target) in enumerate(zip(sources, sizes, goals, strict=True))}

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        """The draws of one source in order: whole passes, then the blocks that still fit."""
        source = None if pd.isna(pdf["source"].iloc[0]) else pdf["source"].iloc[0]
        rank, total, target = goal[source]
        pdf = pdf.sort_values("block")
        rng = np.random.default_rng([seed, rank])
        whole = int((target + 1e-6) // total) if total else 0
        taken = [rng.permutation(len(pdf)) for _ in range(whole)]
        rest, fits, words = target - whole * total, [], pdf["words"].to_numpy()
        for k in rng.permutation(len(pdf)).tolist():
            if 0 < words[k] <= rest + 1e-6:
                rest -= words[k]
                fits.append(k)
        order = np.concatenate([*taken, np.array(fits, dtype=int)])
        return pd.DataFrame({"source": pdf["source"].iloc[order].to_numpy(), "block": pdf["block"].to_numpy()[order], "unit": np.arange(len(order))})

    drawn = cut(by_block.groupBy("source").applyInPandas(draw, "source string, block int, unit long"))
    quotas = {r[0]: int(r[1]) for r in drawn.groupBy("source").agg(F.count("*")).collect()}
    quota = np.array([quotas.get(r[0], 0) for r in sources], dtype=np.int64)
    shards = shards or max(SHARDS, ceil(sum(goals) / SHARD_WORDS))
    ends = split(quota, shards, np.random.default_rng(seed)).cumsum(0)
    rows = [(r[0], float(sizes[k]), float(goals[k]), ends[:, k].tolist()) for k, r in enumerate(sources)]
    facts = spark.createDataFrame(rows, "its_source string, source_size double, target double, ends array<long>")
    here = F.col("source").eqNullSafe(F.col("its_source"))
    facts = bounded(facts, BROADCAST_ROWS)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("unit"))).alias("shard")
    dealt = drawn.join(facts, here).select("source", "block", shard).groupBy("source", "block").agg(F.array_sort(F.collect_list("shard")).alias("draws"))
    dealt = dealt.select(F.col("source").alias("drawn_source"), F.col("block").alias("drawn_block"), "draws")
    same = F.col("source").eqNullSafe(F.col("drawn_source")) & (F.col("block") == F.col("drawn_block"))
    table = by_block.join(facts, here).join(dealt, same, "left")
    empty = F.array().cast("array<int>")
    return sized, cut(table.select("source", "block", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("draws", empty).alias("draws")))


def block_of(blocks: int, seed: int) -> F.Column:
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.pmod(hashed, F.lit(blocks)).cast("int").alias("block")


def to_block(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows(source, block, ...) with the facts of their block."""
    facts = table.select(F.col("source").alias("block_source"), F.col("block").alias("block_number"), "source_size", "target", "draws")
    here = F.col("source").eqNullSafe(F.col("block_source")) & (F.col("block") == F.col("block_number"))
    return rows.join(bounded(facts, BROADCAST_ROWS), here).drop("block_source", "block_number")


def mix(docs: DataFrame, shuffle: bool = True, **options) -> DataFrame:
    """The mixture: docs' rows, each as often as it is drawn, with mix_shard; shuffled within shards."""
    blocks, seed = options.get("blocks", BLOCKS), options.get("seed", SEED)
    _, table = mix_plan(docs, **options)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").cast("string").alias("source"), block_of(blocks, seed))
    drawn = to_block(rows, table).select("row", F.posexplode("draws").alias("copy", "mix_shard"))
    out = drawn.select(*[F.col("row").getField(c).alias(c) for c in names if c != "mix_shard"], "mix_shard", F.xxhash64(F.lit(seed), F.col("row.doc_id"), "copy").alias("mix_order"))
    if shuffle:
        out = out.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
    return out.drop("mix_order")


def op7(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    sized, blocks = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.size("draws")).alias("taken")
    return to_block(sized, blocks).select("doc_id", "size", "source_size", "target", taken, "draws")
