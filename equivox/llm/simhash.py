"""SimHash near-duplicate groups.

A fingerprint is 64 bits: bit b is set when more than half of a text's word shingles have bit b set
in their XXH64.  Texts link when their fingerprints differ in at most ``radius`` bits.

Search: the 64 bits are cut into ``radius + 3`` blocks.  Two fingerprints that differ in ``radius``
bits agree on at least three blocks (pigeonhole), so every choice of three blocks is a join key of
about 32 bits.  Equal fingerprints are merged before, so groups of copies are one row.  Rows that
share a key meet in one partition, their Hamming distances are verified there with numpy, and only a
spanning forest of each key's links leaves it: the number of rows stays linear in the group's size
and no link between different texts is lost for connectivity.

``near_texts`` links texts by the exact similarity of their sets of shingles.  Fingerprints come first: pairs
within the radius are verified on their sets and so most groups of copies are connected at the start.  But at a
similarity of 0.8 fingerprints differ in about 10 bits of 64, often in 16, and no choice of blocks both holds that
radius and makes keys long enough to join on; so a second search completes the first: two texts of that similarity
share one of their rarest shingles (a prefix of each set in an order that all share), and the number they share
bounds their similarity from above before any set is compared.

Nulls and edge cases: a null text counts as empty; a text without words has fingerprint zero and
links like any other; repeated rows stay; a null doc_id is kept and never names a component unless
the whole component has none; an empty table gives an empty result; other columns are ignored (and pass
through ``drop_near_copies``, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equivox.llm.components import components
from equivox.llm.session import bounded, cut, written

SAMPLE = 5_000  # texts looked at to learn which shingles are common
COMMON = 100_000  # of these so many at most are known by count
SMALL = 32  # groups of so many texts are compared pair by pair
CENTRES = 4  # of larger groups so many texts are compared with all others at first
PARTS = 64  # of the larger groups one part in so many goes first: near copies share many keys, and few connect them
ROWS = 500  # of a batch looked at once
BROADCAST_ROWS = 500_000  # a list of at most so many texts or rows, some MB, is broadcast
PIECE = 1 << 18  # shingles counted at once, so that a huge text needs little memory


def node_of() -> F.Column:
    """The number a text goes by; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that little is held besides them."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def hashed_shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of all runs of words, repeats included; a shorter text is one run, one without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(tokens[k:] for k in range(words)), strict=False) if len(tokens) >= words else [tokens]
    return np.fromiter((digest(b" ".join(run), 42) for run in runs), np.uint64, max(1, len(tokens) - words + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = hashes[at : at + PIECE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(hashed_shingles(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp long: the 64 bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            bits = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """One bit mask for each choice of three of radius + 3 blocks, as signed longs."""
    blocks = radius + 3
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    whole = [block[a] | block[b] | block[c] for a, b, c in combinations(range(blocks), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Positions of the ends of a spanning forest of the links among fps: each is visited once and
    compared with those not reached yet."""
    left = np.arange(len(fps))
    us: list[int] = []
    vs: list[int] = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                got = left[near].tolist()
                us += [at] * len(got)
                vs += got
                front += got
                left = left[~near]
    return us, vs


def linked(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Edges (u, v) among rows of equal key; keys are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []
    for gap in range(1, 8):  # groups of up to eight rows: all pairs, all groups at once
        at = starts[(sizes > gap) & (sizes <= 8)]
        size = sizes[(sizes > gap) & (sizes <= 8)]
        a = np.concatenate([at + k for k in range(8 - gap)]) if len(at) else np.empty(0, int)
        ok = np.concatenate([size > k + gap for k in range(8 - gap)]) if len(at) else np.empty(0, bool)
        a = a[ok]
        near = np.bitwise_count(fps[a] ^ fps[a + gap]) <= radius
        found.append(np.stack([fps[a[near]], fps[a[near] + gap]], 1))
    for at, size in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        own = fps[at : at + size]
        us, vs = forest(own, radius)
        found.append(np.stack([own[us], own[vs]], 1) if us else np.empty((0, 2), np.uint64))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """distinct(fp) -> (u, v): links enough to connect all fingerprints within radius of another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on

        def done() -> pd.DataFrame:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return table(linked(keys, fps, radius))

        for batch in batches:
            if not len(batch):
                continue
            keys, fps = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64).view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1]))
            if held and (last or keys[0] != held[-1][0][-1]):
                held.append((keys[:last], fps[:last]))
                yield done()
            elif last:
                held.append((keys[:last], fps[:last]))
                yield done()
            held.append((keys[last:], fps[last:]))
        if held:
            yield done()

    def table(edges: np.ndarray) -> pd.DataFrame:
        edges = edges.view(np.int64)
        return pd.DataFrame({"u": edges.min(1), "v": edges.max(1)}) if len(edges) else pd.DataFrame({"u": [], "v": []}, dtype="int64")

    each = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(radius))]
    keyed = distinct.select("fp", F.explode(F.array(*each)).alias("key")).repartition("key").sortWithinPartitions("key")
    return keyed.mapInPandas(run, "u long, v long").distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs -> (doc_id, fp, component_id), one row for each row of docs."""
    prints = cut(fingerprints(docs, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the runs of words, sorted; a shorter text is one run."""
    return np.unique(hashed_shingles(text, words).view(np.int64))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """texts(node, text) -> (node, hs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = pa.array([shingle_set(t, words) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "hs"])

    return texts.select("node", "text").mapInArrow(run, "node long, hs array<long>")


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and how many have them; they only set the
    order of search, so what the sample misses costs time and loses nothing."""
    every = max(1, -(-texts.count() // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).dropDuplicates(["node"])
    counts = shingle_sets(some, words).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas().sort_values("h")
    return got["h"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def profiles(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """texts(node, text) -> (node, fp, n, keys): fingerprint, number n of distinct shingles, and the rarest of them,
    n - ceil(similarity * n) + 1 in an order that all texts share.  Two texts of that similarity have one of these
    in common.  Each text is a row once a task."""
    hs, ns = common_shingles(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                hashes = hashed_shingles(text, words)
                own = np.unique(hashes.view(np.int64))
                at = np.minimum(np.searchsorted(hs, own), max(len(hs) - 1, 0))
                often = np.where(hs[at] == own, ns[at], 0) if len(hs) else np.zeros(len(own), np.int64)
                # texts without words have no shingle and are equal to each other
                keys = own[np.lexsort((own, often))[: len(own) - least_shared(len(own), similarity) + 1]] if len(own) else np.zeros(1, np.int64)
                rows.append((node, int(np.uint64(majority(hashes)).view(np.int64)), len(own), keys))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "fp", "n", "keys"])

    return texts.mapInArrow(run, "node long, fp long, n int, keys array<long>")


def least_shared(n: int, similarity: float) -> int:
    return int(np.ceil(similarity * n - 1e-9))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have the similarity."""
    wanted = written(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct())
    sets = written(shingle_sets(texts.join(bounded(wanted, BROADCAST_ROWS), "node", "left_semi").dropDuplicates(["node"]), words))
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("hs").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("hs").alias("a")), "u")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


def by_fingerprint(found: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Profiles -> pairs (u, v) within radius, enough to connect all such: fingerprints by their links, and the texts
    of one fingerprint with the least of them; pairs whose sizes rule the similarity out are left."""
    prints = found.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"))
    of = lambda name: prints.select(F.col("fp").alias(name), F.col("first.node").alias(f"{name}_node"), F.col("first.n").alias(f"{name}_n"))
    between = links(prints.select("fp"), radius).join(of("u"), "u").join(of("v"), "v")
    within = found.join(prints, "fp").where("node != first.node")
    pairs = between.selectExpr("u_node", "v_node", "u_n", "v_n").union(within.selectExpr("first.node", "node", "first.n", "n"))
    sized = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9
    return pairs.where(sized).select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels(node, root) after the pairs (u, v) are linked, too."""
    if pairs.isEmpty():
        return labels
    named = pairs
    for x in "uv":
        named = named.join(labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    moved = components(named.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    known = labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(known.union(moved.join(labels, "node", "left_anti").select("node", "root")))


def near_texts(docs: DataFrame, words: int, similarity: float, radius: int = 3) -> DataFrame:
    """docs(text, ...) -> (node, root) for the texts that have a near copy.

    Links of the fingerprints come first.  Then texts that share a key and are not connected yet are compared: all
    pairs of small groups; of a large one the first few texts with all others, then the next ones, eight times as
    many each round, until the group is connected or used up.  The first round takes a part of the large groups only.
    So no link is lost for connectivity, and a large group of near copies costs a few rows for each text.

    In large groups a pair is compared only where the key is among the first of the smaller text's keys that any text
    at least as large shares (``inner``; n - ceil(2 s / (1 + s) n) + 1 of them for the similarity s); so texts that
    have a frequent passage in common and little else do not meet.  A pair shares at most as many of its shingles as
    keys it shares, and all that come after the keys of one of the two: pairs for which that is too few are dropped
    before sets are compared (``shared_keys`` counts those of small groups, ``large`` how many keys of a text were in
    large ones at first and may be shared)."""
    texts = docs.select(node_of().alias("node"), F.col("text").cast("string").alias("text"))
    found = written(profiles(texts, words, similarity))
    close = written(by_fingerprint(found.select("node", "fp", "n").distinct(), radius, similarity))
    labels = components(verified(close, texts, words, similarity))
    key = Window.partitionBy("key")
    inner = F.col("place") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9)
    left = found.select("node", "n", F.posexplode("keys").alias("place", "key")).select("key", "node", "n", inner.alias("inner"))
    left = written(left.repartition("key").distinct().withColumn("g", F.count("*").over(key)).where("g > 1"))
    large = left.groupBy("node").agg(F.count_if(F.col("g") > SMALL).alias("large"))
    left, parts, centres = left.drop("g").join(large, "node"), 1, CENTRES
    while True:
        named = left.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = key.orderBy(F.desc("inner"), "node")
        open_ = named.withColumns({"g": F.count("*").over(key), "least": F.min("root").over(key), "most": F.max("root").over(key), "any": F.max("inner").over(key), "k": F.row_number().over(order)})
        small = F.col("g") <= SMALL
        open_ = open_.where((small | F.col("any")) & (F.col("least") < F.col("most"))).withColumn("now", small | (F.pmod(F.xxhash64("key"), F.lit(PARTS)) < parts))
        open_ = written(open_.drop("least", "most", "any"))
        if open_.isEmpty():
            return labels
        rows = open_.where("now")
        side = lambda x: rows.select("key", *[F.col(c).alias(c + x) for c in ("g", "k", "root", "inner", "n")], F.struct("node", "n", "large").alias(x))  # noqa: B023, E731
        a = side("u").where((F.col("gu") <= SMALL) | (F.col("ku") <= centres))
        met = (F.col("gu") <= SMALL) | F.when(F.col("nu") < F.col("nv"), F.col("inneru")).when(F.col("nu") > F.col("nv"), F.col("innerv")).otherwise(F.col("inneru") | F.col("innerv"))
        pairs = a.join(side("v"), "key").where((F.col("ku") < F.col("kv")) & (F.col("rootu") != F.col("rootv")) & met)
        pairs = pairs.groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(F.count_if(F.col("gu") <= SMALL).alias("shared_keys"))
        pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.n").alias("nu"), F.col("y.n").alias("nv"), F.col("x.large").alias("lu"), F.col("y.large").alias("lv"), "shared_keys")
        after = F.ceil(similarity * F.greatest("nu", "nv") - 1e-9) - 1  # shingles beyond the keys, of the one that has more
        most = F.least(F.least("nu", "nv"), F.col("shared_keys") + F.least("lu", "lv") + after)
        enough = most >= similarity * (F.col("nu") + F.col("nv") - most) - 1e-9
        pairs = written(pairs.where(enough | (F.greatest("nu", "nv") == 0)).select("u", "v"))
        labels = merged(labels, written(verified(pairs, texts, words, similarity)))
        left = open_.where(~small & (~F.col("now") | (F.col("k") > centres))).select("key", "node", "n", "inner", "large")
        if left.isEmpty():
            return labels
        if parts == 1:  # few texts are left after the first round
            texts = written(texts.join(bounded(written(left.select("node").distinct()), BROADCAST_ROWS), "node", "left_semi").dropDuplicates(["node"]))
            parts = PARTS
        else:
            centres *= 8


def op6(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each component of texts stays: that of the smallest doc_id, nulls last (of equal ones
    the row whose columns hash lowest; rows equal in all columns are one row).  Rows are thinned by
    their text alone, so rows that only share a doc_id, or have none, all stay.

    Texts link by fingerprints within radius or, with a similarity, when the Jaccard similarity of their
    sets of shingles reaches it."""
    if similarity is None:
        groups = near_groups(docs.select(node_of().alias("doc_id"), "text"), words, radius)
        roots = groups.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct()
    else:
        roots = near_texts(docs, words, similarity)
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("row"), node_of().alias("node"), F.col("doc_id").alias("id"))
    whole = whole.withColumn("row_key", F.md5(F.to_json("row")))
    per_row = written(whole.groupBy("node", F.col("id").isNull().alias("last"), "id", "row_key").agg(F.count("*").alias("n")))
    first = F.min(F.struct("last", "id", "row_key", "n")).alias("first")
    per_text = per_row.groupBy("node").agg(first).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first.*")
    keep = written(per_text.groupBy("root").agg(first).select("first.row_key", "first.n"))
    gone = written(per_row.join(keep.where("n = 1"), "row_key", "left_anti").select("row_key"))
    once = whole.join(bounded(gone, BROADCAST_ROWS), "row_key", "left_anti").select("row.*")
    repeated = keep.where("n > 1")
    if repeated.isEmpty():
        return once
    rows = whole.join(bounded(repeated, BROADCAST_ROWS), "row_key", "left_semi")
    return once.unionByName(rows.dropDuplicates(["row_key"]).select("row.*"))
