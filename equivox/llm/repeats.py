"""Suffix-array dedup: bytes that repeat a string of ``LENGTH`` bytes of a smaller document go.

Dealing.  Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams of GRAM bytes; the one of least hash (the
leftmost of equals) is its anchor, so equal strings have equal anchors in equal places.  Neighbouring strings share
anchors: the stretch of text whose strings have one anchor is its span.  Anchors are dealt to buckets by the gram's
hash, so all occurrences of a string meet in one bucket.  There, anchors of equal grams and spans (by 88 bits of
hashes and the bucket) are one class; the text of a class is sent once, by one of its members, if the class has
members in several documents or its gram has classes that begin in different documents.

Suffix array.  The spans of a bucket's classes are its texts.  Their suffixes are sorted, the lengths of common
prefixes of neighbours found, and one scan with a stack builds the common-prefix interval tree from the inner
intervals out; each takes along the smallest document of its occurrences and whether these are preceded by different
bytes (or start a text).  Intervals of at least LENGTH bytes that are so are the maximal repeats: strings with all
their occurrences that can't be extended to either side.  (A class of several documents is a leaf that stands for
several occurrences: its whole span is a repeat.)  Every string of LENGTH bytes that occurs twice lies in a maximal
repeat with the same occurrences, so what goes is read off these groups: their occurrences in other than the smallest
document.  ``maximal_repeats`` lists the same groups of whole texts, of any length.

Texts are packed into blocks and stay where they are; anchors (11 bytes, about one for 15 bytes of text), members of
classes and answers travel.  Within a block equal spans are merged first, so a group of copies sends each anchor once
a block.  A very frequent gram keeps its classes (distinct spans, not copies) in one bucket.

Nulls and edge cases: a null text is empty; rows of one doc_id never remove each other; a null doc_id
counts as larger than all others (equal to the largest long); texts under LENGTH bytes lose nothing; very long texts
are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivox.llm.session import cut

LENGTH = 50
GRAM = 24
WIDTH = LENGTH - GRAM + 1
WIDEST = LENGTH + WIDTH - 1  # bytes of a span
BLOCK = 4 << 20
CHUNK = 1 << 19
LAST = (1 << 63) - 1
U = np.uint64


# --- the enhanced suffix array ---------------------------------------------------------------


def suffix_array(text: np.ndarray, starts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at starts, each of as many bytes as left says (WIDEST at most), and the lengths of
    the common prefixes with the one before."""
    if not len(starts):
        return starts, np.empty(0, np.int64)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(WIDEST + 8, np.uint8)]), 8)
    keys = []
    for at in range(0, WIDEST, 8):
        part = np.ascontiguousarray(words[starts + at]).view(">u8").ravel().astype(U)
        beyond = (8 * (8 - np.clip(left - at, 0, 8))).astype(U)  # bits after the suffix's end count as zero
        keys.append(np.where(beyond < U(64), part >> np.minimum(beyond, U(63)) << np.minimum(beyond, U(63)), U(0)))
    order = np.lexsort([left, *keys[::-1]])  # an end comes before a zero byte
    lcp, same = np.zeros(len(starts), np.int64), np.ones(len(starts) - 1, bool)
    for key in keys:
        key = key[order]
        differ = key[1:] ^ key[:-1]
        # bytes in common: eight less those from the highest differing bit down
        high, low = (differ >> U(32)).astype(float), (differ & U(0xFFFFFFFF)).astype(float)
        bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        lcp[1:] += np.where(same, 8 - (bits + 7) // 8, 0)
        same &= differ == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[order][1:], left[order][:-1]))
    return order, lcp


def maximal(lcp: list[int], doc: list[int], before: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(length, first, last, smallest document) of the intervals of the common-prefix tree of at least `least` bytes
    whose suffixes are preceded by different bytes (before: the byte, or -1 at the start of a text), inner ones
    first, by one scan with a stack.  What is known of an interval is gathered from its children as they close."""
    stack: list[list[int]] = []  # length, first, smallest document, byte before all or -1
    for k in range(1, len(lcp) + 1):
        value = lcp[k] if k < len(lcp) else -1
        first, smallest, byte = k - 1, doc[k - 1], before[k - 1]
        while stack and stack[-1][0] > value:
            length, first, own, own_byte = stack.pop()
            smallest = min(smallest, own)
            byte = byte if byte == own_byte else -1
            if byte < 0:
                yield length, first, k - 1, smallest
        if value < least:
            continue
        if stack and stack[-1][0] == value:
            top = stack[-1]
            top[2] = min(top[2], smallest)
            top[3] = byte if byte == top[3] else -1
        else:
            stack.append([value, first, smallest, byte])


def whole_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each ended by a symbol below all bytes (bytes count from one); the starts of all suffixes in
    order, by doubling the length compared; and the lengths of the common prefixes, by Kasai's scan."""
    text = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
    n, step, rank = len(text), 1, text
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((after, rank))
        new = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        if rank.max() == n - 1:
            break
        step *= 2
    symbols, place, before = text.tolist(), rank.tolist(), order.tolist()
    lcp, h = [0] * n, 0
    for at in range(n):
        if place[at] == 0:
            h = 0
            continue
        other = before[place[at] - 1]
        while at + h < n and other + h < n and symbols[at + h] == symbols[other + h] != 0:
            h += 1
        lcp[place[at]] = h
        h = max(h - 1, 0)
    return text, order, np.array(lcp, np.int64)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """All strings of at least `least` bytes (one or more), however long, that occur at least twice in the texts
    and can't be extended to either side in all their occurrences, each with all occurrences (text, offset)."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    text, order, lcp = whole_order(texts)
    of = np.searchsorted(offsets, order, side="right") - 1
    before = np.where(order > offsets[of], text[order - 1], -1)
    found = []
    for length, first, last, _ in maximal(lcp.tolist(), of.tolist(), before.tolist(), least):
        at = order[first]
        found.append((texts[of[first]][at - offsets[of[first]] :][:length], sorted((int(of[k]), int(order[k] - offsets[of[k]])) for k in range(first, last + 1))))
    return found


# --- anchors ----------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd number and their inverses modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = CHUNK + 2 * LENGTH

    def powers(of: int) -> np.ndarray:
        out = np.full(n, of, dtype=U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1), powers(base), powers(inverse)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def spans(text: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts at offsets: for each anchor the gram's hash, the span's hash, the first and last start
    of its strings, and the number of its text."""
    byte, power, inverse = tables()
    valid = np.zeros(len(text) + 1, bool)
    for o, n in zip(offsets.tolist(), sizes.tolist(), strict=True):
        if n >= LENGTH:
            valid[o : o + n - LENGTH + 1] = True
    parts = []
    for c in range(0, len(text), CHUNK):
        x = text[c : c + CHUNK + LENGTH - 1]
        if len(x) < LENGTH:
            break
        sums = np.zeros(len(x) + 1, dtype=U)
        np.cumsum(byte[x] * power[: len(x)], out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(x) - GRAM + 1])
        key = grams & U(0xFFFFFFFFFFF00000) | np.arange(len(grams), dtype=U)
        for gap in (1, 2, 4, 8):
            key = np.minimum(key[:-gap], key[gap:])
        least = np.minimum(key[: 16 - WIDTH or None], key[WIDTH - 16 :]) & U(0xFFFFF)
        at = np.flatnonzero(valid[c : c + len(least)])
        anchor = least[at].astype(np.int64)
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        lo, hi, anchor = at[new], at[np.r_[new[1:], len(at)] - 1], anchor[new]
        whole = mixed((sums[hi + LENGTH] - sums[lo]) * inverse[lo] + (hi - lo).astype(U) * U(1 << 40) + (anchor - lo).astype(U))
        parts.append((grams[anchor], whole, lo + c, hi + c))
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    gram, whole, lo, hi = (np.concatenate(p) for p in zip(*parts, strict=True))
    return gram, whole, lo, hi, np.searchsorted(offsets, lo, side="right") - 1


class Block:
    """A block's texts and anchors.  sent: the anchors that travel, the first of each class of equal
    spans in the smallest document of the block; class_of: each anchor's class."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(zstandard.decompress(row["payload"]), np.uint8)
        self.gram, whole, self.lo, self.hi, doc = spans(self.text, self.offsets, self.sizes)
        self.doc = self.ids[doc] if len(doc) else doc
        both = mixed(self.gram + whole * U(3))
        order = np.lexsort((self.doc, both))
        first = np.r_[True, both[order][1:] != both[order][:-1]] if len(order) else np.empty(0, bool)
        self.class_of = np.empty(len(order), np.int64)
        self.class_of[order] = np.cumsum(first) - 1
        self.sent = order[first]
        self.whole, self.nulls = whole, np.frombuffer(row["nulls"], bool)
        self.later = self.doc > self.doc[self.sent][self.class_of] if len(order) else first

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The classes in the order of their buckets and documents, and where each bucket's begin."""
        of = (self.gram[self.sent] >> U(20)) % U(n)
        order = np.lexsort((self.doc[self.sent], of))
        return order, np.searchsorted(of[order], np.arange(n + 1, dtype=U))


def packed(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """docs -> (block, ids, nulls, sizes, payload): texts in blocks of about size bytes, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number, ids, nulls, texts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pd.DataFrame:
            sizes = np.array([len(t) for t in texts], np.int64)
            payload = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pd.DataFrame({"block": [task << 24 | number], "ids": [np.array(ids, np.int64).tobytes()], "nulls": [np.array(nulls, bool).tobytes()], "sizes": [sizes.tobytes()], "payload": [payload]})

        for batch in batches:
            for doc_id, null, text in zip(batch["doc_id"], batch["missing"], batch["text"], strict=True):
                ids.append(doc_id)
                nulls.append(null)
                texts.append(text.encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= size:
                    yield block()
                    number, ids, nulls, texts, held = number + 1, [], [], [], 0
        if texts:
            yield block()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("doc_id").cast("long").isNull().alias("missing"), text.alias("text"))
    return plain.mapInPandas(run, "block long, ids binary, nulls binary, sizes binary, payload binary")


def narrow(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view(U).ravel()


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers, as the bytes of their differences in order of weight, compressed."""
    planes = np.diff(x.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def loose(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel().cumsum()


def anchors_out(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row)
                order, ends = block.buckets(n)
                out = []
                for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                    own = block.sent[order[ends[k] : ends[k + 1]]]
                    ids, times = np.unique(block.doc[own], return_counts=True)
                    out.append((k, row["block"], narrow(block.gram[own], 5), narrow(block.whole[own], 6), squeezed(ids), squeezed(times)))
                yield pd.DataFrame(out, columns=["bucket", "block", "gram", "span", "ids", "times"])

    return run


def judged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The anchors of one bucket -> for each block its members of classes that may hold a repeat: their numbers,
    classes and documents, and which of them send their class's text."""
    counts = [len(x) // 5 for x in pdf["gram"]]
    gram, span = widen(b"".join(pdf["gram"]), 5), widen(b"".join(pdf["span"]), 6)
    doc = np.concatenate([np.repeat(loose(i), loose(t)) for i, t in zip(pdf["ids"], pdf["times"], strict=True)])
    order = np.lexsort((doc, span, gram))
    g, s, d = gram[order], span[order], doc[order]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new_class = new_gram | np.r_[True, s[1:] != s[:-1]]
    at, class_of = np.flatnonzero(new_class), np.cumsum(new_class) - 1
    first, several = d[at], np.maximum.reduceat(d, at) > d[at]
    gram_at, gram_of = np.flatnonzero(new_gram[at]), np.cumsum(new_gram[at]) - 1
    differ = np.minimum.reduceat(first, gram_at) != np.maximum.reduceat(first, gram_at)
    chosen = several | differ[gram_of]
    number_of = np.cumsum(chosen) - 1  # classes that may hold a repeat count from zero
    member, sends = np.full(len(order), -1, np.int64), np.zeros(len(order), bool)
    member[order] = np.where(chosen, number_of, -1)[class_of]
    sends[order[at]] = chosen
    out, begin = [], 0
    for block, n, bucket in zip(pdf["block"], counts, pdf["bucket"], strict=True):
        some = np.flatnonzero(member[begin : begin + n] >= 0)
        if len(some):
            own = begin + some
            out.append((bucket, block, squeezed(some), squeezed(member[own]), squeezed(doc[own]), np.packbits(sends[own]).tobytes()))
        begin += n
    return pd.DataFrame(out, columns=["bucket", "block", "number", "class", "doc", "sends"])


def wanted_text(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["wanted"] is None or not len(row["wanted"]):
                    continue
                block = Block(row)
                order, ends = block.buckets(n)
                out = []
                for asked in row["wanted"]:
                    number = loose(asked["number"])
                    sends = np.unpackbits(np.frombuffer(asked["sends"], np.uint8), count=len(number)).astype(bool)
                    if sends.any():
                        own = block.sent[order[ends[asked["bucket"]] + number[sends]]]
                        sizes = block.hi[own] - block.lo[own] + LENGTH
                        text = b"".join(block.text[a : a + m].tobytes() for a, m in zip(block.lo[own].tolist(), sizes.tolist(), strict=True))
                        out.append((asked["bucket"], squeezed(loose(asked["class"])[sends]), sizes.astype(np.uint8).tobytes(), zstandard.ZstdCompressor(level=3).compress(text)))
                yield pd.DataFrame(out, columns=["bucket", "class", "sizes", "text"])

    return run


def repeated(members: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """The members and texts of one bucket's classes -> which of the members' strings repeat one of a smaller
    document: a bit each."""
    if not len(members):
        return pd.DataFrame([], columns=["block", "bucket", "number", "mask"])
    numbers, docs = [loose(x) for x in members["number"]], np.concatenate([loose(x) for x in members["doc"]])
    class_of = np.concatenate([loose(x) for x in members["class"]])
    first = np.full(class_of.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, class_of, docs)
    sent = np.concatenate([loose(x) for x in texts["class"]])
    sizes = np.frombuffer(b"".join(texts["sizes"]), np.uint8).astype(np.int64)
    text = np.frombuffer(b"".join(zstandard.decompress(x) for x in texts["text"]), np.uint8)
    offsets, strings = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    base = np.cumsum(strings) - strings  # the place of each span's first string among all strings
    span = np.repeat(np.arange(len(sizes)), strings)
    shift = np.arange(len(span)) - base[span]
    starts = offsets[span] + shift
    order, lcp = suffix_array(text, starts, sizes[span] - shift)
    # the scan needs the stretches of common prefixes of LENGTH bytes only
    near = np.append(lcp >= LENGTH, False)
    kept = np.flatnonzero(near[:-1] | near[1:])
    leaf = order[kept]
    before = np.where(shift[leaf] > 0, text[starts[leaf] - 1].astype(np.int64), -1)
    groups = np.array(list(maximal(lcp[kept].tolist(), first[sent][span[leaf]].tolist(), before.tolist(), LENGTH)), dtype=np.int64).reshape(-1, 4)
    smallest = first[sent][span]  # for each string the smallest document that has it; a class is a group by itself
    length, begin, count = groups[:, 0], groups[:, 1], groups[:, 2] - groups[:, 1] + 1
    of = np.repeat(np.arange(len(groups)), count)
    at = leaf[np.repeat(begin, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)]
    for k in range(WIDTH):  # an occurrence of a repeat holds all its strings
        some = length[of] >= LENGTH + k
        np.minimum.at(smallest, at[some] + k, groups[of[some], 3])
    place = np.empty(len(first), np.int64)
    place[sent] = np.arange(len(sent))
    own = place[class_of]
    mask = np.zeros(len(docs), np.int64)
    for k in range(WIDTH):
        some = np.flatnonzero(strings[own] > k)
        mask[some] |= (smallest[base[own[some]] + k] < docs[some]).astype(np.int64) << k
    out, done = [], 0
    for block, bucket, number in zip(members["block"], members["bucket"], numbers, strict=True):
        bits = mask[done : done + len(number)]
        done += len(number)
        if bits.any():
            out.append((block, bucket, squeezed(number[bits != 0]), squeezed(bits[bits != 0])))
    return pd.DataFrame(out, columns=["block", "bucket", "number", "mask"])


def finished(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row)
                order, ends = block.buckets(n)
                masks = np.zeros(len(block.sent), np.int64)
                for answer in row["parts"] if row["parts"] is not None else []:
                    masks[order[ends[answer["bucket"]] + loose(answer["number"])]] = loose(answer["mask"])
                edge = np.zeros(len(block.text) + 1, np.int64)
                later = block.later  # a smaller document of the block has the same span
                np.add.at(edge, block.lo[later], 1)
                np.add.at(edge, block.hi[later] + LENGTH, -1)
                part = np.flatnonzero(~later & (masks[block.class_of] != 0)) if len(block.sent) else np.empty(0, int)
                for k in range(WIDTH):
                    start = block.lo[part[masks[block.class_of[part]] >> k & 1 == 1]] + k
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = []
                for doc_id, null, o, m in zip(block.ids.tolist(), block.nulls.tolist(), block.offsets.tolist(), block.sizes.tolist(), strict=True):
                    cut_, text = gone[o : o + m], block.text[o : o + m]
                    removed = int(cut_.sum())
                    runs = int(np.count_nonzero(cut_[1:] & ~cut_[:-1]) + cut_[0]) if removed else 0
                    kept = text[~cut_] if removed else text
                    out.append((None if null else doc_id, m, removed, runs, hashlib.sha256(kept.tobytes()).hexdigest()))
                pdf = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                yield pdf.astype({"doc_id": "Int64"})

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        # a fixed plan keeps the blocks' partitioning, so that answers come to them and not they to the answers
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        blocks = cut(packed(docs).repartition(partitions, "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    n = max(4 * partitions, blocks.count())  # buckets: about as large as blocks, or smaller
    sent = blocks.mapInPandas(anchors_out(n), "bucket int, block long, gram binary, span binary, ids binary, times binary")
    members = cut(sent.groupBy("bucket").applyInPandas(judged, "bucket int, block long, number binary, class binary, doc binary, sends binary"))
    per_block = members.groupBy("block").agg(F.collect_list(F.struct("bucket", "number", "class", "sends")).alias("wanted"))
    texts = blocks.join(per_block, "block", "left").mapInPandas(wanted_text(n), "bucket int, class binary, sizes binary, text binary")
    marked = members.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInPandas(repeated, "block long, bucket int, number binary, mask binary")
    per_part = cut(marked).groupBy("block").agg(F.collect_list(F.struct("bucket", "number", "mask")).alias("parts"))
    return blocks.join(per_part, "block", "left").mapInPandas(finished(n), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    return without_repeats(table(spark, sf_dir, "documents"))
