"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is what the vocabulary's own library gives, without building identifiers: the
text is cut at special strings (one token each, as the library does by default) and by the
byte-level pre-tokenizer's pattern; each piece starts as its bytes, a heap yields the adjacent pair
of lowest rank (leftmost first), the pair becomes one symbol of a doubly linked list, and the count
is bytes minus merges.  Counts of short pieces are kept in a bounded table for each worker.

Nulls and edge cases: a null text is empty (0 bytes, 0 tokens); repeated rows and null doc_ids stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 400_000  # pieces whose counts a worker keeps
KEPT_LENGTH = 48


def byte_alphabet() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte: printable Latin-1
    bytes are themselves, the rest are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class PieceCounts(dict):
    """piece -> number of tokens.  Symbols are numbers here, and a pair of them one number, only so
    that looking up and heaping is cheap; no identifier leaves this class."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        super().__init__()
        self.pairs = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault(vocabulary[a] << 32 | vocabulary[b], (rank << 32, vocabulary[a + b]))
        self.byte = [vocabulary[c] for _, c in sorted(byte_alphabet().items())]

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode("utf-8", "surrogatepass"))
        if len(self) < KEPT and len(piece) <= KEPT_LENGTH:
            self[piece] = n
        return n

    def count(self, piece: bytes) -> int:
        pair, byte = self.pairs.get, self.byte
        sym = [byte[b] for b in piece]
        n = len(sym)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            if (got := pair(sym[i] << 32 | sym[i + 1])) is not None:
                heap.append(got[0] | i)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j < 0:
                continue  # the symbol has been merged meanwhile, or is the last
            got = pair(sym[i] << 32 | sym[j])
            if got is None or got[0] | i != top:
                continue  # its neighbour has changed meanwhile
            sym[i] = new = got[1]
            left -= 1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (got := pair(new << 32 | sym[k])) is not None:
                    heappush(heap, got[0] | i)
            h = before[i]
            if h >= 0 and (got := pair(sym[h] << 32 | new)) is not None:
                heappush(heap, got[0] | h)
        return left


def ranges(wanted: str, limit: int) -> str:
    """The inside of a character class: the characters up to limit of a general category."""
    out, start = [], -1
    for c in range(limit + 2):
        is_in = c <= limit and unicodedata.category(chr(c))[0] == wanted
        if is_in and start < 0:
            start = c
        elif not is_in and start >= 0:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = -1
    return "".join(out)


@lru_cache(maxsize=3)
def byte_level_pattern(limit: int) -> re.Pattern:
    """The byte-level pre-tokenizer's pattern for the re module, which has no \\p, for texts with no
    character above limit (small classes match faster): letters with a space before them come
    first, as nothing else can start that way."""
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" if limit > 255 else r"\t-\r \x85\xa0"
    letter, number = ranges("L", limit), ranges("N", limit)
    return re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_level_pieces(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        limit = 0xFF
    except UnicodeEncodeError:
        limit = 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
    return byte_level_pattern(limit).findall(text)


class Counter:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.counts = PieceCounts(model["model"]["vocab"], merges)
        self.marks = [t["content"] for t in model.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))))
        self.pieces = re.compile(pattern).findall if pattern else byte_level_pieces

    def __call__(self, text: str) -> int:
        of = self.counts.__getitem__
        if not any(mark in text for mark in self.marks):
            return sum(map(of, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(of, self.pieces(part))) for part in parts)


@lru_cache(maxsize=2)
def counter(vocabulary: str, pattern: str) -> Counter:
    import public_tokenizers

    return Counter(public_tokenizers.path(vocabulary), pattern)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, pattern: str = "") -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit).  pattern: the
    pre-tokenizer's, if not the one that goes with the vocabularies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            n = pd.Series([count(t) for t in texts], dtype="int64")
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return plain.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    return token_counts(table(spark, sf_dir, "documents"))
