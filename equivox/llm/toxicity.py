"""Toxicity by noisy-channel deobfuscation.

Reading: tokens that are not plain words (leetspeak, letters drawn out, letters set apart by spaces or
marks) become lattices of what each character may stand for, and a Viterbi search finds the most
likely spelling under a character trigram model and a price for each disguise.  Plain words have a
single spelling and pass as they are.  The trigram model counts every text of the corpus.

Scoring: a logistic model on which words of a lexicon occur in the restored text.  Lexicon and
weights are fitted on labelled rows that are not held out (crc32 of doc_id as text, modulo 4, is not
2), on at most ``FIT_ROWS`` of them, those of smallest hash; the words are those whose log odds
between toxic and other rows stand out most.  Nothing but the text enters a score.

Nulls and edge cases: a null text is empty and gets the score of a text without lexicon words; with no
usable labels every score is the smoothed base rate (one half); labels with a null id or a null mark
are left out; a doc_id with several labels counts as toxic if one says so; repeated rows are scored
each; null doc_ids are not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivox.llm.session import cut

FIT_ROWS = 12_000
LEXICON = 400
CUTOFF = 0.3
REMEMBERED = 200  # spellings of longer tokens are found anew each time, so that the table stays small

# fixed values: what a character may stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
APART = " .-_*~·'`"
SWAP, THIN, JOIN, KEEP = -1.5, -0.7, -0.7, -7.0  # prices of the disguises, and of leaving a mark as it is

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
SIZE = len(LETTERS) + 2  # 0: not a letter; then LETTERS; last: any other letter
CODE = {c: k + 1 for k, c in enumerate(LETTERS)}

DRAWN = re.compile(r"(\w)\1\1")
SPACED = re.compile(r"(?<![^\W_])[^\W_](?: [^\W_]){3,}(?![^\W_])")
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡€£¥·"


def table() -> np.ndarray:
    """Codes of all characters up to U+FFFF."""
    codes = np.array([SIZE - 1 if chr(c).isalpha() else 0 for c in range(1 << 16)], dtype=np.int64)
    for c, k in CODE.items():
        codes[ord(c)] = k
    return codes


@lru_cache(maxsize=1)
def codes() -> np.ndarray:
    return table()


def trigrams(text: str) -> np.ndarray:
    """Numbers of all trigrams of the text in lower case."""
    points = np.frombuffer(("  " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = codes()[np.minimum(points, 0xFFFF)]
    return (k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that little is held besides them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def corpus_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), shape SIZE^3, from all texts: counted in each partition, summed by trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in pieces(batches):
            texts = [t for t in batch.column(0).to_pylist() if t]
            for at in range(0, len(texts), 50):  # joined, as the breaks between texts are breaks between words
                total += np.bincount(trigrams("  ".join(texts[at : at + 50])), minlength=SIZE**3)
        found = np.flatnonzero(total)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["k", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows["k"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    counts = counts.reshape(SIZE, SIZE, SIZE)
    two = counts.sum(0)
    one = two.sum(0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (counts + 10 * p2[None]) / (counts.sum(2, keepdims=True) + 10)
    return np.log(p3).astype(np.float32)


def spelled(way: tuple) -> str:
    parts = []
    while way:
        way, string = way
        parts.append(string)
    return "".join(reversed(parts))


class Restorer:
    """Finds the plain spelling of disguised tokens; spellings are remembered in a bounded table."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.short = lru_cache(maxsize=100_000)(self.viterbi)

    def spell(self, token: str) -> str:
        return self.short(token) if len(token) <= REMEMBERED else self.viterbi(token)

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character what it may stand for, with its price."""
        out = []
        runs = [(c, len(list(g))) for c, g in groupby(token)]
        inner = lambda k: 0 < k < len(runs) - 1
        for k, (c, n) in enumerate(runs):
            if c.isalpha():
                options = [(c * n, 0.0)] if n < 3 else [(c, THIN), (c * 2, THIN)]
            elif c in LEET:
                options = [(x * m, SWAP * m + THIN * (n > m)) for x in LEET[c] for m in ({1, 2} if n > 1 else {1})]
                options.append((" " if c == " " else "0", KEEP))
            elif c in APART and inner(k):
                options = [("", JOIN), (" ", 2 * JOIN if c == " " else KEEP)]
            else:
                options = [(" ", KEEP)]
            out.append(options)
        return out

    def viterbi(self, token: str) -> str:
        model, code = self.model, CODE.get
        best: dict = {(0, 0): (0.0, ())}  # with the way back: (way to the state before, string added)
        for options in self.lattice(token):
            reached: dict = {}
            for (a, b), (score, so_far) in best.items():
                for string, price in options:
                    x, y, total = a, b, score + price
                    for c in string:
                        z = code(c, SIZE - 1 if c.isalpha() else 0)
                        total += model[x][y][z]
                        x, y = y, z
                    if (x, y) not in reached or total > reached[x, y][0]:
                        reached[x, y] = (total, (so_far, string))
            best = reached
        ends = [(score + model[a][b][0], way) for (a, b), (score, way) in best.items()]
        top = max(score for score, _ in ends)
        return max(spelled(way) for score, way in ends if score == top)

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        low = text.lower()
        if SPACED.search(low):
            low = SPACED.sub(lambda m: self.spell(m[0]), low)
        tokens = set(low.split())
        plain = {t for t in tokens if t.isalpha()}
        drawn = {t for t in plain if DRAWN.search(t)} if DRAWN.search(low) else set()
        out = plain - drawn
        for t in (tokens - plain) | drawn:
            core = t.strip(MARKS)
            if core.isalpha() and t not in drawn and not (t[0] in "$@" and t[1:2] == core[:1]) and not DRAWN.search(core):
                out.add(core)
            elif any(c.isalpha() for c in core):
                front = t[0] if t[0] in "$@" and t[1:2].isalnum() else ""
                out.update(w for w in re.findall(r"[^\W\d_]+", self.spell(front + core)))
                out.update(re.findall(r"[^\W\d_]+", core))
        return out


def trained(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    return known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, rows: int) -> tuple[dict[str, float], float]:
    """The lexicon's weights and the bias."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "words": [sorted(restorer.words(t or "")) for t in batch["text"]]})

    chosen = trained(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct().repartition(12)
    seen = cut(texts.mapInPandas(read, "toxic int, words array<string>"))
    n = {r[0]: r[1] for r in seen.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), sum(n.values()) - n.get(1, 0)
    base = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return {}, base
    each = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    odds = lambda k, of: F.log((k + 0.5) / (of - k + 0.5))
    a, b = F.col("a"), F.col("n") - F.col("a")
    z = (odds(a, F.lit(n1)) - odds(b, F.lit(n0))) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
    picked = [r["word"] for r in each.where("n >= 4").withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "word").limit(LEXICON).collect()]
    known = F.array(*[F.lit(w) for w in picked]) if picked else F.array().cast("array<string>")
    hits = seen.select("toxic", F.array_intersect("words", known).alias("words")).groupBy("toxic", "words").count().collect()
    index = {w: k for k, w in enumerate(picked)}
    x, y, times = np.zeros((len(hits), len(picked))), np.zeros(len(hits)), np.zeros(len(hits))
    for k, row in enumerate(sorted(hits, key=lambda r: (r["toxic"], sorted(r["words"])))):
        x[k, [index[w] for w in row["words"]]] = 1
        y[k], times[k] = row["toxic"], row["count"]
    w, bias = np.zeros(len(picked)), base
    for _ in range(400):  # gradient steps on the penalised likelihood
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        pull = times * (p - y)
        w -= 0.5 * (x.T @ pull + 0.5 * w) / (0.25 * (x.T @ times) + 0.5 + 1e-9)
        bias -= 0.5 * pull.sum() / (0.25 * times.sum() + 1e-9)
    return dict(zip(picked, np.round(w, 6).tolist(), strict=True)), float(bias)


def scorer(docs: DataFrame, labels: DataFrame, fit_rows: int):
    """A function from texts to scores, to be shipped to the workers."""
    model = corpus_model(docs)
    weights, bias = fit(docs, labels, model, fit_rows)

    def score(texts: list[str | None], made: list) -> np.ndarray:
        if not made:
            made.append(Restorer(model))
        of = weights.get
        sums = [bias + sum(of(w, 0.0) for w in sorted(made[0].words(t) & weights.keys())) if t else bias for t in texts]
        return 1 / (1 + np.exp(-np.array(sums, dtype=float)))

    return score


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted)."""
    score = scorer(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list = []
        for batch in pieces(batches):
            p = score(batch.column(2).to_pylist(), made)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
    plain = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows whose score reaches the cutoff."""
    score, at = scorer(docs, labels, fit_rows), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list = []
        for batch in pieces(batches):
            yield batch.filter(pa.array(score(batch.column(at).to_pylist(), made) < CUTOFF))

    return docs.mapInArrow(run, docs.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    from equivox.llm import session

    return scores(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "labels"))
