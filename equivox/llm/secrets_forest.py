"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least 16 characters of [A-Za-z0-9+/=_-] with a digit and a letter.  Its
features are its length, its characters' classes, entropy and transitions, the share that dictionary
words cover, the source it comes from (as a path), and the words beside it.  The forest is grown on
labelled findings (candidate text with its neighbourhood, path, and whether it is a secret): the
operator takes any; no table holds such labels, so the query's come from ``labelled_findings``, which
writes keys of known shapes in assignments, and look-alikes: checksums, commit ids, UUIDs, slugs,
placeholders, paths, identifiers.

Nulls and edge cases: a null text has no candidates; a null source is an empty path; each occurrence
is a row, in repeated documents too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}+")
BESIDE = 40  # characters to either side that count as neighbours
TREES, DEPTH, SEED, CUTOFF = 40, 9, 3, 0.5

# fixed values: words whose presence in a candidate or beside it tells something
DICTIONARY = "access account admin api app auth bucket build cache channel client cloud code color commit config content data default demo device document dummy element event example field file filter folder group handler hash header hidden image index input item key label layout letter list local login main manager master message model module name network node number object option order output page panel param password path placeholder policy post private product profile public query record release report request resource response result sample schema screen script search secret section select server service session setting shop source start state static status storage string style system table target task team template test text theme title token track type update upload user value version video view widget window word".split()
HOT = "key token secret password passwd pwd api apikey auth credential bearer private access aws authorization".split()
COLD = "sha sha1 sha256 md5 commit checksum digest hash uuid guid id etag revision build version example sample dummy placeholder test file path url http https image integrity rev tree request trace".split()
WORDS = [w for w in DICTIONARY if len(w) >= 4]
WORD = re.compile(r"[A-Za-z]+[0-9]{0,3}")


def features(text: str, before: str, after: str, path: str) -> list[float]:
    n, low = len(text), text.lower()
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in text]
    counts = [kinds.count(k) / n for k in range(4)]
    seen = {c: text.count(c) for c in set(text)}
    entropy = -sum(k / n * log2(k / n) for k in seen.values())
    moves = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[a * 4 + b] += 1 / n
    covered = sum(len(w) * low.count(w) for w in WORDS if w in low) / n
    left, right = [w.lower() for w in WORD.findall(before)][-4:], [w.lower() for w in WORD.findall(after)][:3]
    beside = left + right
    hashed = [0.0] * 8
    for w in beside:
        hashed[crc32(w.encode()) % 8] += 1
    tail = before.rstrip()
    return [
        n, *counts, entropy, entropy / log2(n), len(seen) / n, *moves, covered, float(all(c in "0123456789abcdef" for c in low)), float(n in (32, 40, 64)),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", low))), text.count("-") / n, text.count("_") / n, text.count("/") / n,
        float(text.startswith(("AKIA", "ghp_", "sk_", "xoxb", "AIza", "eyJ"))), max(len(r) for r in re.findall(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", text)) / n,
        sum(w in HOT for w in left), sum(w in COLD for w in left), sum(w in HOT for w in right), sum(w in COLD for w in right),
        float(tail.endswith(("=", ":", '"', "'"))), float(before[-1:] in "\"'" and before != ""), float(after[:1] in "\"'" and after != ""), float("test" in path or "example" in path), float(path.endswith((".md", ".lock", ".txt"))), crc32(path.encode()) % 16, *hashed,
    ]


def labelled_findings(n: int = 3000, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, is a secret)."""
    rng = np.random.default_rng(seed)
    pick = lambda of: of[int(rng.integers(len(of)))]
    chars = lambda of, k: "".join(of[i] for i in rng.integers(0, len(of), k))
    hexa, low, up, digit = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    prose = lambda k: " ".join(chars(low, int(rng.integers(2, 9))) for _ in range(k))
    out = []
    for _ in range(n):
        path = pick([f"src{int(rng.integers(40))}", "app/settings.py", "docs/readme.md", "tests/test_api.py", "deploy.yaml", "yarn.lock", "web.log"])
        size = pick([20, 24, 32, 40, 40, 48, 64])
        if rng.random() < 0.5:
            name = pick(HOT[:-1] + ["token", "secret", "key", "api_key", "client_secret"])
            text = pick([chars(hexa, size), chars(low + up + digit, size), chars(low + up + digit + "+/", size) + pick(["", "=", "=="]), "AKIA" + chars(up + digit, 16), "ghp_" + chars(low + up + digit, 36), "sk_live_" + chars(low + up + digit, 24), "AIza" + chars(low + up + digit + "-_", 35), "xoxb-" + chars(digit, 12) + "-" + chars(low + up + digit, 24)])
            before = prose(4) + " " + name + pick([' = "', "=", ": ", " = '", ' : "', "\": \"", "Bearer "])
            after = pick(['"', "'", "", " "]) + " " + prose(3)
            if text[:4] in ("AKIA", "ghp_", "sk_l", "AIza") and rng.random() < 0.3:
                before = prose(5) + " "
            label = 1
        else:
            words = "-".join(pick(DICTIONARY) for _ in range(int(rng.integers(3, 6)))) + pick(["-", "_", ""]) + chars(digit, int(rng.integers(1, 6)))
            camel = "".join(pick(DICTIONARY).capitalize() for _ in range(3)) + chars(digit, 2)
            uuid = "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12))
            blank = pick(["x" * 18 + "1", "0" * 20 + "a", "your-api-key-goes-here-123", "1234567890abcdef" * 2, "EXAMPLE" + "0" * 12 + "KEY", "abc123abc123abc123"])
            text = pick([chars(hexa, pick([32, 40, 64])), uuid, words, camel, blank, "2024-01-" + chars(digit, 2) + "T10-" + chars(digit, 8), chars(digit, 18) + "a", "/".join(pick(DICTIONARY) for _ in range(4)) + chars(digit, 2)])
            cold = pick(COLD)
            before = prose(4) + " " + (pick(HOT) if text == blank and rng.random() < 0.6 else cold) + pick([" ", ": ", "=", " = \"", "/"])
            after = " " + prose(3)
            if text in (words, camel) and rng.random() < 0.5:
                before = prose(5) + " "
            label = 0
        out.append((text, before[-BESIDE:], after[:BESIDE], path, label))
    return out


class Forest:
    """Trees of (feature, threshold, left, right, share) nodes; each is grown on a bootstrap sample with
    a random choice of features at each node, by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            own = rng.integers(0, len(x), len(x))
            nodes: list[tuple] = []
            self.grow(x[own], y[own], depth, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list[tuple]) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, float(y.mean()) if len(y) else 0.5))
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False).tolist():
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            k = at + 1.0
            left, right = ones[at] / k, (ones[-1] - ones[at]) / (len(y) - k)
            cost = k * left * (1 - left) + (len(y) - k) * right * (1 - right)
            c = int(np.argmin(cost))
            if cost[c] < best[0]:
                best = (cost[c], f, float(v[at[c]] + v[at[c] + 1]) / 2)
        if best[1] < 0:
            return me
        low = x[:, best[1]] <= best[2]
        a = self.grow(x[low], y[low], depth - 1, rng, nodes)
        b = self.grow(x[~low], y[~low], depth - 1, rng, nodes)
        nodes[me] = (best[1], best[2], a, b, nodes[me][4])
        return me

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.where(inner, feature[at], 0)
                step = np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at])
                at = np.where(inner, step, at)
            total += share[at]
        return total / len(self.trees)


def fit(findings: list[tuple[str, str, str, str, int]]) -> Forest:
    x = np.array([features(*f[:4]) for f in findings])
    return Forest(x, np.array([f[4] for f in findings], dtype=float))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit(labelled_findings())


def candidates(text: str) -> Iterator[tuple[int, str]]:
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            yield m.start(), run


def scan(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> a row for each candidate: doc_id, start, candidate, score, is_secret."""
    forest = forest or default_forest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, xs = [], []
            for doc_id, text, source in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["source"], strict=True):
                for start, run_ in candidates(text) if text else ():
                    rows.append((doc_id, start, run_))
                    xs.append(features(run_, text[max(0, start - BESIDE) : start], text[start + len(run_) : start + len(run_) + BESIDE], source or ""))
            if rows:
                score = np.round(forest(np.array(xs)), 6)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "candidate"]).astype({"doc_id": "Int64"})
                yield out.assign(score=score, is_secret=score >= CUTOFF)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return plain.mapInPandas(run, "doc_id long, start long, candidate string, score double, is_secret boolean")


def op2(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    return scan(table(spark, sf_dir, "documents"))
