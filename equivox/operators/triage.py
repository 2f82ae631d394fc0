"""Explainable signals that a sentence may be ambiguous, and their score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the lexicon
OBLIGATION = ("shall", "must", "required", "requires", "mandatory")
RECOMMENDATION = ("should", "recommended", "encouraged", "discouraged")
PERMISSION = ("may", "optional", "can", "optionally", "permitted", "allowed")
VAGUE = (
    "appropriate", "as appropriate", "as needed", "as necessary", "as required", "if applicable", "if present", "if necessary", "where appropriate",
    "some", "certain", "sufficient", "adequate", "reasonable", "suitable", "typically", "generally", "normally", "usually", "in general", "and so on",
    "etc", "such as", "among others", "including but not limited to", "may be", "might be", "could be", "as defined elsewhere", "unspecified",
)
ANAPHORS = ("it", "its", "they", "them", "their", "these", "those", "this", "that", "such", "former", "latter")
PHRASES = ("this value", "the above", "the former", "the latter", "the following", "said value", "the same")


@dataclass(frozen=True)
class Weights:
    modal: float = 3.0
    weak: float = 1.2
    vague: float = 1.0
    vague_cap: int = 4
    coordination: float = 2.5
    passive: float = 2.0
    anaphora: float = 2.5
    phrase: float = 1.5


def word(terms) -> str:
    """A pattern for any of the terms as whole words, longest first."""
    return r"(?iU)\b(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + r")\b"


def plain(terms) -> str:
    """The same for lower case, with boundaries as SQL has them: only ASCII letters, digits and _ continue a word."""
    return r"(?<![a-zA-Z0-9_])(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + r")(?![a-zA-Z0-9_])"


PASSIVE, PLAIN_PASSIVE = r"(?iU)\b(?:is|are|was|were|be|been|being)\s+\w+ed\b", r"(?<![a-zA-Z0-9_])(?:is|are|was|were|be|been|being)[ \t\n\f\r]+[a-zA-Z0-9_]+ed(?![a-zA-Z0-9_])"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z']+"), lambda w: w != "")


def one_of(tokens: Column, terms) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))


def hits(tokens: Column, terms) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda w: w.isin(*terms))))


def modal(text: Column, w: Weights, split: Column | None = None) -> tuple[Column, Column]:
    t = words(text) if split is None else split
    classes = {"obligation": OBLIGATION, "recommendation": RECOMMENDATION, "permission": PERMISSION}
    n = sum(one_of(t, terms).cast("int") for terms in classes.values())
    points = F.when(n >= 2, w.modal).when(one_of(t, RECOMMENDATION), w.weak).otherwise(0.0)
    reasons = F.filter(F.array(*[F.when(one_of(t, terms), F.concat(F.lit(f"{name}: "), F.array_join(hits(t, terms), ", "))) for name, terms in classes.items()]), lambda r: r.isNotNull())
    return points, reasons


def vague_words(text: Column, word=word) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(word(VAGUE)), F.lit(0)), F.lower)


def vague(text: Column, w: Weights, found: Column | None = None) -> tuple[Column, Column]:
    found = vague_words(text) if found is None else found
    points = (F.least(F.size(found), F.lit(w.vague_cap)) * w.vague).cast("double")
    return points, F.array(F.concat(F.size(found).cast("string"), F.lit(" vague: "), F.array_join(F.array_sort(F.array_distinct(found)), ", ")))


def coordination(text: Column, w: Weights, tokens: Column | None = None, word=word) -> tuple[Column, Column]:
    """Both conjunctions; with tokens also a modifier after the last conjunct and three or more conjuncts."""
    both = text.rlike(word(["and"])) & text.rlike(word(["or"]))
    points, reasons = F.when(both, w.coordination).otherwise(0.0), [F.when(both, F.lit("and with or"))]
    if tokens is not None:
        conj = F.filter(tokens, lambda t: t["dep"] == "conj")
        last = F.array_max(F.transform(conj, lambda t: t["i"]))
        tail = F.coalesce(F.exists(tokens, lambda t: t["dep"].isin("prep", "relcl", "acl") & (t["i"] > last)), F.lit(False))
        many = F.coalesce(F.size(conj) >= 3, F.lit(False))
        points = points + F.when(tail, 1.5).otherwise(0.0) + F.when(many, 1.0).otherwise(0.0)
        reasons += [F.when(tail, F.lit("modifier after the last conjunct")), F.when(many, F.lit("three or more conjuncts"))]
    return points, F.filter(F.array(*reasons), lambda r: r.isNotNull())


def passive(text: Column, w: Weights, tokens: Column | None = None, word=word) -> tuple[Column, Column]:
    """A passive without an actor; without tokens by rule: a form of be, then a word in -ed, and no 'by'."""
    if tokens is None:
        form = text.rlike(PLAIN_PASSIVE if word is plain else PASSIVE) & ~text.rlike(word(["by"]))
    else:
        has = F.exists(tokens, lambda t: t["dep"].isin("nsubjpass", "auxpass"))
        actor = F.exists(tokens, lambda t: (t["dep"] == "agent") | ((F.lower(t["text"]) == "by") & (t["dep"] == "prep")))
        form = F.coalesce(has & ~actor, F.lit(False))
    return F.when(form, w.passive).otherwise(0.0), F.array(F.lit("passive without an actor"))


def anaphora(text: Column, w: Weights, tokens: Column | None = None, chunks: Column | None = None, word=word) -> tuple[Column, Column]:
    """A pronoun with two or more possible antecedents (needs tokens and chunks), else a referential phrase."""
    phrase = text.rlike(word(PHRASES))
    weak = F.when(phrase, w.phrase).otherwise(0.0)
    if tokens is None:
        return weak, F.array(F.lit("referential phrase"))
    named = F.filter(chunks, lambda c: c["root_pos"].isin("NOUN", "PROPN"))

    def open_(t: Column) -> Column:
        before = F.array_distinct(F.transform(F.filter(named, lambda c: c["root_i"] < t["i"]), lambda c: c["root_text"]))
        return F.lower(t["text"]).isin(*ANAPHORS) & t["pos"].isin("PRON", "DET") & (F.size(before) >= 2)

    strong = F.coalesce(F.exists(tokens, open_), F.lit(False))
    return F.when(strong, w.anaphora).otherwise(weak), F.array(F.when(strong, F.lit("several antecedents")).otherwise(F.lit("referential phrase")))


def signals(text: Column, w: Weights = Weights(), tokens: Column | None = None, chunks: Column | None = None, split: Column | None = None, found: Column | None = None, word=word) -> dict[str, tuple[Column, Column]]:
    """split and found: the text's words and vague words where they are at hand; word makes patterns of terms."""
    return {"modal_inconsistency": modal(text, w, split), "vague": vague(text, w, found), "coordination": coordination(text, w, tokens, word), "passive_no_actor": passive(text, w, tokens, word), "anaphora": anaphora(text, w, tokens, chunks, word)}


def score(df: DataFrame, text: str = "text", w: Weights = Weights(), tokens: str | None = None, chunks: str | None = None, ascii_words: bool = False) -> DataFrame:
    """df with a column of points for each signal, signals (those that fired) and score, their sum.  With
    ascii_words words end as they do in SQL, where letters beyond ASCII are no part of a word."""
    own = plain if ascii_words else word
    read = F.col("_low") if ascii_words else F.col(text)
    df = df.withColumn("_low", F.lower(text)) if ascii_words else df
    df = df.withColumns({"_split": words(read), "_vague": vague_words(read, own)})  # once for points and reasons
    found = signals(read, w, F.col(tokens) if tokens else None, F.col(chunks) if chunks else None, F.col("_split"), F.col("_vague"), own)
    df = df.withColumns({f"{name}_points": points.cast("double") for name, (points, _) in found.items()})
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.round(F.col(f"{name}_points"), 3).alias("points"), reasons.alias("reasons")) for name, (_, reasons) in found.items()])
    total = sum((F.col(f"{name}_points") for name in found), F.lit(0.0))
    return df.withColumns({"signals": F.filter(entries, lambda e: e["points"] > 0), "score": total}).drop("_low", "_split", "_vague")


def top(df: DataFrame, n: int = 200, score: str = "score", order: tuple = ("uid",)) -> DataFrame:
    return df.orderBy(F.desc(score), *order).limit(n)
