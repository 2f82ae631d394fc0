"""Lexicon back ends: pairs of heads to similarities.  Each distinct pair is looked up once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TOKEN = 4
EXCLUDED_KINDS = ("code",)
# fixed values: semantic types whose concepts are trusted by default, those of clinical things
SEMANTIC_TYPES = tuple(
    "T004 T005 T007 T017 T018 T019 T020 T021 T022 T023 T024 T025 T026 T029 T030 T031 T032 T033 T034 T037 "
    "T038 T039 T040 T041 T042 T043 T044 T045 T046 T047 T048 T049 T050 T058 T059 T060 T061 T062 T063 T065 "
    "T074 T075 T103 T104 T109 T114 T116 T120 T121 T122 T123 T125 T126 T127 T129 T130 T131 T184 T190 T191 "
    "T192 T195 T196 T197 T200 T201 T204".split()
)


def concepts(terms: DataFrame, min_token: int = MIN_TOKEN, excluded: tuple[str, ...] = EXCLUDED_KINDS) -> DataFrame:
    """terms(norm, concept_id, kind...) -> (norm, concepts)."""
    kept = terms.where((F.length("norm") >= min_token) & ~F.col("kind").isin(*excluded))
    return kept.groupBy("norm").agg(F.collect_set("concept_id").alias("concepts"))


def concept_similarity(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs(a, b) -> (a, b, sim): 1 where the concept sets meet, 0 where not, null where one is unknown."""
    a = of.select(F.col("norm").alias("a"), F.col("concepts").alias("ca"))
    b = of.select(F.col("norm").alias("b"), F.col("concepts").alias("cb"))
    rows = pairs.select("a", "b").distinct().join(a, "a", "left").join(b, "b", "left")
    return rows.select("a", "b", F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), F.arrays_overlap("ca", "cb").cast("double")).alias("sim"))


WORDS = 400  # lexicons of up to so many words are looked up by all their pairs


def known_pairs(of: DataFrame) -> DataFrame | None:
    """(a, b, sim) for all pairs a < b of a short lexicon, to be broadcast; null for a longer one, whose pairs have to come
    from the texts."""
    if of.count() > WORDS:
        return None
    a, b = of.select(F.col("norm").alias("a"), F.col("concepts").alias("ca")), of.select(F.col("norm").alias("b"), F.col("concepts").alias("cb"))
    return F.broadcast(a.crossJoin(b).where("a < b").select("a", "b", F.arrays_overlap("ca", "cb").cast("double").alias("sim")))


def join_concepts(str2cui: DataFrame, cui2sty: DataFrame, allowed: tuple[str, ...] | list[str] = SEMANTIC_TYPES, min_token: int = MIN_TOKEN) -> DataFrame:
    """(norm, cui): strings with a concept of an allowed semantic type."""
    kept = cui2sty.where(F.col("tui").isin(*allowed)).select("cui").distinct()
    return str2cui.where(F.length("norm") >= min_token).join(kept, "cui", "left_semi").select("norm", "cui").distinct()


def path_similarity(pairs: DataFrame, synsets: DataFrame, hypernyms: DataFrame, senses: int = 6, depth: int = 20) -> DataFrame:
    """Over a taxonomy: synsets(lemma, rank, id), hypernyms(child, parent).  1 for equal words, null if one
    is unknown, else the largest 1 / (1 + steps) over the first senses of both, 0 without a path."""
    spark = pairs.sparkSession
    hypernyms.createOrReplaceTempView("_hyper")
    synsets.where(F.col("rank") <= senses).createOrReplaceTempView("_syn")
    up = spark.sql(f"""
        with recursive up(id, top, d) as (
          select distinct id, id, 0 from _syn
          union all
          select up.id, h.parent, up.d + 1 from up join _hyper h on h.child = up.top where up.d < {depth})
        select id, top, min(d) as d from up group by id, top""")
    of = lambda name: synsets.where(F.col("rank") <= senses).select(F.col("lemma").alias(name), F.col("id").alias(f"i{name}"))
    known = synsets.select("lemma").distinct()
    rows = pairs.select("a", "b").distinct()
    ka, kb = known.select(F.col("lemma").alias("a"), F.lit(True).alias("ka")), known.select(F.col("lemma").alias("b"), F.lit(True).alias("kb"))
    ua = up.select(F.col("id").alias("ia"), "top", F.col("d").alias("da"))
    ub = up.select(F.col("id").alias("ib"), "top", F.col("d").alias("db"))
    near = rows.join(of("a"), "a").join(of("b"), "b").join(ua, "ia").join(ub, ["ib", "top"]).groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("steps"))
    out = rows.join(ka, "a", "left").join(kb, "b", "left").join(near, ["a", "b"], "left")
    sim = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("ka") & F.col("kb"), F.coalesce(1 / (1 + F.col("steps")), F.lit(0.0)))
    return out.select("a", "b", sim.alias("sim"))


def fuzzy_concepts(words: DataFrame, aliases: DataFrame, top: int = 5, least: float = 0.85) -> DataFrame:
    """words(norm), aliases(alias, concept_id) -> (norm, concept_id): aliases that share at least `least` of
    their letter trigrams (Dice).  Candidates come from an equi join on trigrams."""
    from pyspark.sql.window import Window

    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 0), lambda i: F.substring(F.concat(F.lit(" "), c, F.lit(" ")), i, 3)))
    w = words.select("norm").distinct().select("norm", grams(F.col("norm")).alias("g"))
    a = aliases.select("alias", "concept_id", grams(F.col("alias")).alias("h"))
    both = w.select("norm", F.size("g").alias("n"), F.explode("g").alias("t")).join(a.select("alias", "concept_id", F.size("h").alias("m"), F.explode("h").alias("t")), "t")
    scored = both.groupBy("norm", "alias", "concept_id").agg((2 * F.count("*") / (F.first("n") + F.first("m"))).alias("sim")).where(F.col("sim") >= least)
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("sim"), "alias", "concept_id")))
    return ranked.where(F.col("_n") <= top).select("norm", "concept_id").distinct()


def chain(pairs: DataFrame, *backends) -> DataFrame:
    """Each back end maps pairs to (a, b, sim); the first that knows a pair decides it, and later ones are
    asked only about pairs that are still unknown."""
    left, done = pairs.select("a", "b").distinct(), None
    for backend in backends:
        got = backend(left)
        known = got.where("sim is not null")
        done = known if done is None else done.unionByName(known)
        left = got.where("sim is null").select("a", "b")
    return done.unionByName(left.withColumn("sim", F.lit(None).cast("double")))
