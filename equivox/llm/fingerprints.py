"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines that are not blank) get digests: 40 bits of their XXH64 and 24 bits of a
hash of those, so that a digest carries its own check.  The sketch of the set of digests has three
tables of cells, each the xor of the digests that fall into it; a digest falls into one cell of each
table.  The sketches of two versions subtract by xor, cell by cell: common paragraphs vanish.  What is
left is peeled: a cell whose content passes the check is a single digest; it is recovered and taken out
of the other tables.  If cells remain, the difference was too large for the sketch, and the versions
are sketched again, larger: digests are parted by hash into groups of bounded size, with 48, then 192,
then 768 cells a group; a group that still fails (digests that collide in all tables, three times over) is settled by
the difference of its two sets, so every difference is found whole.  (A wrong content passes the check once in 2^24
cells.)

Likeness of two versions is the Jaccard index of their paragraph sets: with a and b paragraphs and d
recovered differences (a + b - d) / (a + b + d), and 1 for two texts without paragraphs.

Everything is expressed in array functions of one row, so nothing is shuffled but the texts, once, to
bring each to its successor by doc_id.  Digests are parted into groups in three steps, each by one digit of the
group's number, so a text of n lines takes about n^(4/3) steps.

Nulls and edge cases: a null text is empty; equal texts have equal fingerprints, and so have texts
with the same set of paragraphs; rows with a null doc_id come first; rows of one doc_id follow each
other in the order of their texts; an only document is its own successor; very long texts are read whole; an
empty table gives an empty result; other columns are ignored.  ``decoded`` tells whether sketches alone recovered the
differences of both comparisons; the differences are whole either way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMALL = 12  # cells in each table of the published sketch
LOAD = 16  # digests in a group of a larger sketch, on average
LARGER = (16, 64, 256)  # cells in each table of a group, one retry after the other; then the sets themselves
ROUNDS = 15  # each empties one table


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def check(bits: Column) -> Column:
    return F.xxhash64(F.call_function("shiftrightunsigned", bits, F.lit(24))).bitwiseAND(F.lit(0xFFFFFF))


def digests(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    bits = F.transform(lines, lambda p: F.xxhash64(p).bitwiseAND(F.lit(-(1 << 24))))
    return F.array_distinct(F.transform(bits, lambda b: b.bitwiseOR(check(b))))


def place(digest: Column, number: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(digest, number), F.lit(cells)).cast("int")


def sketch(of: Column, cells: int, salt: int) -> Column:
    """The three tables of the sketch of an array of digests: array<array<bigint>>."""

    def table(number: Column) -> Column:
        def fill(placed: Column) -> Column:
            def one(i: Column) -> Column:
                return F.aggregate(placed, F.lit(0).cast("long"), lambda acc, e: F.when(e["p"] == i, acc.bitwiseXOR(e["x"])).otherwise(acc))

            return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), one)

        return let(F.transform(of, lambda x: F.struct(place(x, number, cells).alias("p"), x.alias("x"))), fill)

    return F.transform(F.sequence(F.lit(salt), F.lit(salt + 2)), table)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)))


def single(c: Column) -> Column:
    return (c != 0) & (check(c) == c.bitwiseAND(F.lit(0xFFFFFF)))


def peel(tables: Column, cells: int, salt: int) -> Column:
    """struct(ok, found array<bigint>): the digests that only one of the versions has.  Each step empties
    the single cells of one table, the next one in turn, so that no digest is taken twice."""
    start = let(tables, lambda t: F.struct(F.get(t, F.lit(0)).alias("x"), F.get(t, F.lit(1)).alias("y"), F.get(t, F.lit(2)).alias("z"), F.array().cast("array<bigint>").alias("found")))

    def step(s: Column, turn: Column) -> Column:
        def out(pure: Column) -> Column:
            def without(table: Column, later: int) -> Column:
                number = F.lit(salt) + (turn + later) % 3

                def use(placed: Column) -> Column:
                    def one(c: Column, i: Column) -> Column:
                        return F.aggregate(placed, c, lambda acc, e: F.when(e["p"] == i, acc.bitwiseXOR(e["x"])).otherwise(acc))

                    return F.transform(table, one)

                return let(F.transform(pure, lambda x: F.struct(place(x, number, cells).alias("p"), x.alias("x"))), use)

            rest = F.transform(s["x"], lambda c: F.when(single(c), F.lit(0).cast("long")).otherwise(c))
            turned = F.struct(without(s["y"], 1).alias("x"), without(s["z"], 2).alias("y"), rest.alias("z"), F.concat(s["found"], pure).alias("found"))
            same = F.struct(s["y"].alias("x"), s["z"].alias("y"), s["x"].alias("z"), s["found"].alias("found"))
            return F.when(F.size(pure) > 0, turned).otherwise(same)

        return let(F.filter(s["x"], single), out)

    empty = lambda t: F.forall(t, lambda c: c == 0)
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return let(done, lambda s: F.struct((empty(s["x"]) & empty(s["y"]) & empty(s["z"])).alias("ok"), s["found"].alias("found")))


def small_sketch(of: Column) -> Column:
    return sketch(of, SMALL, 0)


def decode_small(a: Column, b: Column) -> Column:
    """Of two published sketches."""
    return peel(subtract(a, b), SMALL, 0)


def parted(a: Column, b: Column) -> Column:
    """Two arrays of digests -> the pairs (a, b) of their groups by hash, of LOAD digests on average; digits of the
    digests' group numbers are split off one by one."""
    fan = F.greatest(F.ceil(F.pow((F.size(a) + F.size(b)) / F.lit(LOAD), F.lit(1 / 3)) - 1e-9), F.lit(1)).cast("int")
    numbered = lambda of: F.transform(of, lambda x: F.struct(F.pmod(F.xxhash64(x, F.lit(50)), fan * fan * fan).cast("int").alias("g"), x.alias("x")))
    parts = F.array(F.struct(numbered(a).alias("a"), numbered(b).alias("b")))

    def digit(part: Column, unit: Column) -> Column:
        own = lambda of, k: F.filter(of, lambda e: F.floor(e["g"] / unit) % fan == k)
        return F.transform(F.sequence(F.lit(0), fan - 1), lambda k: F.struct(own(part["a"], k).alias("a"), own(part["b"], k).alias("b")))

    for unit in (fan * fan, fan, F.lit(1)):
        parts = F.flatten(F.transform(parts, lambda p: digit(p, unit)))  # noqa: B023
    plain = lambda of: F.transform(of, lambda e: e["x"])
    return F.transform(parts, lambda p: F.struct(plain(p["a"]).alias("a"), plain(p["b"]).alias("b")))


def decode_large(parts: Column) -> Column:
    """Of the pairs of groups of two arrays of digests, by larger sketches; a group that fails goes on to the next
    size alone, and at last to the difference of its sets."""

    def tried(pair: Column, rung: int) -> Column:
        if rung == len(LARGER):
            return F.struct(F.lit(False).alias("ok"), F.concat(F.array_except(pair["a"], pair["b"]), F.array_except(pair["b"], pair["a"])).alias("found"))
        cells, salt = LARGER[rung], 100 * (rung + 1)
        result = peel(subtract(sketch(pair["a"], cells, salt), sketch(pair["b"], cells, salt)), cells, salt)
        return let(result, lambda r: F.when(r["ok"], r).otherwise(tried(pair, rung + 1)))

    done = F.transform(parts, lambda pair: tried(pair, 0))
    return let(done, lambda p: F.struct(F.forall(p, lambda r: r["ok"]).alias("ok"), F.flatten(F.transform(p, lambda r: r["found"])).alias("found")))


@lru_cache(maxsize=2)
def expressions(application: str) -> tuple[dict[str, Column], ...]:
    """The sketches of a, b and c; the comparisons ab and ac of published sketches; the groups of those that fail;
    and the results, structs (ok, found).  They are long, so they are built once, and are resolved step by step."""
    small = {f"small_{x}": decode_small(F.col("sa"), F.col(f"s{x}")) for x in "bc"}
    parts = {f"parts_{x}": F.when(~F.col(f"small_{x}")["ok"], parted(F.col("a"), F.col(x))) for x in "bc"}
    results = {f"a{x}": F.when(F.col(f"small_{x}")["ok"], F.col(f"small_{x}")).otherwise(decode_large(F.col(f"parts_{x}"))) for x in "bc"}
    return {f"s{x}": small_sketch(F.col(x)) for x in "abc"}, small, parts, results


def likeness(a: str, b: str, result: str) -> Column:
    both = F.size(a) + F.size(b)
    d = F.size(F.col(result)["found"])
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d)).cast("double")


def written(s: Column) -> Column:
    """The sketch as text: its cells in base 64."""
    return F.base64(F.unhex(F.concat_ws("", F.transform(F.flatten(s), lambda c: F.lpad(F.hex(c), 16, "0")))))


def bucketed(docs: DataFrame, per_bucket: int) -> DataFrame:
    """docs with bucket: ranges of doc_id of about equal numbers of rows, by quantiles of all ids."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = docs.select("doc_id").count()
    buckets = max(1, min(4 * parts, n // per_bucket))
    if buckets == 1:
        return docs.withColumn("bucket", F.lit(0))
    wanted = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", wanted, 50 * buckets)).first()[0] or []))
    outer = max(1, round(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    own = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    above = lambda xs: F.size(F.filter(xs, lambda c: c <= own))
    first = above(longs(cuts[outer - 1 :: outer]))  # whole runs of cuts below the id, then cuts in its run
    runs = F.array(*[longs(cuts[k : k + outer]) for k in range(0, len(cuts) + 1, outer)])
    return docs.withColumn("bucket", first * outer + above(F.get(runs, first)))


def with_next(docs: DataFrame, per_bucket: int) -> DataFrame:
    """docs(doc_id, text) with next_text: a window in each bucket; the last row of a bucket gets the
    first of the next bucket, and the last of all the first of all, from a table of one row a bucket."""
    rows = bucketed(docs, per_bucket)
    # nulls come first in the order and are least among structs, too
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    ring = Window.orderBy("bucket")
    least = F.min(F.struct("bucket", "first")).over(Window.partitionBy())["first"]
    firsts = firsts.select(F.col("bucket").alias("its"), F.coalesce(F.lead("first").over(ring), least)["text"].alias("after"))
    rows = rows.withColumn("next_text", F.lead("text").over(Window.partitionBy("bucket").orderBy("doc_id", "text")))
    return rows.join(firsts, F.col("bucket") == F.col("its")).select("doc_id", "text", F.coalesce("next_text", "after").alias("next_text"))


def fingerprints(docs: DataFrame, per_bucket: int = 250) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and removed, added: the recovered digests of the paragraphs that only the
    text or only its edited version has; decoded: whether sketches alone gave both comparisons."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_next(docs.select(F.col("doc_id").cast("long"), text.alias("text")), per_bucket)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited})
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next_text")).alias("c"))
    for step in expressions(docs.sparkSession.sparkContext.applicationId):
        rows = rows.withColumns(step)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sa")).alias("fingerprint"), written(F.col("sb")).alias("edited_fingerprint"),
        likeness("a", "b", "ab").alias("near_edited"), likeness("a", "c", "ac").alias("near_next"),
        F.array_intersect("a", F.col("ab")["found"]).alias("removed"), F.array_intersect("b", F.col("ab")["found"]).alias("added"),
        (F.col("ab")["ok"] & F.col("ac")["ok"]).alias("decoded"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    out = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
