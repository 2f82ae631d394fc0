"""ingest, triage, oracle, scaffold and view from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from equivox.functions.text import head
from equivox.operators import matchers, oracle, parsers, rank, scaffold, similarity, triage
from equivox.sources import tabular, targets


def matched(units, target, spark):
    if target.matcher == "none":
        return matchers.none(units)
    return getattr(matchers, target.matcher)(units, spark.read.json(target.findings))


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(prog="equivox")
    cli.add_argument("command", choices=["ingest", "triage", "oracle", "scaffold", "view"])
    cli.add_argument("target")
    cli.add_argument("--targets", default="targets.toml")
    cli.add_argument("--out", default="out")
    cli.add_argument("--limit", type=int, default=0)
    cli.add_argument("--sample", type=int, default=0)
    cli.add_argument("--top-n", type=int, default=200)
    cli.add_argument("--all-verdicts", action="store_true")
    cli.add_argument("--terms", help="lexicon terms as Parquet")
    cli.add_argument("--spec")
    cli.add_argument("--contains")
    a = cli.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    t = targets.load(a.targets)[a.target]
    stem = f"{a.out}/{t.name}"
    if a.command == "ingest":
        return tabular.write_units(t.units(spark), f"{stem}.jsonl")
    if a.command in ("triage", "oracle"):
        units = tabular.read_units(spark, f"{stem}.jsonl")
        if a.limit:
            units = units.orderBy("uid").limit(a.limit)
        scored, judged = triage.score(units), None
        if a.command == "oracle":
            top = triage.top(scored, a.top_n).select("uid", "text").persist()
            pp, coord = parsers.all_rules(top)
            terms = similarity.concepts(spark.read.parquet(a.terms)) if a.terms else spark.createDataFrame([], "norm string, concepts array<string>")
            loci = oracle.pp_loci(pp, head(F.col("head")), ("low", "high", "lexical", "object"))
            loci = loci.unionByName(oracle.coord_loci(coord, head, ("low", "high", "lexical", "object")))
            pairs = oracle.head_pairs(loci).select("a", "b")
            judged = oracle.judge(top, pp, coord, similarity.concept_similarity(pairs, terms), head, ("low", "high", "lexical", "object"))
        rows = rank.ranked(rank.output_rows(units, scored, judged, matched(units, t, spark)))
        tabular.write_results(rows, f"{stem}_{a.command}")
        if a.sample:
            rows.limit(a.sample).show(truncate=100)
        return None
    rows = spark.read.json(f"{stem}_oracle.json")
    if a.command == "scaffold":
        return print(scaffold.write(scaffold.rendered(scaffold.picked(rows, a.limit or 50, a.all_verdicts), t.name), f"{stem}_cases"))
    for row in rank.view(rows, a.spec, a.contains, a.limit).toLocalIterator():
        print(row["header"], row["text"], sep="\n", end="\n\n")
    return None


if __name__ == "__main__":
    main()
