from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, step = docs.columns, docs
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, DATA).cache()
        counts.append(step.count())
        if k < 4:
            assert step.columns == names
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    whole = corpus_pipeline.run(spark, DATA)
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in step.collect())
    items = [t.lower() for t in pq.read_table(f"{DATA}/benchmark.parquet")["text"].to_pylist()]
    assert not any(i in r.text.lower() for r in step.collect() for i in items)


def odd_documents(spark, rows):
    names = ["row", "node", "row_id", "row_key", "root", "h", "cell0", "leaf0", "kept_row", "bad_id", "item_key", "block", "draws", "copy", "bytes"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *[f"x{k}" if r[0] else None for k in range(len(names))]) for r in rows], schema)


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{k % 977}q{k}" for k in range(60_000))
    item = pq.read_table(f"{DATA}/benchmark.parquet")["text"][0].as_py()
    clean = [" ".join(f"c{j}x{k}" for k in range(40)) for j in range(6)]
    rows = [(1, clean[0], "en", "a", 5), (1, clean[1], "en", "a", 5), (None, clean[2], None, None, None), (None, clean[3], None, None, None), (2, None, None, "b", None), (3, "", "en", "b", 0),
            (4, long, "en", "c", 1), (5, clean[4], "en", "a", 1), (6, clean[4], "en", "b", 1), (7, clean[5], "en", "a", 1), (7, clean[5], "en", "a", 1), (8, f"before {item} after", "en", "a", 1), (None, item, None, None, None)]
    docs = odd_documents(spark, rows)
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    left = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    everything = Counter((i, t) for i, t, *_ in rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, DATA).columns == names, name
    assert left(stages["toxicity"](spark, docs, DATA)) == everything
    # null and empty texts are copies of each other, and so are 5 and 6, the rows of 7, and the item with and without words around it
    assert left(stages["simhash near-dedup"](spark, docs, DATA)) == everything - Counter([(3, ""), (6, clean[4]), (7, clean[5]), (None, item)])
    assert left(stages["benchmark decontamination"](spark, docs, DATA)) == everything - Counter([(8, f"before {item} after"), (None, item)])
    mixed = left(stages["mixing"](spark, docs, DATA))
    assert set(mixed) <= set(everything) and all(mixed[r] <= 2 * everything[r] for r in mixed)
    sharded = stages["sharding"](spark, docs, DATA)
    assert left(sharded) == everything and sharded.columns[: len(names)] == names
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
