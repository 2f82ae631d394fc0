"""Work that must not be repeated, and memory that must not follow the input."""

from equivox.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readings_read_sentences_once(spark):
    assert plan(QUERIES["parser_readings_rule"](spark, DATA)).count("FileScan parquet") == 2  # orders and part


def test_words_end_as_in_sql(spark, tmp_path):
    """In SQL letters beyond ASCII end a word: 'übe encodedß' holds be and encoded."""
    import duckdb

    from equivox.plans.catalogue import ORACLE

    texts = ["Der Rat übe encodedß heute.", "El señor and a bñor c. beß padded.\x0bIs it?\n\nIt was coded by it.", "andé or oré. ſome SOME etcä", "Plain and or is used."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("triage_documents", "unit_segment"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"select {', '.join(df.columns)} from ({ORACLE[name]})").fetchall())


def test_markup_leaves_python_in_pieces(spark):
    import pyarrow as pa

    from equivox.sources import html

    rows = [(f"p{k}", "x" * 50_000) for k in range(100)]
    got = list(html.frames(iter(rows), pa.schema([("path", pa.string()), ("text", pa.string())])))
    assert len(got) >= 4 and max(b.nbytes for b in got) < 2 * html.PIECE
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    page = "<p>" + "y" * 2_000_000 + "</p><p></p>"
    pages = spark.createDataFrame([("a", page), ("b", None), ("c", "")], "path string, html string")
    assert sorted((r.path, r.pos, len(r.text)) for r in html.html_blocks(pages).collect()) == [("a", 0, 2_000_000), ("a", 1, 0)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304b"


def test_verdicts_read_places_once(spark):
    """lineitem and part once, and part for the lexicon."""
    for name in ("unit_verdict", "locus_verdict"):
        assert plan(QUERIES[name](spark, DATA)).count("FileScan parquet") == 3 + 1  # the lexicon on both sides of its pairs
