"""Every query of the subpackage over its whole table; those with SQL give the same rows in DuckDB."""

import duckdb
import pyarrow.parquet as pq
import pytest

from equivox.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(list(r)) for r in df.select(*cols).collect())
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        out = con.execute(ORACLE[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == cols
        assert got == sorted(str([r[names.index(c)] for c in cols]) for r in out.fetchall())
    elif name != "op2_secrets":
        table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
        ids = sorted(pq.read_table(f"{DATA}/{table}.parquet", columns=[key])[key].to_pylist())
        assert sorted(r[0] for r in df.select(key).collect()) == ids
    assert got
    if name.startswith("op9"):
        assert len({r.shard for r in df.select("shard").collect()}) > 1
