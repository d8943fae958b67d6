"""Those parts of the operators that SQL can say, against DuckDB on the driver's smallest tables and on awkward rows."""

import os

import duckdb
import pytest

from tidewatch.llm.queries import ORACLES, QUERIES

from .test_operators import AWKWARD, PII, SECRETS, URLS

TABLES = "/root/testdata/sf0.001"


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            path = f"{folder}/{t}.parquet"
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = QUERIES[name](spark, folder)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    return got, sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got, want = compared(spark, TABLES, name)
    assert got == want and want


def test_awkward_rows_equal_sql(spark, tmp_path):
    texts = [t for t in AWKWARD + SECRETS + PII if t is None or "\x00" not in t]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c a b c"), (0, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("secret_counts", "pii_counts", "quality_counts", "url_rules"):
        got, want = compared(spark, str(tmp_path), name)
        assert got == want, name
