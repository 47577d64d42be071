"""Every registered query with SQL agrees with it, on the smallest tables."""

import duckdb
import pytest

from stocktake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    return con


def rows(values):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = sql.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows(tuple(r) for r in got.select(columns).collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_all_have_sql_but_the_digests(spark):
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"content_hash"}
    import base64
    import hashlib

    first = catalogue.QUERIES["content_hash"](spark, DATA).orderBy("doc_id").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").first()["text"]
    assert first["blake2b"] == hashlib.blake2b(text.encode(), digest_size=32).hexdigest()
    assert len(base64.b64decode(first["crc64nvme"])) == 8


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_prefix_reaches_the_scan(spark, tmp_path):
    from stocktake.operators.inventory import glob_scan

    spark.createDataFrame([("en/a", "h"), ("fr/b", "h")], "path string, hash string").write.parquet(str(tmp_path / "t"))
    text = plan(glob_scan(spark.read.parquet(str(tmp_path / "t")), "en/*").select("path"))
    assert "GreaterThanOrEqual(path,en/)" in text and "LessThan(path,en0)" in text and "ReadSchema: struct<path:string>" in text


def test_folded_policies_need_no_exchange(spark):
    text = plan(catalogue.QUERIES["path_class"](spark, DATA))
    assert "Exchange" not in text and "Join" not in text
