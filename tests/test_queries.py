"""Registered queries against DuckDB, and reads by primary key."""

import os

import duckdb
import pytest

from quern.errors import QueryError
from quern.operators.alldocs import all_docs, envelope, next_page, prefix
from quern.queries import ORACLE_SQL, QUERIES
from quern.sources.adapters import json_lines, memory, open_collection, write_json_lines


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall())


@pytest.fixture
def spread(spark):
    """Shuffles keep all their partitions, as with larger tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["replicate_deleted", "view_persisted"])
def test_stores_of_several_partitions(spread, sf_dir, duck, name):
    test_query(spread, sf_dir, duck, name)


def custom_reduce(spark, folder, files):
    """view_custom_reduce over lineitem files of (key, number, flag) rows, and its SQL, which reads them in their order with one thread."""
    kinds = "l_orderkey BIGINT, l_linenumber INT, l_returnflag VARCHAR"
    (folder / "lineitem.parquet").mkdir()
    one = duckdb.connect(config={"threads": 1})
    for k, sql in enumerate(files):
        one.execute(f"CREATE OR REPLACE TABLE t ({kinds}); INSERT INTO t {sql}; COPY t TO '{folder}/lineitem.parquet/part-{k}.parquet'")
    one.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    got = {r["key"]: r["value"] for r in QUERIES["view_custom_reduce"](spark, str(folder)).collect()}
    return got, dict(one.sql(ORACLE_SQL["view_custom_reduce"]).fetchall())


def test_custom_reduce_keeps_the_order_of_files(spark, tmp_path):
    # Spark reads the largest file first.
    got, expected = custom_reduce(spark, tmp_path, ["VALUES (1, 1, 'R'), (1, 2, 'R'), (1, 1, 'N')", "SELECT i, 1, 'A' FROM range(50000) t(i) UNION ALL VALUES (1, 2, 'N'), (1, 1, 'N')"])
    assert got == expected and got[1] == "1:R,1:N,1:A,1:N,2:R,2:N"


def test_custom_reduce_of_missing_values(spark, tmp_path):
    got, expected = custom_reduce(spark, tmp_path, ["VALUES (1, 2, 'R'), (1, 1, NULL), (1, NULL, 'N'), (2, 1, NULL), (NULL, 1, 'A')"])
    assert got == expected == {1: "2:R", 2: None, None: "1:A"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_docs(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("b",), ("c",)], "_id string")
    ids = lambda rows: [r["_id"] for r in rows.collect()]
    assert ids(all_docs(df, startkey="ab", endkey="b")) == ["ab", "b"] and ids(all_docs(df, start_key="b", end_key="c", inclusive_end=False)) == ["b"]
    assert ids(all_docs(df, startkey="b", endkey="ab", descending=True)) == ["b", "ab"] and ids(all_docs(df, key="c")) == ["c"]
    rows = all_docs(df, keys=["b", "x", "a", "b"]).collect()
    assert [(r["_id"], r["__error"]) for r in rows] == [("b", None), ("x", "not_found"), ("a", None), ("b", None)]
    assert ids(all_docs(df, keys=["b", "a"], descending=True)) == ["a", "b"] and ids(all_docs(df, keys=["b", "a", "c"], skip=1, limit=1)) == ["a"]
    assert ids(prefix(df, "a")) == ["a", "ab"] and ids(next_page(df, None, 2)) == ["a", "ab"] and ids(next_page(df, "ab", 2)) == ["b", "c"]
    assert envelope(all_docs(df, skip=3), 4, 3, update_seq=9) == {"total_rows": 4, "offset": 3, "update_seq": 9, "rows": [{"_id": "c"}]}
    with pytest.raises(QueryError):
        all_docs(df, keys=["a"], startkey="b")


def test_sources(spark, tmp_path):
    df = memory(spark, [{"_id": "a", "n": [1]}, {"_id": "b"}])
    write_json_lines(df, str(tmp_path / "j"), "doc")
    assert sorted(r["_id"] for r in json_lines(spark, str(tmp_path / "j")).collect()) == ["a", "b"]
    assert open_collection(spark, "memory", [{"_id": "a", "n": 1}], schema="_id string, n int").count() == 1
    with pytest.raises(ValueError, match="Invalid Adapter"):
        open_collection(spark, "tape")
