import pytest
from pyspark.sql import functions as F

from quern.errors import NotFound, QueryError
from quern.operators.views import Emit, Views, ViewSpec, map_python, map_rows, query

NUMBERS = [("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 5.0), ("d", None, 7.0)]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(NUMBERS, "_id string, k string, v double")


def spec(reduce=None):
    return ViewSpec([Emit(F.col("k"), F.col("v"))], reduce)


def test_order_and_ranges(numbers):
    rows = lambda **o: [(r["key"], r["id"]) for r in query(numbers, spec(), **o).collect()]
    assert rows() == [(None, "d"), ("x", "a"), ("x", "b"), ("y", "c")]
    assert rows(descending=True) == [("y", "c"), ("x", "b"), ("x", "a"), (None, "d")]
    assert rows(key="x") == [("x", "a"), ("x", "b")] and rows(key=None) == [(None, "d")]
    assert rows(startkey="x", endkey="x") == [("x", "a"), ("x", "b")] and rows(endkey="y", inclusive_end=False) == [(None, "d"), ("x", "a"), ("x", "b")]
    assert rows(startkey="y", endkey="x", descending=True) == [("y", "c"), ("x", "b"), ("x", "a")]
    assert rows(keys=["y", "x", "nothing", "y"]) == [("y", "c"), ("x", "a"), ("x", "b"), ("y", "c")]
    assert rows(skip=1, limit="2") == [("x", "a"), ("x", "b")]
    with pytest.raises(QueryError):
        rows(limit=-1)


def test_built_in_reducers(numbers):
    out = lambda r, **o: {x["key"]: x["value"] for x in query(numbers, spec(r), **o).collect()}
    assert out("_count", group=True) == {None: 1, "x": 2, "y": 1} and out("_sum") == {None: 15.0}
    assert out("_sum\n and more", group=True)["x"] == 3.0
    assert tuple(out("_stats", group=True)["x"]) == (3.0, 2, 1.0, 2.0, 5.0)
    assert out("_count", keys=["y", "x"], group=True) == {"y": 1, "x": 2}
    for bad in ({"keys": ["x"]}, {"group_level": -1}, {"group_level": "exact"}):
        with pytest.raises(QueryError):
            query(numbers, spec("_count"), **bad)
    with pytest.raises(QueryError, match="unknown built-in"):
        query(numbers, spec("_product"))
    with pytest.raises(QueryError, match="takes numbers"):
        query(numbers, ViewSpec([Emit(F.col("k"), F.col("k"))], "_sum"))


def test_lists(spark):
    df = spark.createDataFrame([("1", [2.0]), ("2", [1.0, 2.0, 3.0, 4.0]), ("3", [3.0, 4.0]), ("4", [1.0])], "_id string, v array<double>")
    view = ViewSpec([Emit(F.lit(None).cast("string"), F.col("v"))], "_sum")
    assert query(df, view).first()["value"] == [7.0, 6.0, 3.0, 4.0]
    with pytest.raises(Exception, match="lists of one length"):
        query(df, view, reduce="_stats").collect()
    even = query(df.filter("_id IN ('1', '4')"), view, reduce="_stats").first()["value"]
    assert tuple(even[0]) == (3.0, 2, 1.0, 2.0, 5.0)


def test_group_level(spark):
    df = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "d", "b")], "_id string, x string, y string")
    view = ViewSpec([Emit([F.col("x"), F.col("y")], F.lit(1))], "_count")
    out = lambda n: sorted((tuple(r["key"] or ()), r["value"]) for r in query(df, view, group_level=n).collect())
    assert out(0) == [((), 3)] and out(1) == [(("a",), 2), (("d",), 1)] and len(out(2)) == len(out("999")) == 3
    rows = lambda **o: [tuple(r["key"]) for r in query(df, view, reduce=False, **o).collect()]
    assert rows(startkey=["a"], endkey=["a", {}]) == [("a", "b"), ("a", "c")] and rows(startkey=["a", "c"]) == [("a", "c"), ("d", "b")]
    assert rows(key=["d", "b"]) == [("d", "b")] and rows(endkey=["a"]) == []


def test_custom_reduce_and_errors(numbers):
    view = ViewSpec([Emit(F.col("k"), F.col("v"))], lambda keys, values, rereduce: max(values) if keys[0][0] != "y" else 1 / 0)
    assert {r["key"]: r["value"] for r in query(numbers, view, group=True).collect()} == {None: 7.0, "x": 2.0, "y": None}


def test_python_map(numbers):
    def view(doc, emit):
        if doc["_id"] == "c":
            raise ValueError
        emit(doc["k"], doc["v"])
        emit("all", doc["v"])

    rows = map_python(numbers, view, "string", "double")
    assert {r["key"]: r["value"] for r in query(numbers, rows, reduce="_sum", group=True).collect()} == {None: 7.0, "x": 3.0, "all": 10.0}


def test_linked_docs(spark):
    df = spark.createDataFrame([("1", "2", "green"), ("2", None, "red"), ("3", "9", "blue")], "_id string, link string, color string")
    view = ViewSpec([Emit(F.col("_id"), F.struct(F.col("link").alias("_id")), F.col("link").isNotNull())])
    assert [(r["id"], r["doc"] and r["doc"]["color"]) for r in query(df, view, include_docs=True).collect()] == [("1", "red"), ("3", None)]


def test_emit_many(numbers):
    view = ViewSpec([Emit(F.lit("a"), F.col("v")), Emit(F.lit("b"), F.col("v"), F.col("v") > 4)])
    assert map_rows(numbers, view).count() == 6


def test_stale(spark, tmp_path):
    docs = [spark.createDataFrame([("1", "x")], "_id string, k string")]
    views, seen = Views(lambda: docs[-1], str(tmp_path)), []
    views.on_indexing(seen.append)
    views.define("v", ViewSpec([Emit(F.col("k"))], "_count"))
    total = lambda **o: views.query("v", **o).first()["value"]
    assert total() == 1
    docs.append(spark.createDataFrame([("1", "x"), ("2", "y")], "_id string, k string"))
    assert total(stale="ok") == 1 and total(stale="update_after") == 1 and total(stale="ok") == 2
    with pytest.raises(NotFound):
        views.query("w")
    del views.specs["v"]
    assert views.cleanup() == ["v"] and seen == [{"view": "v", "version": 1}, {"view": "v", "version": 2}]


def test_kept_views_of_a_store(spark, tmp_path):
    from quern.store import DocStore
    from quern.streaming.changes import views_of

    store, folder, mapped = DocStore(spark, str(tmp_path / "s")), str(tmp_path / "views"), []
    store.bulk_docs([{"_id": f"d{k}", "n": k % 3} for k in range(9)])
    view = ViewSpec([Emit(F.try_variant_get("doc", "$.n", "int"), F.col("_id"))], "_count")
    views = views_of(store, folder)
    views.on_indexing(mapped.append)
    views.define("v", view)
    count = lambda v, **o: {r["key"]: r["value"] for r in v.query("v", group=True, **o).collect()}
    assert count(views) == {0: 3, 1: 3, 2: 3} == count(views) and len(mapped) == 1
    store.remove("d0", store.get("d0")["_rev"])
    store.put({"_id": "d1", "_rev": store.get("d1")["_rev"], "n": 7})
    # Another session finds what is there.
    other = views_of(store, folder)
    other.define("v", view)
    assert count(other, stale="ok") == {0: 3, 1: 3, 2: 3} and count(other) == {0: 2, 1: 2, 2: 3, 7: 1}
    # Another definition is another view.
    other.define("v", ViewSpec([Emit(F.lit("all"))], "_count"))
    assert count(other) == {"all": 8}
    other.specs.clear()
    assert other.cleanup() == ["v"] and not (tmp_path / "views" / "v").exists()


def test_errors_are_counted(spark, numbers):
    def view(doc, emit):
        emit(doc["k"].upper())

    failed = spark.sparkContext.accumulator(0)
    assert map_python(numbers, view, "string", "double", errors=failed).count() == 3 and failed.value == 1


def test_results(numbers):
    from quern.operators.views import result

    found = result(numbers, spec("_sum"), reduce=False, skip=1, limit=1)
    assert (found["total_rows"], found["offset"]) == (4, 1) and [r["id"] for r in found["rows"]] == ["a"]
    assert result(numbers, spec("_sum"), update_seq=5) == {"update_seq": 5, "rows": [{"key": None, "value": 15.0}]}


def test_bad_values(spark):
    df = spark.createDataFrame([("1", "[1]"), ("2", '["x"]'), ("3", "4")], "_id string, j string").withColumn("v", F.parse_json("j"))
    view = ViewSpec([Emit(F.lit("k"), F.col("v"))], "_sum")
    with pytest.raises(Exception, match="takes numbers or lists"):
        query(df, view, group=True).collect()
    with pytest.raises(Exception, match="either numbers or lists"):
        query(df.filter("_id <> '2'"), view, reduce="_stats", group=True).collect()
