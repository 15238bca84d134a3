import base64

import pytest
from pyspark.sql import functions as F

from quern.errors import NotFound, QueryError
from quern.operators.replicate import backoff, merge, replicate, replication_id, revs_diff, same_state, stem, sync
from quern.operators.views import Emit, ViewSpec
from quern.store import DocStore, leaves, winners
from quern.streaming.changes import Changes


@pytest.fixture
def store(spark, tmp_path):
    return DocStore(spark, str(tmp_path / "a"))


def test_put_get_conflict(store):
    one = store.put({"_id": "x", "n": 1})
    assert one["rev"].startswith("1-") and store.get("x") == {"_id": "x", "_rev": one["rev"], "n": 1}
    with pytest.raises(QueryError) as e:
        store.put({"_id": "x", "n": 2})
    assert e.value.status == 409
    two = store.put({"_id": "x", "_rev": one["rev"], "n": 2})
    assert store.get("x", revs=True)["_revisions"] == {"start": 2, "ids": [two["rev"][2:], one["rev"][2:]]}
    assert store.get("x", rev=one["rev"])["n"] == 1 and store.get("x", rev=one["rev"], latest=True)["n"] == 2
    three = store.remove("x", two["rev"])
    with pytest.raises(NotFound):
        store.get("x")
    assert store.info() == {"db_name": "a", "doc_count": 0, "update_seq": 3}
    assert store.put({"_id": "x", "n": 4})["rev"].startswith("4-") and three["rev"].startswith("3-")
    assert [i["status"] for i in store.get("x", revs_info=True)["_revs_info"]] == ["available"] * 4


def test_deterministic_revisions(spark, tmp_path):
    revs = {DocStore(spark, str(tmp_path / name)).put({"_id": "x", "b": 1, "a": 2})["rev"] for name in "ab"}
    other = DocStore(spark, str(tmp_path / "c"), deterministic_revs=False).put({"_id": "x", "b": 1, "a": 2})["rev"]
    assert len(revs) == 1 and other not in revs


def test_bulk_docs(store):
    rows = store.bulk_docs([{"_id": "a"}, {"_id": "b"}, {"_id": "a"}, {"n": 1}]).collect()
    assert [r["ok"] for r in rows] == [True, True, False, True] and rows[2]["error"] == "conflict"
    with pytest.raises(QueryError, match="Bad special document member"):
        store.bulk_docs([{"_id": "c", "_made": 1}])
    assert store.info()["doc_count"] == 3


REVS = [
    {"_id": "d", "_rev": "1-a", "n": 1, "_revisions": {"start": 1, "ids": ["a"]}},
    {"_id": "d", "_rev": "2-b", "n": 2, "_revisions": {"start": 2, "ids": ["b", "a"]}},
    {"_id": "d", "_rev": "2-c", "n": 3, "_revisions": {"start": 2, "ids": ["c", "a"]}},
    {"_id": "d", "_rev": "3-z", "_deleted": True, "_revisions": {"start": 3, "ids": ["z", "b", "a"]}},
    {"_id": "d", "_rev": "2-bb", "n": 4, "_revisions": {"start": 2, "ids": ["bb", "a"]}},
]


def test_winner_and_conflicts(store):
    store.bulk_docs(REVS, new_edits=False)
    store.bulk_docs(REVS, new_edits=False)
    assert store.log().count() == 5
    # A live leaf beats the longer deleted one; then the greater hash wins.
    assert store.get("d", conflicts=True) == {"_id": "d", "_rev": "2-c", "n": 3, "_conflicts": ["2-bb"]}
    assert sorted(r["ok"]["_rev"] for r in store.get("d", open_revs="all")) == ["2-bb", "2-c", "3-z"]
    assert store.get("d", open_revs=["2-b", "9-x"])[1] == {"missing": "9-x"}
    found = {(r["id"], r["rev"]): r["error"] for r in store.bulk_get([{"id": "d", "rev": "2-b"}, {"id": "d"}, {"id": "no"}, {"id": "d", "rev": "7-q"}]).collect()}
    assert found == {("d", "2-b"): None, ("d", "2-bb"): None, ("d", "2-c"): None, ("d", "3-z"): None, ("no", None): "not_found", ("d", "7-q"): "not_found"}
    assert store.purge("d", "3-z")["deletedRevs"] == ["3-z", "2-b"] and sorted(r["hash"] for r in leaves(store.log()).collect()) == ["bb", "c"]
    with pytest.raises(QueryError):
        store.purge("d", "1-a")


def test_generations_are_numbers(spark):
    rows = [("x", 2, "z", ["z"], False), ("x", 10, "a", ["a"], False)]
    log = spark.createDataFrame(rows, "id string, gen int, hash string, path array<string>, deleted boolean").withColumn("seq", F.lit(1)).withColumn("body", F.lit("{}"))
    assert winners(log).first()["gen"] == 10


def test_compaction_and_attachments(store):
    rev = store.put_attachment("x", "a.txt", None, b"first", "text/plain")["rev"]
    rev = store.put_attachment("x", "a.txt", rev, b"second", "text/plain")["rev"]
    assert store.get_attachment("x", "a.txt") == b"second"
    stub = store.get("x")["_attachments"]["a.txt"]
    assert stub["stub"] and stub["length"] == 6 and stub["digest"].startswith("md5-")
    assert base64.b64decode(store.get("x", attachments=True)["_attachments"]["a.txt"]["data"]) == b"second"
    store.compact()
    assert store._table("blobs", __import__("quern.store", fromlist=["BLOBS"]).BLOBS).count() == 1
    assert [i["status"] for i in store.get("x", revs_info=True)["_revs_info"]] == ["available", "missing"]
    store.remove_attachment("x", "a.txt", rev)
    with pytest.raises(NotFound):
        store.get_attachment("x", "a.txt")


def test_revs_limit(spark, tmp_path):
    store, rev = DocStore(spark, str(tmp_path / "s"), revs_limit=2), None
    for n in range(4):
        rev = store.put({"_id": "x", "n": n} | ({"_rev": rev} if rev else {}))["rev"]
    assert len(store.get("x", revs=True)["_revisions"]["ids"]) == 2 and leaves(store.log()).count() == 1


def test_local_docs(store):
    rev = store.put({"_id": "_local/x", "n": 1})["rev"]
    store.put({"_id": "_local/x", "_rev": rev, "n": 2})
    assert store.get("_local/x")["n"] == 2 and store.info()["doc_count"] == 0
    with pytest.raises(QueryError):
        store.put({"_id": "_local/x", "_rev": rev})


def test_lifecycle(spark, tmp_path):
    made = DocStore.defaults(revs_limit=5)
    DocStore.plugin({"shout": lambda self: self.name.upper()})
    with made(spark, str(tmp_path / "s")) as store:
        seen = []
        store.on("destroyed", seen.append)
        store.put({"_id": "x"})
        assert store.shout() == "S" and store.revs_limit == 5
        store.destroy()
    assert seen == [{"name": "s"}]
    with pytest.raises(QueryError, match="closed"):
        store.log()


def test_dump(store, spark, tmp_path):
    store.bulk_docs(REVS, new_edits=False)
    store.dump(str(tmp_path / "dump"))
    other = DocStore(spark, str(tmp_path / "b"))
    other.load(str(tmp_path / "dump"))
    assert same_state(store, other)


def test_changes(store, tmp_path):
    store.bulk_docs([{"_id": f"d{k}", "n": k} for k in range(4)])
    store.put({"_id": "d1", "_rev": store.get("d1")["_rev"], "n": 10})
    feed = Changes(store)
    rows = lambda **o: [(r["id"], r["seq"]) for r in feed.changes(**o).collect()]
    assert rows() == [("d0", 1), ("d2", 3), ("d3", 4), ("d1", 5)]
    assert rows(since=3) == [("d3", 4), ("d1", 5)] and rows(since="now") == []
    assert rows(limit=0) == [("d0", 1)] and rows(descending=True, limit=1) == [("d1", 5)]
    assert rows(selector={"n": {"$gt": 2}}) == [("d3", 4), ("d1", 5)] and rows(doc_ids=["d2"]) == [("d2", 3)]
    feed.filter("big", lambda p: F.try_variant_get("doc", "$.n", "int") >= p["least"])
    assert rows(filter="big", query_params={"least": 3}) == [("d3", 4), ("d1", 5)]
    view = ViewSpec([Emit(F.col("id"), None, F.try_variant_get("doc", "$.n", "int") == 2)])
    assert rows(filter="_view", view=view) == [("d2", 3)]
    with pytest.raises(QueryError):
        feed.changes(filter="none")
    with pytest.raises(QueryError):
        feed.changes(selector={}, filter=F.lit(True))
    store.bulk_docs(REVS, new_edits=False)
    (row,) = feed.changes(since=5, style="all_docs", conflicts=True).collect()
    assert [c["rev"] for c in row["changes"]] == ["3-z", "2-c", "2-bb"] and row["conflicts"] == ["2-bb"]


def test_live(store, tmp_path):
    seen = []
    run = lambda: Changes(store).live(lambda rows: seen.append([r["id"] for r in rows.collect()]), str(tmp_path / "checkpoint"), once=True)
    store.bulk_docs([{"_id": "a"}, {"_id": "b"}])
    run()
    store.put({"_id": "c"})
    run()
    assert [sorted(x) for x in seen] == [["a", "b"], ["c"]]


def test_replicate_and_sync(spark, store, tmp_path):
    other = DocStore(spark, str(tmp_path / "b"))
    store.bulk_docs([{"_id": f"d{k}", "n": k} for k in range(5)])
    store.put_attachment("att", "t", None, b"data", "text/plain")
    first = replicate(store, other, batch_size=3)
    assert (first["docs_written"], first["last_seq"], first["status"]) == (6, 6, "complete") and same_state(store, other)
    assert other.get_attachment("att", "t") == b"data" and replicate(store, other)["docs_written"] == 0
    a, b = store.get("d1")["_rev"], other.get("d1")["_rev"]
    store.put({"_id": "d1", "_rev": a, "n": "left"})
    other.put({"_id": "d1", "_rev": b, "n": "right"})
    other.remove("d2", other.get("d2")["_rev"])
    sync(store, other)
    assert same_state(store, other) and store.get("d1", conflicts=True) == other.get("d1", conflicts=True) and store.get("d1", conflicts=True)["_conflicts"]
    third = DocStore(spark, str(tmp_path / "c"))
    assert replicate(store, third, selector={"n": {"$gte": 3}})["docs_written"] == 4  # two numbers, and both branches of a string
    assert replicate(store, third, doc_ids=["d0"])["docs_written"] == 1


def test_replication_ids_and_backoff():
    assert replication_id("a", "b", doc_ids=["y", "x"]) == replication_id("a", "b", doc_ids=["x", "y"]) != replication_id("a", "b")
    assert 0 <= backoff(0) <= 2
    wait = 0.0
    for _ in range(50):
        wait = backoff(wait)
        assert wait <= 600


def test_merge_algebra(spark):
    schema = "id string, gen int, hash string, path array<string>"
    a = spark.createDataFrame([("x", 1, "a", ["a"]), ("x", 2, "b", ["b", "a"])], schema)
    b = spark.createDataFrame([("x", 2, "b", ["b"]), ("x", 2, "c", ["c", "a"])], schema)
    out = lambda df: sorted(map(tuple, (((r["id"], r["gen"], r["hash"], tuple(r["path"]))) for r in df.collect())))
    assert out(merge(a, b)) == out(merge(b, a)) == out(merge(merge(a, b), b)) and out(merge(a, a)) == out(a)
    assert ("x", 2, "b", ("b", "a")) in out(merge(b, a)) and out(stem(a, 1))[1][3] == ("b",)
    assert revs_diff(b.withColumn("rev", F.col("hash")), a.withColumn("rev", F.col("hash"))).first()["rev"] == "c"


def test_random_actions_converge(spark, tmp_path):
    import random

    draw = random.Random(5)
    stores = [DocStore(spark, str(tmp_path / n)) for n in "xy"]
    for _ in range(8):
        store = draw.choice(stores)
        id_ = f"d{draw.randrange(3)}"
        try:
            known = {"_rev": store.get(id_)["_rev"]}
        except NotFound:
            known = {}
        store.post({"_id": id_, "n": draw.random()} | known | ({"_deleted": True} if known and draw.random() < 0.3 else {}))
    sync(*stores)
    assert same_state(*stores)
    assert sorted(map(str, stores[0].docs().collect())) == sorted(map(str, stores[1].docs().collect()))


def test_deletions_stay_deleted(spark, store, tmp_path):
    other = DocStore(spark, str(tmp_path / "b"))
    store.put({"_id": "x", "n": 1})
    replicate(store, other)
    rev = store.put({"_id": "x", "_rev": store.get("x")["_rev"], "n": 2})["rev"]
    store.remove("x", rev)
    replicate(store, other)
    # The second revision was never sent; the first one is an ancestor all the same.
    assert other.log().count() == 2 and [(r["gen"], r["deleted"]) for r in leaves(other.log()).collect()] == [(3, True)]
    assert other.docs().count() == 0 and same_state(store, other)


def test_random_actions_converge_step_by_step(spark, tmp_path):
    import random

    draw = random.Random(11)
    stores = [DocStore(spark, str(tmp_path / n)) for n in "xy"]
    for step in range(9):
        store = draw.choice(stores)
        id_ = f"d{draw.randrange(2)}"
        try:
            known = {"_rev": store.get(id_)["_rev"]}
        except NotFound:
            known = {}
        store.post({"_id": id_, "n": step} | known | ({"_deleted": True} if known and draw.random() < 0.4 else {}))
        if draw.random() < 0.6:
            replicate(*draw.sample(stores, 2))
    sync(*stores)
    assert same_state(*stores)
    assert sorted(map(str, stores[0].docs().collect())) == sorted(map(str, stores[1].docs().collect()))


def test_all_docs_of_a_store(store):
    store.bulk_docs([{"_id": k, "n": k} for k in "abc"])
    gone = store.remove("b", store.get("b")["_rev"])["rev"]
    found = store.all_docs_result(include_docs=True, update_seq=True)
    assert [r["id"] for r in found["rows"]] == ["a", "c"] and (found["total_rows"], found["offset"], found["update_seq"]) == (2, 0, 4)
    assert found["rows"][0]["value"] == {"rev": store.get("a")["_rev"]} and found["rows"][0]["doc"] == '{"n": "a"}'
    rows = store.all_docs_result(keys=["c", "b", "x"], include_docs=True)["rows"]
    assert [r["key"] for r in rows] == ["c", "b", "x"] and rows[1]["value"] == {"rev": gone, "deleted": True} and rows[1]["doc"] is None
    assert rows[2]["error"] == "not_found" and "id" not in rows[2]
    assert [r["id"] for r in store.all_docs_result(descending=True, limit=1)["rows"]] == ["c"]


def test_writes_read_only_their_documents(store, spark, tmp_path):
    store.bulk_docs([{"_id": f"d{k}"} for k in range(5)])
    plan = store._of(store.log(), [{"_id": "d1"}])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,d1)]" in plan
    assert not [p.name for p in tmp_path.joinpath("a").iterdir() if p.name.startswith(".batch-")]


def test_new_versions_are_named_last(store, spark, tmp_path):
    store.bulk_docs([{"_id": "a"}, {"_id": "b"}])
    # A crash before the name leaves the old version, and its remains don't hinder the next try.
    store.log().limit(0).write.parquet(f"{store.folder}/log/1")
    assert store.docs().count() == 2
    store.compact()
    assert store.docs().count() == 2 and DocStore(spark, store.folder).update_seq() == 2
    assert sorted(p.name for p in tmp_path.joinpath("a", "log").iterdir()) == ["1"]
    store.put({"_id": "c"})
    assert store.docs().count() == 3


def test_refused_revisions(spark, store, tmp_path):
    other, events = DocStore(spark, str(tmp_path / "b")), []
    other.accept = lambda doc: F.try_variant_get(doc, "$.n", "int") < 2
    store.bulk_docs([{"_id": f"d{k}", "n": k} for k in range(3)])
    result = replicate(store, other, on=lambda event, what: events.append((event, what)))
    assert (result["docs_read"], result["docs_written"], result["doc_write_failures"]) == (3, 2, 1)
    assert [w["docs"] for e, w in events if e == "denied"] == [["d2"]]


def test_live_replication(spark, store, tmp_path):
    from quern.operators.replicate import Replication

    other, events = DocStore(spark, str(tmp_path / "b")), []
    store.put({"_id": "a"})
    live = Replication(store, other, str(tmp_path / "checkpoint"), lambda event, what: events.append(event))
    live.query.processAllAvailable()
    store.put({"_id": "b"})
    assert live.cancel()["docs_written"] == 2 and same_state(store, other) and events[0] == "active" and events[-1] == "complete"


def test_bulk_get_options(store):
    store.bulk_docs(REVS, new_edits=False)
    (row,) = store.bulk_get([{"id": "d", "rev": "2-b"}], revs=True, attachments=True).collect()
    assert row["path"] == ["b", "a"] and row["attachments"] == {}
    assert {r["rev"] for r in store.bulk_get([{"id": "d", "rev": "1-a"}], latest=True).collect()} == {"3-z", "2-c", "2-bb"}
    rev = store.put_attachment("x", "a", None, b"\0\1", "t")["rev"]
    assert store.get("x", rev=rev, attachments=True, binary=True)["_attachments"]["a"]["data"] == b"\0\1"


def test_purges_are_noted(store):
    store.purged_infos_limit = 1
    for id_ in "ab":
        store.purge(id_, store.put({"_id": id_})["rev"])
    assert [(p["id"], p["purge_seq"]) for p in store.purged_infos()] == [("b", 2)] and store.info()["doc_count"] == 0


def test_python_filters(store):
    store.bulk_docs([{"_id": "a", "n": 1}, {"_id": "b", "n": 2}, {"_id": "c"}])
    assert [r["id"] for r in Changes(store).changes(filter=lambda doc: doc["n"] > 1).collect()] == ["b"]


def test_watchers(spark, tmp_path):
    seen = []
    DocStore.watch("destroyed", seen.append)
    DocStore(spark, str(tmp_path / "w")).destroy()
    assert seen == [{"name": "w"}]
    DocStore.watchers.clear()
