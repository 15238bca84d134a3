import re

import pytest

from quern.errors import QueryError
from quern.operators.find import Collection
from quern.plans.selector import compile_selector, normal_form, parse_path
from quern.sources.adapters import memory

# Documents, selectors and the ids that they must give.
SMASH = [
    ("mario", "mario", 5, "mario", 1981), ("puff", "jigglypuff", 8, "pokemon", 1996), ("link", "link", 10, "zelda", 1986), ("dk", "donkey kong", 7, "mario", 1981),
    ("pikachu", "pikachu", 1, "pokemon", 1996), ("falcon", "captain falcon", 4, "f-zero", 1990), ("luigi", "luigi", 11, "mario", 1983), ("fox", "fox", 3, "star fox", 1993),
    ("ness", "ness", 9, "earthbound", 1994), ("samus", "samus", 12, "metroid", 1986), ("yoshi", "yoshi", 6, "mario", 1990), ("kirby", "kirby", 2, "kirby", 1992),
]
GOLDEN = [
    ({"$and": [{"series": {"$ne": "kirby"}}, {"series": {"$ne": "pokemon"}}, {"_id": {"$gt": "mario"}}, {"debut": {"$lte": 1993}}]}, ["samus", "yoshi"]),
    ({"_id": {"$gte": "link"}}, ["link", "luigi", "mario", "ness", "pikachu", "puff", "samus", "yoshi"]),
    ({"_id": {"$lt": "samus", "$gt": "a"}}, ["dk", "falcon", "fox", "kirby", "link", "luigi", "mario", "ness", "pikachu", "puff"]),
    ({"$and": [{"_id": {"$eq": "pikach"}}, {"name": {"$gte": "link"}}, {"rank": {"$ne": 8}}]}, []),
    ({"$and": [{"series": {"$lt": "star fox"}}, {"_id": {"$gte": "ness"}}]}, ["ness", "pikachu", "puff", "samus", "yoshi"]),
    ({"$and": [{"_id": {"$gt": "samus"}}, {"name": {"$gt": "fox"}}]}, ["yoshi"]),
    ({"$and": [{"series": {"$gt": "mario"}}, {"_id": {"$lt": "mario"}}, {"name": {"$ne": "link"}}]}, ["fox"]),
    ({"$and": [{"rank": {"$lt": 9}}, {"_id": {"$lte": "puff"}}]}, ["dk", "falcon", "fox", "kirby", "mario", "pikachu", "puff"]),
    ({"$and": [{"debut": {"$lte": 1994}}, {"_id": {"$lte": "link"}}, {"_id": {"$lte": "pikach"}}, {"rank": {"$gt": 4}}]}, ["dk", "link"]),
    ({"$and": [{"series": {"$lt": "f-zero"}}, {"_id": {"$lt": "pikach"}}]}, ["ness"]),
    ({"$and": [{"name": {"$lte": "mario"}}, {"_id": {"$lt": "mario"}}, {"debut": {"$eq": 1990}}]}, ["falcon"]),
]


@pytest.fixture(scope="module", params=["typed", "variant"])
def smash(spark, request):
    if request.param == "typed":
        return Collection(spark.createDataFrame(SMASH, "_id string, name string, rank int, series string, debut int"))
    names = ("_id", "name", "rank", "series", "debut")
    return Collection(memory(spark, [dict(zip(names, r, strict=True)) for r in SMASH]), variant="doc")


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden(smash, k):
    selector, ids = GOLDEN[k]
    assert sorted(r["_id"] for r in smash.find({"selector": selector}).collect()) == sorted(ids)


def ids(docs, selector, **options):
    return [r["_id"] for r in docs.find({"selector": selector, **options}).collect()]


def test_sort_skip_limit(smash):
    assert ids(smash, {"rank": {"$gt": 0}}, sort=[{"rank": "desc"}], limit=3) == ["samus", "luigi", "link"]
    assert ids(smash, {"rank": {"$gt": 0}}, sort=["rank"], skip=10) == ["luigi", "samus"]
    assert ids(smash, {"rank": {"$gt": 0}}, limit=0) == []


def test_default_limit(spark):
    docs = Collection(spark.range(60).selectExpr("lpad(cast(id AS string), 3, '0') AS _id"))
    assert len(ids(docs, {})) == 25 and len(ids(docs, {}, limit=None)) == 60


KINDS = [("word", "kiwi"), ("object", {"k": 1}), ("many", 1e3), ("yes", True), ("list", [3]), ("minus", -7.5), ("no", False), ("nothing", None), ("words", ["kiwi"]), ("empty", ""), ("absent", ...)]


@pytest.fixture(scope="module")
def mixed(spark):
    return Collection(memory(spark, [{"_id": i} | ({} if v is ... else {"x": v}) for i, v in KINDS]), variant="doc")


def test_order_across_types(mixed):
    assert ids(mixed, {"x": {"$lt": 5}}, sort=[{"x": "desc"}]) == ["minus", "yes", "no", "nothing"]
    assert ids(mixed, {"x": {"$gt": 5}}, sort=["x"]) == ["many", "empty", "word", "list", "words", "object"]
    assert ids(mixed, {"x": {"$gte": [3]}}, sort=["x"]) == ["list", "words", "object"]
    assert ids(mixed, {"x": {"$exists": False}}) == ["absent"] and "nothing" in ids(mixed, {"x": {"$exists": True}})
    assert ids(mixed, {"x": None}) == ["nothing"] and ids(mixed, {"x": {"$lte": None}}) == ["nothing"]


@pytest.mark.parametrize(("kind", "found"), [("null", ["nothing"]), ("boolean", ["no", "yes"]), ("number", ["many", "minus"]), ("string", ["empty", "word"]), ("array", ["list", "words"]), ("object", ["object"])])
def test_type(mixed, kind, found):
    assert sorted(ids(mixed, {"x": {"$type": kind}})) == found


PLANTS = [("ash", ["dry", "sun"], 40), ("birch", ["wet", "sun"], 42), ("cedar", ["sun"], 41), ("elm", ["dry"], 43), ("stump", None, None)]


@pytest.fixture(scope="module", params=["typed", "variant"])
def plants(spark, request):
    if request.param == "typed":
        return Collection(spark.createDataFrame(PLANTS, "_id string, likes array<string>, age int"))
    return Collection(memory(spark, [{k: v for k, v in zip(("_id", "likes", "age"), r, strict=True) if v is not None} for r in PLANTS]), variant="doc")


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ({"likes": {"$in": ["dry"]}}, ["ash", "elm"]),
        ({"likes": {"$nin": ["dry"]}}, ["birch", "cedar"]),
        ({"likes": {"$nin": ["sun", "wet"]}}, ["elm"]),
        ({"likes": {"$nin": ["shade"]}}, ["ash", "birch", "cedar", "elm"]),
        ({"age": {"$nin": [40, 43]}}, ["birch", "cedar"]),
        ({"age": {"$in": [40, 41]}}, ["ash", "cedar"]),
        ({"_id": {"$nin": ["ash", "cedar", "stump"]}}, ["birch", "elm"]),
        ({"likes": {"$all": ["dry", "sun"]}}, ["ash"]),
        ({"likes": {"$size": 2}}, ["ash", "birch"]),
        ({"likes": {"$elemMatch": {"$gt": "t"}}}, ["birch"]),
        ({"likes": {"$allMatch": {"$lt": "t"}}}, ["ash", "cedar", "elm"]),
        ({"likes": ["dry"]}, ["elm"]),
        ({"age": {"$mod": [10, 1]}}, ["cedar"]),
        ({"_id": {"$regex": "^[ab]"}}, ["ash", "birch"]),
        ({"_id": {"$regex": re.compile("^CE", re.I)}}, ["cedar"]),
        ({"age": {"$not": {"$gt": 40}}}, ["ash", "stump"]),
        ({"$nor": [{"age": {"$gt": 41}}, {"likes": {"$size": 1}}]}, ["ash", "stump"]),
        ({"age": {"$ne": 40}}, ["birch", "cedar", "elm"]),
        ({"_id": {"$gt": None}}, ["ash", "birch", "cedar", "elm", "stump"]),
        ({"_id": {"$lte": {}}}, []),
        ({}, ["ash", "birch", "cedar", "elm", "stump"]),
        ({"age": {}}, []),
    ],
)
def test_operators(plants, selector, found):
    assert sorted(ids(plants, selector)) == found


def test_equality_of_objects(spark):
    docs = [{"_id": "1", "field": {"a": 1, "b": 2}}, {"_id": "2", "field": {"a": 1, "b": {"$eq": 1}}}, {"_id": "3", "field": {"a": 1, "b": 1}}]
    found = Collection(memory(spark, docs), variant="doc")
    assert ids(found, {"field": {"$eq": {"a": 1, "b": {"$eq": 1}}}}) == ["2"]
    assert ids(found, {"field": {"a": 1, "b": {"$eq": 1}}}) == ["3"]
    typed = Collection(spark.createDataFrame([("1", (1, 2)), ("3", (1, 1))], "_id string, field struct<a:int,b:int>"))
    assert ids(typed, {"field": {"$eq": {"a": 1, "b": 1}}}) == ["3"] and ids(typed, {"field.a": 1, "field.b": {"$gt": 1}}) == ["1"]


def test_escaped_names(spark):
    found = Collection(memory(spark, [{"_id": "a", "foo.bar": 1}, {"_id": "b", "foo": {"bar": 2}}, {"_id": "c", "x y'z": 3}]), variant="doc")
    assert parse_path("a\\.b.c") == ["a.b", "c"]
    assert ids(found, {"foo\\.bar": 1}) == ["a"] and ids(found, {"foo.bar": 2}) == ["b"] and ids(found, {"x y'z": 3}) == ["c"]


def test_fields(spark):
    docs = [{"_id": "a", "foo": {"bar": "yo", "x": 1}, "bar": {"baz": "hey"}}, {"_id": "b", "foo": True, "bar": []}]
    found = Collection(memory(spark, docs), variant="doc").find({"selector": {}, "fields": ["_id", "bar.baz", "foo.bar"]})
    import json

    assert [json.loads(r[0]) for r in found.selectExpr("to_json(doc)").collect()] == [{"_id": "a", "bar": {"baz": "hey"}, "foo": {"bar": "yo"}}, {"_id": "b"}]


@pytest.mark.parametrize(
    ("selector", "message"),
    [
        ({"a": {"$in": "a"}}, "Query operator $in must be an array. Received string: a"),
        ({"a": {"$nin": "a"}}, "Query operator $nin must be an array. Received string: a"),
        ({"a": {"$all": "a"}}, "Query operator $all must be an array. Received string: a"),
        ({"a": {"$allMatch": "a"}}, "Query operator $allMatch must be an object. Received string: a"),
        ({"a": {"$exists": "true"}}, "Query operator $exists must be a boolean. Received string: true"),
        ({"a": {"$size": 2.1}}, "Query operator $size must be a integer. Received number: 2.1"),
        ({"a": {"$mod": "a"}}, "Query operator $mod must be an array. Received string: a"),
        ({"a": {"$regex": 1986}}, "Query operator $regex must be a string"),
        ({"a": {"$type": "made-up"}}, "Query operator $type must be a string. Supported values: "),
        ({"a": {"$mod": [0, 1]}}, "cannot divide by zero"),
        ({"a": {"$noor": 1}}, "unknown operator"),
    ],
)
def test_errors(spark, selector, message):
    with pytest.raises(QueryError) as e:
        compile_selector(spark.range(1), selector, "id")
    assert message in str(e.value)


def test_normal_form():
    assert normal_form({"$and": [{"a": {"$gt": 1}}, {"a": {"$gt": 2, "$lte": 9}}, {"b": 3}]}) == {"a": {"$gt": 2, "$lte": 9}, "b": {"$eq": 3}}
    assert normal_form({"$and": [{"$or": [{"a": 1}, {"b": 2}]}, {"$or": [{"c": 3}]}]}) == {"$or": [{"a": {"$eq": 1}, "c": {"$eq": 3}}, {"b": {"$eq": 2}, "c": {"$eq": 3}}]}


def test_indexes(smash):
    smash.catalog.indexes.clear()
    assert smash.create_index({"fields": ["series"]})["result"] == "created" and smash.create_index({"fields": ["series"]})["result"] == "exists"
    smash.create_index({"fields": ["series", "rank"]}, ddoc="both", name="both")
    assert smash.explain({"selector": {"series": "mario", "rank": {"$gt": 5}}})["index"]["name"] == "both"
    assert smash.explain({"selector": {"series": "mario"}})["range"] == {"start_key": ["mario"], "end_key": ["mario"]}
    assert smash.explain({"selector": {"name": "x"}})["index"]["name"] == "_all_docs" and smash.warning({"selector": {"name": "x"}})
    assert [r["_id"] for r in smash.find({"selector": {"series": {"$gt": "mario"}}}).collect()] == ["samus", "pikachu", "puff", "fox", "link"]
    with pytest.raises(QueryError, match="unknown index"):
        smash.find({"selector": {"a": 1}, "use_index": "nothing"})
    with pytest.raises(QueryError, match="no usable index"):
        smash.find({"selector": {"name": "x"}, "use_index": "both"})
    assert smash.get_indexes()["total_rows"] == 3 and smash.delete_index("both") == {"ok": True} and smash.get_indexes()["total_rows"] == 2


def test_materialised_index(spark, tmp_path):
    docs = Collection(spark.createDataFrame(SMASH, "_id string, name string, rank int, series string, debut int"))
    docs.create_index({"fields": ["rank"], "partial_filter_selector": {"series": "mario"}}, ddoc="m", path=str(tmp_path / "idx"))
    assert ids(docs, {"rank": {"$gt": 0}}, use_index="m") == ["mario", "yoshi", "dk", "luigi"]


def test_pushdown(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = Collection(df, id_col="l_orderkey").find({"selector": {"l_returnflag": "R", "l_quantity": {"$gt": 45}}, "fields": ["l_orderkey"]})
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan and "TakeOrderedAndProject" in plan


def test_normal_form_keeps_every_condition():
    assert normal_form({"$and": [{"a": 1}, {"a": 2}]}) == {"a": {"$eq": 1}, "$and": [{"a": {"$eq": 2}}]}
    assert normal_form({"$and": [{"$nor": [{"a": 1}]}, {"$nor": [{"b": 1}]}]}) == {"$nor": [{"a": 1}, {"b": 1}]}
    assert normal_form({"$and": [{"$not": {"a": 1}}, {"$not": {"b": 1}}]}) == {"$not": {"a": 1}, "$and": [{"$not": {"b": 1}}]}
    both = normal_form({"$and": [{"$or": [{"a": {"$gt": 1}}, {"b": 1}]}, {"$or": [{"a": {"$gt": 3}}, {"c": 1}]}]})
    assert both["$or"][0] == {"a": {"$gt": 3}} and len(both["$or"]) == 4
    assert normal_form({"a": {"$gt": 1}, "$and": [{"a": {"$gte": 1}}, {"a": {"$lt": 9}}]}) == {"a": {"$gt": 1, "$lt": 9}}


def test_stale_copies_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "docs")
    spark.range(50).selectExpr("id AS _id", "id % 7 AS n").write.parquet(folder)
    docs = Collection(spark.read.parquet(folder))
    docs.create_index({"fields": ["n"]}, path=str(tmp_path / "index"))
    request = {"selector": {"n": {"$gte": 5}}, "limit": None}
    assert str(tmp_path / "index") in docs.find(request).inputFiles()[0] and docs.find(request).count() == 14
    spark.range(50, 57).selectExpr("id AS _id", "id % 7 AS n").write.mode("append").parquet(folder)
    docs.df = spark.read.parquet(folder)
    assert docs.find(request).count() == 16


def test_catalogs_are_kept(spark, tmp_path):
    df, folder = spark.range(9).selectExpr("id AS _id", "id % 4 AS n"), str(tmp_path / "catalog")
    first = Collection(df, folder=folder)
    first.create_index({"fields": ["n"], "partial_filter_selector": {"n": {"$gt": 1}}}, "d", "i", path=str(tmp_path / "copy"))
    again = Collection(df, folder=folder)
    assert again.get_indexes() == first.get_indexes() and again.create_index({"fields": ["n"]}, "d", "i")["result"] == "exists"
    assert sorted(ids(again, {"n": {"$gt": 0}}, use_index=["d", "i"])) == [2, 3, 6, 7]
    again.delete_index("d", "i")
    assert len(Collection(df, folder=folder).get_indexes()["indexes"]) == 1 and not (tmp_path / "copy").exists()
