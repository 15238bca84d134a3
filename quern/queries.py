"""Registered queries of the engine's own operators, each over whole tables, with the same result in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.alldocs import all_docs, next_page, prefix
from quern.operators.find import Collection
from quern.operators.gql import gql
from quern.operators.replicate import merge, replicate, revs_diff, sync
from quern.operators.views import Emit, Views, ViewSpec, map_rows, query
from quern.plans.selector import compile_selector
from quern.store import DocStore, leaves, rev, winners
from quern.streaming.changes import Changes, feed, views_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


# find
@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 ORDER BY l_orderkey, l_linenumber LIMIT 100")
def find_eq_range_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Collection(table(spark, sf_dir, "lineitem"), id_col="l_linenumber")
    return docs.find({"selector": {"l_returnflag": "R", "l_quantity": {"$gt": 45}}, "fields": ["l_orderkey", "l_linenumber", "l_quantity"], "sort": ["l_orderkey", "l_linenumber"], "limit": 100})


def filtered(spark: SparkSession, sf_dir: str, name: str, selector: dict, id_col: str, fields: list[str]) -> DataFrame:
    """All matching rows of a table, through find without a limit."""
    return Collection(table(spark, sf_dir, name), id_col=id_col).find({"selector": selector, "fields": fields, "limit": None}, ordered=False)


@registered("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' AND o_orderstatus IS NOT NULL")
def find_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "orders", {"o_orderstatus": {"$ne": "O"}}, "o_orderkey", ["o_orderkey", "o_orderstatus"])


@registered("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal <= 5000")
def find_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "customer", {"c_acctbal": {"$gte": 1000, "$lte": 5000}}, "c_custkey", ["c_custkey", "c_acctbal"])


@registered("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND (o_totalprice < 20000 OR o_orderstatus = 'P'))")
def find_or_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    selector = {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}, {"o_orderpriority": "1-URGENT", "$or": [{"o_totalprice": {"$lt": 20000}}, {"o_orderstatus": "P"}]}]}
    return filtered(spark, sf_dir, "orders", selector, "o_orderkey", ["o_orderkey"])


@registered("SELECT c_custkey FROM customer WHERE NOT (coalesce(c_mktsegment = 'BUILDING', false) OR coalesce(c_acctbal > 3000, false))")
def find_nor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "customer", {"$nor": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$gt": 3000}}]}, "c_custkey", ["c_custkey"])


@registered("SELECT p_partkey FROM part WHERE NOT coalesce(p_size > 20, false) AND NOT coalesce(p_brand = 'Brand#11', false)")
def find_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "part", {"p_size": {"$not": {"$gt": 20}}, "$not": {"p_brand": "Brand#11"}}, "p_partkey", ["p_partkey"])


@registered("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) AND l_returnflag IN ('A', 'N')")
def find_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "lineitem", {"l_linenumber": {"$in": [1, 3, "1"]}, "l_returnflag": {"$in": ["A", "N"]}}, "l_orderkey", ["l_orderkey", "l_linenumber"])


@registered("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def find_nin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "events", {"event_type": {"$nin": ["click", "view"]}}, "event_id", ["event_id", "event_type"])


@registered("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 7 = 3")
def find_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "lineitem", {"l_partkey": {"$mod": [7, 3]}}, "l_orderkey", ["l_orderkey", "l_partkey"])


@registered("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(small|blue) .*[gt]$|dget$')")
def find_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "part", {"p_name": {"$regex": "^(small|blue) .*[gt]$|dget$"}}, "p_partkey", ["p_partkey", "p_name"])


@registered("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def find_exists_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "documents", {"lang": {"$exists": True}, "text": {"$type": "string"}, "nothing": {"$exists": False}}, "doc_id", ["doc_id"])


@registered("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def find_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "orders", {"o_orderdate": {"$gte": "1995-01-01T00:00:00", "$lt": "1996-01-01T00:00:00"}}, "o_orderkey", ["o_orderkey", "o_orderdate"])


ORDER_FLAGS = "WITH o AS (SELECT l_orderkey AS id, list_sort(list(l_returnflag)) AS flags, list_sort(list(l_quantity)) AS quantities FROM lineitem GROUP BY 1) SELECT id FROM o WHERE "


def orders_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_returnflag")).alias("flags"), F.array_sort(F.collect_list("l_quantity")).alias("quantities"))


def of_orders(spark: SparkSession, sf_dir: str, selector: dict) -> DataFrame:
    return Collection(orders_as_documents(spark, sf_dir), id_col="id").find({"selector": selector, "fields": ["id"], "limit": None}, ordered=False)


@registered(ORDER_FLAGS + "list_contains(flags, 'A') AND list_contains(flags, 'N')")
def find_array_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_orders(spark, sf_dir, {"flags": {"$all": ["A", "N"]}})


@registered(ORDER_FLAGS + "len(flags) = 3")
def find_array_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_orders(spark, sf_dir, {"flags": {"$size": 3}})


@registered(ORDER_FLAGS + "len(list_filter(quantities, lambda x: x > 48 AND x < 50)) > 0")
def find_array_elem_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_orders(spark, sf_dir, {"quantities": {"$elemMatch": {"$gt": 48, "$lt": 50}}})


@registered(ORDER_FLAGS + "len(quantities) > 0 AND len(list_filter(quantities, lambda x: x < 40)) = len(quantities)")
def find_array_all_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_orders(spark, sf_dir, {"quantities": {"$allMatch": {"$lt": 40}}})


@registered(ORDER_FLAGS + "list_contains(flags, 'R') AND NOT list_contains(flags, 'A')")
def find_array_in_nin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_orders(spark, sf_dir, {"flags": {"$in": ["R"], "$nin": ["A", "B"]}})


@registered("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 25")
def find_default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "customer"), id_col="c_custkey").find({"selector": {"c_nationkey": 7}, "fields": ["c_custkey", "c_name"]})


@registered("SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20 OFFSET 40")
def find_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "part"), id_col="p_partkey").find({"selector": {"p_size": {"$gte": 10}}, "fields": ["p_partkey", "p_retailprice"], "sort": [{"p_retailprice": "desc"}], "skip": 40, "limit": 20})


@registered("SELECT o.o_orderkey AS id, c.c_name AS name, c.c_mktsegment AS segment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY' AND o.o_totalprice > 50000")
def find_fields_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    docs = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("_id"), F.struct(F.col("o_totalprice").alias("total"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer")).alias("order"))
    found = Collection(docs).find({"selector": {"order": {"customer": {"segment": "MACHINERY"}, "total": {"$gt": 50000}}}, "fields": ["_id", "order.customer.name", "order.customer.segment"], "limit": None}, ordered=False)
    return found.select(F.col("_id").alias("id"), F.col("order.customer.name").alias("name"), F.col("order.customer.segment").alias("segment"))


@registered("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 90 OR (props->>'$.k')::BIGINT % 10 = 5")
def find_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    found = docs.filter(compile_selector(docs, {"$or": [{"k": {"$gte": 90}}, {"k": {"$mod": [10, 5]}}]}, "event_id", "doc"))
    return found.select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


MIXED = "CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN event_id::VARCHAR WHEN 3 THEN '\"' || event_type || '\"' ELSE '[1]' END"


@registered(f"WITH m AS (SELECT event_id, event_id % 5 AS kind, {MIXED} AS j FROM events) SELECT event_id, j FROM m WHERE kind IN (0, 1) OR (kind = 2 AND event_id < 500)")
def find_cross_type_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    j = F.when(kind == 0, "null").when(kind == 1, "true").when(kind == 2, F.col("event_id").cast("string")).when(kind == 3, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("[1]")
    docs = events.select("event_id", j.alias("j")).withColumn("doc", F.parse_json(F.concat(F.lit('{"x":'), "j", F.lit("}"))))
    return docs.filter(compile_selector(docs, {"x": {"$lt": 500}}, "event_id", "doc")).select("event_id", "j")


# Reads by primary key
@registered("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_orderkey")
def alldocs_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_docs(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", startkey=100, endkey=900, inclusive_end=False)


@registered("WITH k AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 7), (3, -1)) v(pos, c_custkey)) SELECT k.pos, k.c_custkey::BIGINT AS c_custkey, c.c_name, CASE WHEN c.c_custkey IS NULL THEN 'not_found' END AS error FROM k LEFT JOIN customer c ON c.c_custkey = k.c_custkey")
def alldocs_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_docs(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", keys=[7, 3, 7, -1])
    return rows.select(F.col("__pos").alias("pos"), "c_custkey", "c_name", F.col("__error").alias("error"))


@registered("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <= 60 AND s_suppkey >= 5 ORDER BY s_suppkey DESC LIMIT 30 OFFSET 2")
def alldocs_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_docs(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", startkey=60, endkey=5, descending=True, skip=2, limit=30)


@registered("SELECT p_name, p_partkey FROM part WHERE starts_with(p_name, 'b') ORDER BY p_name")
def alldocs_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "b", "p_name")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 250 ORDER BY o_orderkey LIMIT 50")
def alldocs_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 250, 50, "o_orderkey")


# Views
def by_flag(value: Column, reduce: str) -> ViewSpec:
    return ViewSpec([Emit([F.col("l_returnflag"), F.col("l_linestatus")], value)], reduce)


@registered("SELECT l_returnflag AS k0, l_linestatus AS k1, count(*) AS value FROM lineitem GROUP BY ALL")
def view_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "lineitem"), by_flag(F.lit(1), "_count"), "l_orderkey", group=True).select("key.k0", "key.k1", "value")


@registered("SELECT l_returnflag AS k0, l_linestatus AS k1, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL")
def view_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "lineitem"), by_flag(F.col("l_quantity"), "_sum"), "l_orderkey", group=True).select("key.k0", "key.k1", money("value").alias("value"))


@registered("SELECT l_returnflag AS k0, l_linestatus AS k1, round(sum(l_quantity), 2) AS sum, count(l_quantity) AS count, min(l_quantity) AS min, max(l_quantity) AS max, round(sum(l_quantity * l_quantity), 2) AS sumsqr FROM lineitem GROUP BY ALL")
def view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = query(table(spark, sf_dir, "lineitem"), by_flag(F.col("l_quantity"), "_stats"), "l_orderkey", group=True)
    return out.select("key.k0", "key.k1", money("value.sum").alias("sum"), "value.count", "value.min", "value.max", money("value.sumsqr").alias("sumsqr"))


def by_date(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    orders, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    return query(orders, ViewSpec([Emit([F.year(d), F.month(d), F.dayofmonth(d)], F.col("o_totalprice"))], "_sum"), "o_orderkey", group_level=level)


@registered("SELECT year(o_orderdate)::INT AS k0, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def view_group_level_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_date(spark, sf_dir, 1).select("key.k0", money("value").alias("value"))


@registered("SELECT year(o_orderdate)::INT AS k0, month(o_orderdate)::INT AS k1, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
def view_group_level_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_date(spark, sf_dir, 2).select("key.k0", "key.k1", money("value").alias("value"))


@registered("SELECT label, i - 1 AS i, round(sum(x), 3) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def view_sum_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec([Emit(F.col("label"), F.col("embedding").cast("array<double>"))], "_sum")
    out = query(table(spark, sf_dir, "embeddings"), spec, "vec_id", group=True).select(F.col("key").alias("label"), F.posexplode("value").alias("i", "x"))
    return out.select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 3).alias("value"))


@registered("SELECT label, i - 1 AS i, round(sum(x), 3) AS sum, count(x) AS count, round(min(x), 5) AS min, round(max(x), 5) AS max FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def view_stats_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec([Emit(F.col("label"), F.col("embedding").cast("array<double>"))], "_stats")
    out = query(table(spark, sf_dir, "embeddings"), spec, "vec_id", group=True).select(F.col("key").alias("label"), F.posexplode("value").alias("i", "x"))
    return out.select("label", F.col("i").cast("bigint").alias("i"), F.round("x.sum", 3).alias("sum"), "x.count", F.round("x.min", 5).alias("min"), F.round("x.max", 5).alias("max"))


def placed(df: DataFrame) -> DataFrame:
    """df, as read from its files, with __place: where a row stands in them, files in the order of their paths."""
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # One row per file is left here.
    files = rows.select("__file").distinct().withColumn("__nth", F.row_number().over(Window.orderBy("__file")).cast("bigint"))
    return rows.join(F.broadcast(files), "__file").withColumn("__place", F.shiftleft("__nth", 40) + F.col("__row")).drop("__file", "__nth", "__row")


def joined(keys: list, values: list, rereduce: bool) -> str | None:
    """A reducer that joins texts; missing ones don't count."""
    there = [v for v in values if v is not None]
    return ",".join(there) if there else None


@registered("SELECT l_orderkey AS key, string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ',' ORDER BY l_linenumber) AS value FROM lineitem GROUP BY 1")
def view_custom_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one number in an order aren't unique: they stay as they stand in the files, however rows are dealt."""
    lines = placed(table(spark, sf_dir, "lineitem")).withColumn("_id", F.struct("l_linenumber", "__place"))
    value = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), "l_returnflag")
    spec = ViewSpec([Emit(F.col("l_orderkey"), value)], joined, "string")
    return query(lines, spec, group=True)


@registered("SELECT o.o_orderkey AS id, o.o_orderstatus AS key, c.c_name AS name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000")
def view_linked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    docs = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("_id"), "o_orderkey", "o_orderstatus", "o_totalprice", F.concat(F.lit("c"), "o_custkey").alias("customer"), F.lit(None).cast("string").alias("name")).unionByName(
        customers.select(F.concat(F.lit("c"), "c_custkey").alias("_id"), F.col("c_name").alias("name")), allowMissingColumns=True
    )
    spec = ViewSpec([Emit(F.col("o_orderstatus"), F.struct(F.col("customer").alias("_id"), "o_orderkey"), F.col("o_totalprice") > 100000)])
    return query(docs, spec, include_docs=True).select(F.col("value.o_orderkey").alias("id"), "key", F.col("doc.name").alias("name"))


@registered("SELECT o_orderkey AS k0, 0 AS k1, 'order' AS value FROM orders UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def view_complex_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parents = map_rows(orders, ViewSpec([Emit([F.col("o_orderkey"), F.lit(0)], F.lit("order"))]), "o_orderkey")
    children = map_rows(lines, ViewSpec([Emit([F.col("l_orderkey"), F.col("l_linenumber")], F.col("l_returnflag"))]), "l_orderkey")
    return query(orders, parents.unionByName(children)).select("key.k0", "key.k1", "value")


@registered("SELECT c_custkey AS id, 'nation' AS k0, c_nationkey::VARCHAR AS k1 FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_acctbal > 0")
def view_emit_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    spec = ViewSpec([Emit([F.lit("nation"), F.col("c_nationkey").cast("string")]), Emit([F.lit("segment"), F.col("c_mktsegment")], None, F.col("c_acctbal") > 0)])
    return query(customers, spec, "c_custkey").select("id", "key.k0", "key.k1")


@registered("SELECT c_nationkey AS key, c_custkey AS id FROM customer WHERE c_nationkey BETWEEN 3 AND 6")
def view_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "customer"), ViewSpec([Emit(F.col("c_nationkey"))]), "c_custkey", startkey=3, endkey=6).select("key", "id")


@registered("SELECT k.pos, c_nationkey AS key, count(*) AS value FROM (VALUES (0, 5), (1, 2)) k(pos, n) JOIN customer ON c_nationkey = k.n GROUP BY ALL")
def view_keys_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = query(table(spark, sf_dir, "customer"), ViewSpec([Emit(F.col("c_nationkey"))], "_count"), "c_custkey", keys=[5, 2, 999], group=True)
    return out.select(F.when(F.col("key") == 5, 0).otherwise(1).alias("pos"), "key", "value")


# The query language
@registered("SELECT upper(p_brand) AS \"upper(p_brand)\", p_retailprice - p_size AS rest FROM part WHERE (p_size > 10 AND p_type IS NOT NULL) AND NOT p_brand = 'Brand#11'")
def gql_select_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gql(table(spark, sf_dir, "part"), {"select": "upper(p_brand), p_retailprice - p_size", "where": "(p_size > 10 and p_type is not null) and not p_brand = 'Brand#11'", "label": "p_retailprice - p_size 'rest'"})


@registered("SELECT o_orderstatus, count(o_orderkey) AS n, max(o_totalprice) AS top, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def gql_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gql(table(spark, sf_dir, "orders"), {"select": "o_orderstatus, count(o_orderkey), max(o_totalprice), avg(o_totalprice)", "groupBy": "o_orderstatus", "label": "count(o_orderkey) 'n', max(o_totalprice) 'top', avg(o_totalprice) 'mean'"})
    return out.withColumn("mean", F.round("mean", 4))


@registered("SELECT l_linestatus, max(l_quantity) FILTER (l_returnflag = 'A') AS \"A max(l_quantity)\", max(l_quantity) FILTER (l_returnflag = 'N') AS \"N max(l_quantity)\", max(l_quantity) FILTER (l_returnflag = 'R') AS \"R max(l_quantity)\" FROM lineitem GROUP BY 1")
def gql_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gql(table(spark, sf_dir, "lineitem"), {"select": "l_linestatus, max(l_quantity)", "groupBy": "l_linestatus", "pivot": "l_returnflag"})


@registered("SELECT lower(c_mktsegment) AS \"Segment\", c_acctbal AS \"Balance!\" FROM customer")
def gql_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gql(table(spark, sf_dir, "customer"), {"select": "lower(c_mktsegment), c_acctbal", "label": "lower(c_mktsegment) 'Segment', c_acctbal 'Balance!'"})


# The change feed and revisions
LATEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"


@registered(LATEST)
def changes_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@registered(LATEST + " AND event_id > 400 ORDER BY event_id LIMIT 60")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", since=400, limit=60)


@registered(LATEST + " AND event_type IN ('purchase', 'signup')")
def changes_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", selector={"event_type": {"$in": ["purchase", "signup"]}})


REVISIONS = """WITH r AS (SELECT DISTINCT user_id::VARCHAR AS id, (1 + event_id % 3)::INT AS gen, md5(user_id::VARCHAR || ':' || (event_id % 3)::VARCHAR || CASE WHEN event_id % 3 = 2 THEN ':' || (event_id % 2)::VARCHAR ELSE '' END) AS hash,
  (event_id % 3 = 2 AND event_id % 2 = 1) AS deleted, CASE WHEN event_id % 3 > 0 THEN md5(user_id::VARCHAR || ':' || (event_id % 3 - 1)::VARCHAR) END AS parent FROM events)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision trees made of events: three generations of a user's document, the third in two branches, one deleted."""
    e = table(spark, sf_dir, "events")
    user, n = F.col("user_id").cast("string"), F.col("event_id") % 3
    hash_ = F.md5(F.concat(user, F.lit(":"), n.cast("string"), F.when(n == 2, F.concat(F.lit(":"), (F.col("event_id") % 2).cast("string"))).otherwise("")))
    parent = F.when(n > 0, F.md5(F.concat(user, F.lit(":"), (n - 1).cast("string"))))
    rows = e.select(user.alias("id"), (n + 1).cast("int").alias("gen"), hash_.alias("hash"), ((n == 2) & (F.col("event_id") % 2 == 1)).alias("deleted"), parent.alias("parent"))
    path = F.when(F.col("parent").isNull(), F.array("hash")).otherwise(F.array("hash", "parent"))
    return rows.distinct().select("id", "gen", "hash", path.alias("path"), "deleted", F.lit("{}").alias("body"), F.lit(1).alias("seq"))


LEAVES = REVISIONS + ", l AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r c WHERE c.id = r.id AND c.gen = r.gen + 1 AND c.parent = r.hash))"


@registered(LEAVES + ", w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY deleted, gen DESC, hash DESC) AS n FROM l) SELECT id, gen::VARCHAR || '-' || hash AS rev, deleted FROM w WHERE n = 1")
def conflicts_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winners(revisions(spark, sf_dir)).select("id", F.concat_ws("-", F.col("gen").cast("string"), "hash").alias("rev"), "deleted")


@registered(LEAVES + " SELECT id, gen, hash FROM l")
def revision_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(revisions(spark, sf_dir)).select("id", "gen", "hash")


HALVES = REVISIONS + ", a AS (SELECT id, gen, hash FROM r WHERE gen < 3), b AS (SELECT id, gen, hash FROM r WHERE gen > 1 AND NOT deleted)"


@registered(HALVES + " SELECT * FROM b ANTI JOIN a USING (id, gen, hash)")
def revs_diff_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revisions(spark, sf_dir).select("id", "gen", "hash", "deleted")
    return revs_diff(r.filter("gen > 1 AND NOT deleted"), r.filter("gen < 3"), ("id", "gen", "hash")).drop("deleted")


@registered(HALVES + " SELECT * FROM a UNION SELECT * FROM b")
def replicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revisions(spark, sf_dir)
    return merge(r.filter("gen < 3").select("id", "gen", "hash", "path"), r.filter("gen > 1 AND NOT deleted").select("id", "gen", "hash", "path")).select("id", "gen", "hash")


# More of find
@registered("SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice < 90000")
def find_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    selector = {"$and": [{"o_totalprice": {"$gt": 50000}}, {"$or": [{"o_orderstatus": "F"}, {"o_orderstatus": "P"}]}, {"o_totalprice": {"$lt": 90000}}]}
    return filtered(spark, sf_dir, "orders", selector, "o_orderkey", ["o_orderkey"])


def customers_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("_id"), "c_custkey", place.alias("place"), F.struct(place.alias("place")).alias("deep"), F.col("c_name").alias("name.full"))


def of_customers(spark: SparkSession, sf_dir: str, selector: dict) -> DataFrame:
    return Collection(customers_as_documents(spark, sf_dir)).find({"selector": selector, "fields": ["c_custkey"], "limit": None}, ordered=False)


@registered("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 10")
def find_dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_customers(spark, sf_dir, {"deep.place.segment": "BUILDING", "deep.place.nation": {"$gt": 10}, "deep.nothing.more": {"$exists": False}})


@registered("SELECT c_custkey FROM customer WHERE c_name >= 'Customer#000000100'")
def find_escaped_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_customers(spark, sf_dir, {"name\\.full": {"$gte": "Customer#000000100"}, "name.full": {"$exists": False}})


@registered("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def find_eq_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_customers(spark, sf_dir, {"place": {"$eq": {"nation": 3, "segment": "BUILDING"}}})


@registered("SELECT n_nationkey, n_name FROM nation")
def find_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "nation", {}, "n_nationkey", ["n_nationkey", "n_name"])


@registered("SELECT n_nationkey FROM nation WHERE false")
def find_empty_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, "nation", {"n_name": {}}, "n_nationkey", ["n_nationkey"])


@registered("SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def find_id_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on the primary key that aren't strings: below them is nothing, above them everything."""
    return of_customers(spark, sf_dir, {"$or": [{"_id": {"$lt": False}}, {"_id": {"$lte": {}}}, {"_id": {"$gte": []}, "place.nation": {"$lt": 5}}]})


@registered("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def find_without_design_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "_design/").otherwise("c"), "c_custkey").alias("_id"), "c_custkey")
    return Collection(docs).find({"selector": {}, "fields": ["c_custkey"], "limit": None}, ordered=False)


@registered("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 2000 ORDER BY c_acctbal, c_custkey LIMIT 30")
def find_index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a sort, rows come in the order of the index that was chosen."""
    docs = Collection(table(spark, sf_dir, "customer"), id_col="c_custkey")
    docs.create_index({"fields": ["c_acctbal"]})
    return docs.find({"selector": {"c_acctbal": {"$gt": 2000}}, "fields": ["c_custkey", "c_acctbal"], "limit": 30})


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def find_partial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial index that is named is read from its sorted copy, and gives only what it holds."""
    docs = Collection(table(spark, sf_dir, "orders"), id_col="o_orderkey")
    docs.create_index({"fields": ["o_totalprice"], "partial_filter_selector": {"o_orderstatus": "F"}}, "done", "by_price", path=scratch(spark))
    return docs.find({"selector": {"o_totalprice": {"$gt": 150000}}, "use_index": ["done", "by_price"], "fields": ["o_orderkey", "o_totalprice"], "limit": None}, ordered=False)


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a field of five types, as JSON text and in a VARIANT."""
    kind = F.col("event_id") % 5
    j = F.when(kind == 0, "null").when(kind == 1, "true").when(kind == 2, F.col("event_id").cast("string")).when(kind == 3, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", j.alias("j")).withColumn("doc", F.parse_json(F.concat(F.lit('{"x":'), "j", F.lit("}"))))


@registered("SELECT event_id FROM events WHERE event_id % 5 IN (0, 3)")
def find_variant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixed_events(spark, sf_dir)
    return docs.filter(compile_selector(docs, {"$or": [{"x": {"$type": "string"}}, {"x": {"$type": "null"}}]}, "event_id", "doc")).select("event_id")


@registered("SELECT event_id FROM events ORDER BY CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END DESC, event_id DESC LIMIT 50")
def find_variant_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixed_events(spark, sf_dir).select("event_id", "doc")
    return Collection(docs, "event_id", "doc").find({"selector": {}, "sort": [{"x": "desc"}], "limit": 50}).select("event_id")


# More reads by primary key
@registered("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey")
def alldocs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_docs(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 32")
def alldocs_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_docs(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", key=32)


# More of views
@registered("SELECT CASE WHEN c_custkey % 4 < 3 THEN NULL ELSE c_nationkey::DOUBLE END AS key, count(*) AS value FROM customer GROUP BY 1")
def view_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing keys and numbers that aren't finite are null."""
    n = F.col("c_custkey") % 4
    key = F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("-inf"))).when(n == 3, F.col("c_nationkey").cast("double"))
    return query(table(spark, sf_dir, "customer"), ViewSpec([Emit(key)], "_count"), "c_custkey", group=True)


@registered("SELECT c_nationkey AS key, count(*) AS value FROM customer GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 3")
def view_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "customer"), ViewSpec([Emit(F.col("c_nationkey"))], "_count"), "c_custkey", group=True, skip=3, limit="5")


@registered("SELECT c_custkey AS id, c_nationkey AS key, c_name AS name FROM customer WHERE c_nationkey = 7")
def view_include_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query(table(spark, sf_dir, "customer"), ViewSpec([Emit(F.col("c_nationkey"))], "_count"), "c_custkey", reduce=False, key=7, include_docs=True)
    return rows.select("id", "key", F.col("doc.c_name").alias("name"))


@registered("SELECT NULL::VARCHAR AS key, round(sum(o_totalprice), 2) AS value FROM orders")
def view_global_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = query(table(spark, sf_dir, "orders"), ViewSpec([Emit(F.col("o_orderstatus"), F.col("o_totalprice"))], "_sum\n of all"), "o_orderkey")
    return out.select("key", money("value").alias("value"))


def view_of_mixed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return query(mixed_events(spark, sf_dir), ViewSpec([Emit(F.try_variant_get("doc", "$.x", "variant"))], "_count"), "event_id", **options)


@registered(f"SELECT j AS key, count(*) AS value FROM (SELECT {MIXED} AS j FROM events) GROUP BY 1")
def view_variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_of_mixed(spark, sf_dir, group=True).select(F.to_json("key").alias("key"), "value")


@registered(f"SELECT event_id AS id, j AS key FROM (SELECT event_id, {MIXED} AS j FROM events) WHERE event_id % 5 IN (2, 3) AND (event_id % 5 = 3 OR event_id >= 100) ORDER BY event_id % 5, CASE WHEN event_id % 5 = 3 THEN j END, event_id LIMIT 400")
def view_variant_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_of_mixed(spark, sf_dir, reduce=False, startkey=100, endkey=[], limit=400).select("id", F.to_json("key").alias("key"))


@registered("SELECT '[\"' || c_mktsegment || '\"]' AS key, count(*) AS value FROM customer GROUP BY c_mktsegment")
def view_variant_group_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.parse_json(F.to_json(F.array("c_mktsegment", F.col("c_nationkey").cast("string"))))
    return query(table(spark, sf_dir, "customer"), ViewSpec([Emit(key)], "_count"), "c_custkey", group_level=1).select(F.to_json("key").alias("key"), "value")


@registered("SELECT l_returnflag AS key, '[' || sum(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 1 END)::VARCHAR || ',' || sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 2 END)::VARCHAR || ']' AS value FROM lineitem GROUP BY 1")
def view_sum_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers among lists count as lists of one."""
    value = F.when(F.col("l_linenumber") % 2 == 0, F.parse_json(F.col("l_linenumber").cast("string"))).otherwise(F.parse_json(F.lit("[1, 2]")))
    out = query(table(spark, sf_dir, "lineitem"), ViewSpec([Emit(F.col("l_returnflag"), value)], "_sum"), "l_orderkey", group=True)
    return out.select("key", F.concat(F.lit("["), F.array_join(F.try_variant_get("value", "$", "array<bigint>").cast("array<string>"), ","), F.lit("]")).alias("value"))


@registered("SELECT c_nationkey AS key, CASE WHEN max(c_acctbal) > 9000 THEN 1 ELSE 0 END::BIGINT AS n FROM customer GROUP BY 1")
def view_empty_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group whose lists are all empty keeps its row."""
    value = F.when(F.col("c_acctbal") > 9000, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    out = query(table(spark, sf_dir, "customer"), ViewSpec([Emit(F.col("c_nationkey"), value)], "_sum"), "c_custkey", group=True)
    return out.select("key", F.size("value").cast("bigint").alias("n"))


# Stores. Each query makes one in the shared folder from a table, and reads it.
def scratch(spark: SparkSession) -> str:
    """A new folder where the session's checkpoints go, or a temporary one in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{named}/quern-{uuid.uuid4().hex}"


def writes(rows: DataFrame) -> DataFrame:
    """rows (pos, id, body) with rev and deleted, if there, as bulk_docs takes them."""
    names = {"rev": F.lit(None).cast("string"), "deleted": F.lit(False)}
    more = [c.alias(n) for n, c in names.items() if n not in rows.columns]
    none = F.create_map().cast("map<string,struct<content_type:string,digest:string,length:bigint,revpos:int>>")
    return rows.select("pos", "id", "body", *(n for n in names if n in rows.columns), *more, none.alias("attachments"), F.lit(None).cast("array<string>").alias("path"), F.lit(False).alias("force"), F.lit(True).alias("valid"))


def last_revisions(store: DocStore) -> DataFrame:
    """(pos, id, rev, body) of all live documents, to be changed by writes. Positions are 64-bit: from the second partition on they pass 2^33."""
    return store.docs().select(F.monotonically_increasing_id().alias("pos"), F.col("_id").alias("id"), F.col("_rev").alias("rev"), "body")


def store_of_customers(spark: SparkSession, sf_dir: str, steps: int = 3) -> DocStore:
    """All customers; then those of ten nations once more; then every seventh is removed."""
    store = DocStore(spark, scratch(spark))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("pos"), F.col("c_custkey").cast("string").alias("id"), "c_custkey", "c_nationkey", F.to_json(F.struct(F.col("c_nationkey").alias("nation"))).alias("body"))
    for condition, deleted in (("true", False), ("c_nationkey < 10", False), ("c_custkey % 7 = 0", True))[:steps]:
        revs = store.winners().select("id", rev().alias("rev"))
        store.bulk_docs(writes(customers.filter(condition).join(revs, "id", "left").withColumn("deleted", F.lit(deleted))))
    return store


CUSTOMERS = "WITH s AS (SELECT c_custkey::VARCHAR AS id, 1 + (c_nationkey < 10)::INT + (c_custkey % 7 = 0)::INT AS gen, c_custkey % 7 = 0 AS deleted, c_nationkey AS nation, c_custkey FROM customer) "


@registered(CUSTOMERS + "SELECT id, gen, '{\"nation\":' || nation || '}' AS body FROM s WHERE NOT deleted")
def store_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of_customers(spark, sf_dir).docs().select(F.col("_id").alias("id"), F.substring_index("_rev", "-", 1).cast("int").alias("gen"), "body")


@registered(CUSTOMERS + "SELECT id, 'conflict' AS error, false AS ok FROM s WHERE gen > 1 AND NOT deleted")
def store_conflicting_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of revisions that have been changed before are refused, one by one."""
    store = store_of_customers(spark, sf_dir)
    old = store.log().filter("gen = 1").select(F.col("seq").cast("int").alias("pos"), "id", rev().alias("rev"), F.lit("{}").alias("body"))
    stale = old.join(store.docs().filter("_rev NOT LIKE '1-%'").select(F.col("_id").alias("id")), "id", "left_semi")
    return store.bulk_docs(writes(stale)).select("id", "ok", "error")


@registered(CUSTOMERS + "SELECT id, count(*) AS known, sum(kept)::BIGINT AS bodies FROM (SELECT id, (g = gen)::INT AS kept FROM s, range(1, 4) r(g) WHERE g <= gen) GROUP BY id")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions stay known; only leaves keep their bodies."""
    store = store_of_customers(spark, sf_dir)
    store.compact()
    return store.log().groupBy("id").agg(F.count("*").alias("known"), F.count("body").alias("bodies"))


@registered(CUSTOMERS + "SELECT id, gen, deleted FROM s WHERE gen > 1")
def store_changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed after the first write: each document once, with its last state."""
    store = store_of_customers(spark, sf_dir)
    first = store.log().filter("gen = 1").agg(F.max("seq")).first()[0] if not store.log().isEmpty() else 0
    changes = Changes(store).changes(since=first, style="all_docs")
    return changes.select("id", F.substring_index(F.col("changes")[0]["rev"], "-", 1).cast("int").alias("gen"), "deleted")


@registered(CUSTOMERS + "SELECT id, gen FROM s WHERE nation IN (3, 12) AND NOT deleted")
def store_changes_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = Changes(store_of_customers(spark, sf_dir)).changes(selector={"nation": {"$in": [3, 12]}})
    return changes.filter("NOT deleted").select("id", F.substring_index(F.col("changes")[0]["rev"], "-", 1).cast("int").alias("gen"))


@registered(CUSTOMERS + "SELECT k.pos, k.id, s.gen, s.deleted, CASE WHEN s.id IS NULL THEN 'not_found' END AS error FROM (VALUES (0, '7'), (1, '12'), (2, 'no'), (3, '3')) k(pos, id) LEFT JOIN s ON s.id = k.id")
def store_bulk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store_of_customers(spark, sf_dir).bulk_get([{"id": x} for x in ("7", "12", "no", "3")])
    return rows.select("pos", "id", F.substring_index("rev", "-", 1).cast("int").alias("gen"), "deleted", "error")


@registered(CUSTOMERS + "SELECT id, gen FROM s WHERE NOT deleted AND id >= '2' AND id < '4' ORDER BY id DESC LIMIT 40")
def store_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store_of_customers(spark, sf_dir).all_docs(startkey="4", endkey="2", descending=True, skip=0, limit=None)
    return rows.filter("id <> '4'").limit(40).select("id", F.substring_index("value.rev", "-", 1).cast("int").alias("gen"))


@registered(CUSTOMERS + "SELECT k.pos, k.key, s.deleted, CASE WHEN s.id IS NULL THEN 'not_found' END AS error FROM (VALUES (0, '7'), (1, '12'), (2, 'no'), (3, '7')) k(pos, key) LEFT JOIN (SELECT id, CASE WHEN deleted THEN true END AS deleted FROM s) s ON s.id = k.key")
def store_all_docs_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in their order: deleted documents are marked, unknown ones are errors."""
    rows = store_of_customers(spark, sf_dir).all_docs(keys=["7", "12", "no", "7"]).collect()
    out = [(k, r["key"], r["value"]["deleted"] if r["value"] else None, r["error"]) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, "pos int, key string, deleted boolean, error string")


@registered(CUSTOMERS + "SELECT id, gen, deleted FROM s")
def replicate_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that took the first revisions takes the last ones: what was removed or changed in between doesn't come back."""
    source, target = store_of_customers(spark, sf_dir, 1), DocStore(spark, scratch(spark))
    replicate(source, target)
    source.bulk_docs(writes(last_revisions(source).filter(F.get_json_object("body", "$.nation").cast("int") < 10)))
    source.bulk_docs(writes(last_revisions(source).filter("id % 7 = 0").withColumn("deleted", F.lit(True))))
    replicate(source, target)
    return leaves(target.log()).select("id", "gen", "deleted")


@registered("SELECT c_custkey::VARCHAR AS id, (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AS changed, (c_custkey % 6 = 0) AS conflict FROM customer WHERE c_nationkey < 5")
def sync_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stores change documents, some of them the same ones; afterwards both have all changes, and the conflicts."""
    rows = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").cast("int").alias("pos"), F.col("c_custkey").cast("string").alias("id"), F.lit("{}").alias("body"))
    a, b = DocStore(spark, scratch(spark)), DocStore(spark, scratch(spark))
    a.bulk_docs(writes(rows))
    sync(a, b)
    for store, n in ((a, 2), (b, 3)):
        known = rows.join(store.docs().select(F.col("_id").alias("id"), F.col("_rev").alias("rev")), "id").filter(f"pos % {n} = 0")
        store.bulk_docs(writes(known.withColumn("body", F.lit(f'{{"by":{n}}}'))))
    sync(a, b)
    return b.winners().select("id", (F.col("gen") > 1).alias("changed"), (F.size("conflicts") > 0).alias("conflict"))


@registered(CUSTOMERS + "SELECT nation AS key, count(*) AS value FROM s WHERE NOT deleted GROUP BY 1")
def view_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept view of a store: after more writes only the documents that changed are mapped anew."""
    store = store_of_customers(spark, sf_dir, 1)
    views = views_of(store, scratch(spark))
    views.define("nations", ViewSpec([Emit(F.try_variant_get("doc", "$.nation", "int"))], "_count"))
    views.refresh("nations")
    store.bulk_docs(writes(last_revisions(store).filter("id % 7 = 0").withColumn("deleted", F.lit(True))))
    return views.query("nations", group=True)


@registered("SELECT c_nationkey AS key, count(*) AS value FROM customer GROUP BY 1")
def view_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With stale, a kept view is read as it is."""
    docs = [table(spark, sf_dir, "customer")]
    views = Views(lambda: docs[-1], scratch(spark), "c_custkey")
    views.define("nations", ViewSpec([Emit(F.col("c_nationkey"))], "_count"))
    views.refresh("nations")
    docs.append(docs[0].filter("c_nationkey > 3"))
    return views.query("nations", stale="ok", group=True)


@registered("SELECT id, n FROM (SELECT id, count(*) - 1 AS n FROM (" + LEAVES + " SELECT id FROM l WHERE NOT deleted) GROUP BY id) WHERE n > 0")
def view_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map sees the losing revisions of a document."""
    docs = winners(revisions(spark, sf_dir)).filter("NOT deleted").select(F.col("id").alias("_id"), F.col("conflicts").alias("_conflicts"))
    rows = query(docs, ViewSpec([Emit(F.size("_conflicts"), None, F.size("_conflicts") > 0)]))
    return rows.select("id", F.col("key").cast("bigint").alias("n"))


CHAINS = """WITH r AS (SELECT DISTINCT user_id::VARCHAR AS id, (1 + event_id % 5)::INT AS gen, CASE WHEN event_id % 5 < 2 THEN 0 ELSE event_id % 2 END AS branch FROM events WHERE event_id % 5 <> 2)"""


@registered(CHAINS + " SELECT id, gen, branch::INT AS branch FROM r WHERE NOT EXISTS (SELECT 1 FROM r d WHERE d.id = r.id AND d.gen > r.gen AND (r.gen < 3 OR d.branch = r.branch))")
def leaves_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of five generations with two branches from the third on; the third generation itself is unknown."""
    n, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    e = table(spark, sf_dir, "events").filter(n != 2).select(user.alias("id"), (n + 1).cast("int").alias("gen"), F.when(n < 2, 0).otherwise(F.col("event_id") % 2).cast("int").alias("branch")).distinct()
    path = F.transform(F.sequence(F.col("gen"), F.lit(1), F.lit(-1)), lambda g: F.concat_ws(":", "id", g.cast("string"), F.when(g < 3, 0).otherwise(F.col("branch")).cast("string")))
    log = e.withColumn("path", path).select("id", "gen", F.col("path")[0].alias("hash"), "path", F.lit(False).alias("deleted"), F.lit("{}").alias("body"), F.lit(1).alias("seq"))
    return leaves(log).select("id", "gen", F.element_at(F.split("hash", ":"), -1).cast("int").alias("branch"))


# More of the change feed
@registered(LATEST + " ORDER BY event_id LIMIT 1")
def changes_limit_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", limit=0)


@registered(LATEST + " AND user_id IN (3, 5, 8) ORDER BY event_id DESC")
def changes_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", descending=True, doc_ids=[3, 5, 8])


@registered(LATEST + " AND (event_id % 2 = 0) ORDER BY event_id DESC LIMIT 20")
def changes_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", descending=True, limit=20, filter=F.col("event_id") % 2 == 0)


@registered("SELECT p_partkey, p_size FROM part WHERE (p_brand <> 'Brand#11' AND p_size >= 5.5) OR p_name IS NULL")
def gql_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gql(table(spark, sf_dir, "part"), {"select": "p_partkey, `p_size`", "where": '(p_brand <> "Brand#11" and `p_size` >= 5.5) or p_name is null'})
