import pytest

from quern.errors import QueryError
from quern.operators.gql import gql


def rows(df, query):
    return sorted((r.asDict() for r in gql(df, query).collect()), key=str)


@pytest.fixture(scope="module")
def boats(spark):
    return spark.createDataFrame([(60, 30, 2.5, "north", True), (45, 55, 2.5, "south", None), (8, 16, 25.0, "north", None)], "load int, crew int, speed double, port string, sail boolean")


# The printed example of a select clause, and what it gives.
EXAMPLE = [("pencil", 2.0, 0.7, "store1"), ("pen", 3.0, 2.0, "store2")]
SELECTED = [{"name!": "pen", "price - discount": 1.0, "upper(vendor)": "STORE2"}, {"name!": "pencil", "price - discount": 1.3, "upper(vendor)": "STORE1"}]


def test_select_where(spark, boats):
    shop = spark.createDataFrame(EXAMPLE, "`name!` string, price double, discount double, vendor string")
    assert rows(shop, {"select": "`name!`, price-discount, upper(vendor)"}) == SELECTED
    assert [r["load"] for r in rows(boats, {"select": "*", "where": "load <=crew * speed + 2 and (crew - 6 !=  20/2)"})] == [45, 60]
    assert [r["load"] for r in rows(boats, {"select": "load", "where": "port='north' and sail is not null"})] == [60]
    assert [r["load"] for r in rows(boats, {"select": "load", "where": "not (sail = true) and load > -1"})] == [45, 8]
    assert rows(boats, {"select": "nothing, 1/0", "where": "load = 8"}) == [{"nothing": None, "1 / 0": None}]


def test_group(boats):
    assert rows(boats, {"select": "max(load), speed", "groupBy": "speed"}) == [{"max(load)": 60, "speed": 2.5}, {"max(load)": 8, "speed": 25.0}]
    (all_,) = rows(boats, {"select": "max(load), min(load), average(load), count(load), sum(load)"})
    assert all_ == {"max(load)": 60, "min(load)": 8, "average(load)": pytest.approx(113 / 3), "count(load)": 3, "sum(load)": 113}


def test_pivot(boats):
    assert rows(boats, {"select": "max(load)", "pivot": "port"}) == [{"north max(load)": 60, "south max(load)": 45}]
    both = rows(boats, {"select": "upper(port), max(load), count(load)", "groupBy": "port", "pivot": "speed", "label": "max(load) 'top'"})
    assert both[0] == {"upper(port)": "NORTH", "2.5 top": 60, "2.5 count(load)": 1, "25.0 top": 8, "25.0 count(load)": 1}


def test_label(boats):
    assert rows(boats, {"select": "upper(port), load", "label": "upper(port) 'Port', load 'Heaviest Load!'"})[-1] == {"Port": "SOUTH", "Heaviest Load!": 45}


@pytest.mark.parametrize(
    "query",
    [
        {"select": "a, max(b)"}, {"select": "max(a)", "groupBy": "b", "pivot": "b"}, {"select": "max(max(a))"}, {"select": "upper(a - b)"}, {"select": "a where"}, {"select": "limit"},
        {"select": "a", "where": "max(a) > 1"}, {"select": "a", "orderBy": "a"}, {"select": "a b"}, {"select": "a", "label": "b 'x'"}, {"where": "a = 1"}, {"select": "a", "where": "a = ?"},
    ],
)
def test_errors(boats, query):
    with pytest.raises(QueryError):
        gql(boats, query)
