from hypothesis import given
from hypothesis import strategies as st

from quern.functions import collate
from quern.sources.adapters import memory

# Keys in their order.
KEYS = [
    None, False, True, -1.7976931348623157e308, -300, -100, -2.5, -1, -0.0001, -5e-324, 0, 5e-324, 0.1, 1, 1.5, 2, 10, 100, 1.7976931348623157e308,
    "", "1", "10", "100", "2", "20", "[]", "foo", "mo", "moe", "moz", "mozilla", "mozzy",
    [], [None], [None, None], [None, "foo"], [False], [False, 100], [True], [0], [0, None], [0, 1], [0, ""], [0, "foo"], ["", ""], ["foo"], ["foo", 1],
    {}, {"0": None}, {"0": False}, {"0": True}, {"0": 0}, {"0": 1}, {"0": "bar"}, {"0": "foo"}, {"0": "foo", "1": False}, {"0": "foo", "1": 0}, {"0": "foo", "1": "0"}, {"0": "quux"}, {"1": "foo"},
]

JSON = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet=st.characters(exclude_categories=("Cs",))), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3, alphabet="ab\0\1"), x, max_size=3), max_leaves=8)


def test_order():
    keys = [collate.encode(k) for k in KEYS]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert collate.compare(["test", "test"], ["test\0"]) == -1 and collate.compare(float("nan"), None) == 0


@given(JSON)
def test_round_trip(value):
    assert collate.encode(collate.decode(collate.encode(value))) == collate.encode(value)
    assert collate.compare(collate.decode(collate.encode(value)), value) == 0


@given(st.lists(JSON, max_size=3), st.lists(JSON, min_size=1, max_size=2))
def test_prefix_before(a, more):
    assert collate.compare(a, a + more) == -1


def test_variants(spark):
    scalars = [k for k in KEYS if not isinstance(k, (list, dict)) and not (isinstance(k, float) and (abs(k) > 1e300 or 0 < abs(k) < 1e-300))]
    df = memory(spark, [{"_id": f"{i:03d}", "k": k} for i, k in reversed(list(enumerate(scalars)))]).selectExpr("_id", "variant_get(doc, '$.k') AS k")
    assert [r[0] for r in df.orderBy(collate.scalar_key(df["k"])).collect()] == [f"{i:03d}" for i in range(len(scalars))]
    df = memory(spark, [{"_id": f"{i:03d}", "k": k} for i, k in reversed(list(enumerate(KEYS)))]).selectExpr("_id", "variant_get(doc, '$.k') AS k")
    assert [r[0] for r in df.orderBy(collate.binary_key(df["k"])).collect()] == [f"{i:03d}" for i in range(len(KEYS))]
