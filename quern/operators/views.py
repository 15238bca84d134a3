"""Map/reduce views: emitted (key, value) rows in the order of their keys, with grouped reducers.

A map is declared with Columns (Emit) and stays in the engine, or is a Python function that runs in Arrow batches. Keys
are single Columns or lists of Columns (array keys), or VARIANTs of any type, which are turned into binary keys in the
order of JSON values while a query runs. The built-in reducers are aggregates with partial sums on the map side; a custom
reducer sees all keys and values of its group at once, so its groups must fit a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.errors import NotFound, QueryError
from quern.functions import collate
from quern.operators.alldocs import UNSET, envelope, page

BUILT_IN = ("_count", "_sum", "_stats")
#: Options that hold keys.
KEYS = ("key", "keys", "startkey", "endkey", "start_key", "end_key")


@dataclass(frozen=True)
class Emit:
    """One emitted row of a document: its key (a Column, or a list of Columns), its value, and when it is emitted."""

    key: Column | Sequence[Column]
    value: Column | None = None
    when: Column | None = None


@dataclass(frozen=True)
class ViewSpec:
    emits: Sequence[Emit]
    reduce: str | Callable[[list, list, bool], Any] | None = None
    reduce_type: str = "double"


def built_in(name: str) -> str:
    """The reducer that a string names; white space and what follows it don't count."""
    found = re.match(r"\s*(_\w+)", name)
    if not found or found[1] not in BUILT_IN:
        raise QueryError(f"unknown built-in reducer: {name}", "invalid_reduce")
    return found[1]


def array_key(columns: Sequence[Column]) -> Column:
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns)))


def map_rows(df: DataFrame, spec: ViewSpec, id_col: str = "_id") -> DataFrame:
    """(id, key, value): all emitted rows; several emits of a document come from one pass over it."""
    null = F.lit(None)
    rows = [F.when(e.when if e.when is not None else F.lit(True), F.struct((e.key if isinstance(e.key, Column) else array_key(e.key)).alias("key"), (e.value if e.value is not None else null).alias("value"))) for e in spec.emits]
    if len(rows) == 1:
        single = df.select(F.col(f"`{id_col}`").alias("id"), rows[0].alias("r"))
        return finite(single.filter("r IS NOT NULL").select("id", "r.key", "r.value"))
    each = df.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r"))
    return finite(each.select("id", "r.key", "r.value"))


def finite(rows: DataFrame) -> DataFrame:
    """Keys that are numbers but not finite count as null."""

    def own(c: Column, kind: T.DataType) -> Column:
        return F.when(F.abs(c) < float("inf"), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c

    kind = rows.schema["key"].dataType
    if isinstance(kind, T.StructType):
        if any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in kind.fields):
            return rows.withColumn("key", F.struct(*(own(F.col("key").getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
        return rows
    return rows.withColumn("key", own(F.col("key"), kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else rows


@F.pandas_udf(T.StringType())
def _key_json(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: json.dumps(collate.decode(bytes(k)), ensure_ascii=False) if k is not None else None)


def truncated(level: int) -> Callable[[Column], Column]:
    """Binary keys of arrays cut to so many elements; other keys stay whole."""

    @F.pandas_udf(T.BinaryType())
    def cut(keys: pd.Series) -> pd.Series:
        values = keys.map(lambda k: collate.decode(bytes(k)))
        return values.map(lambda v: collate.encode(v[:level] if isinstance(v, list) else v))

    return cut


def map_python(df: DataFrame, function: Callable[[dict, Callable[..., None]], None], key_type: str, value_type: str, id_col: str = "_id", errors: Any = None) -> DataFrame:
    """(id, key, value) from a Python function of (document, emit). A document on which it raises emits nothing.

    errors: an accumulator that counts such documents.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc in frame.to_dict("records"):
                own: list[tuple] = []
                try:
                    function(doc, lambda key=None, value=None, own=own, doc=doc: own.append((doc[id_col], key, value)))
                except Exception:  # noqa: BLE001  such documents are skipped
                    if errors is not None:
                        errors.add(1)
                    continue
                out += own
            yield pd.DataFrame(out, columns=["id", "key", "value"])

    return df.mapInPandas(run, f"id {kind}, key {key_type}, value {value_type}")


def restrict(rows: DataFrame, options: dict) -> DataFrame:
    """key, keys, startkey, endkey, inclusive_end on emitted rows. Array keys are given as lists, shorter ones as prefixes."""
    kind = rows.schema["key"].dataType
    o = {{"start_key": "startkey", "end_key": "endkey"}.get(k, k): v for k, v in options.items()}
    key, down, inclusive = F.col("key"), bool(o.get("descending")), o.get("inclusive_end", True)

    def compare(x: Any, above: bool, equal: bool) -> Column:
        """Whether the key is above (or below) x."""
        if not isinstance(kind, T.StructType):
            y = F.lit(x)
            return {(True, True): key >= y, (True, False): key > y, (False, True): key <= y, (False, False): key < y}[above, equal]
        top = bool(x) and x[-1] == {}
        parts = x[:-1] if top else x
        head = [key.getField(kind.names[i]) for i in range(len(parts))]
        # A prefix comes before what it begins; {} as the last element stands above all of it.
        result = F.lit((above and not top and (equal or len(parts) < len(kind.names))) or (not above and (top or (equal and len(parts) == len(kind.names)))))
        for c, y in reversed(list(zip(head, parts, strict=True))):
            result = (c > F.lit(y)) | ((c == F.lit(y)) & result) if above else (c < F.lit(y)) | ((c == F.lit(y)) & result)
        return result

    def equals(x: Any) -> Column:
        if x is None:
            return key.isNull()
        if isinstance(kind, T.StructType):
            return F.lit(len(x) == len(kind.names)) & (F.array(*[key.getField(n).eqNullSafe(F.lit(y)) for n, y in zip(kind.names, x, strict=False)]) == F.array(*[F.lit(True)] * min(len(x), len(kind.names))))
        return key == F.lit(x)

    if o.get("key", UNSET) is not UNSET:
        rows = rows.filter(equals(o["key"]))
    if o.get("startkey", UNSET) is not UNSET and o["startkey"] is not None:
        rows = rows.filter(compare(o["startkey"], not down, True))
    if o.get("endkey", UNSET) is not UNSET and o["endkey"] is not None:
        end = compare(o["endkey"], down, inclusive)
        # Null keys come before all others.
        rows = rows.filter(end if down else F.coalesce(end, F.lit(True)))
    return rows


def by_keys(rows: DataFrame, keys: Sequence[Any]) -> DataFrame:
    """Rows of the given keys in their order, with duplicates; keys that aren't there are left out. Adds __pos."""
    kind = rows.schema["key"].dataType.simpleString()
    asked = rows.sparkSession.createDataFrame([(i, tuple(k) if isinstance(k, list) else k) for i, k in enumerate(keys)], f"__pos int, key {kind}")
    return rows.withColumnRenamed("key", "__key").join(F.broadcast(asked), F.col("__key").eqNullSafe(F.col("key"))).drop("__key")


def level_of(options: dict) -> int | None:
    """The group level: None for whole keys, 0 for one group."""
    if options.get("group") and "group_level" not in options:
        return None
    level = options.get("group_level", 0)
    if isinstance(level, bool) or not str(level).isdigit():
        raise QueryError(f"group_level must be a number from 0 on: {level}")
    return int(level)


def group_key(rows: DataFrame, level: int | None) -> Column:
    kind = rows.schema["key"].dataType
    if level == 0:
        return F.lit(None).cast("string")
    if level is not None and isinstance(kind, T.BinaryType):
        return truncated(level)(F.col("key"))
    if level is None or not isinstance(kind, T.StructType) or level >= len(kind.names):
        return F.col("key")
    return F.struct(*(F.col("key").getField(n).alias(n) for n in kind.names[:level]))


def numbers(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.NullType)) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType))


def reduced(rows: DataFrame, reducer: str | Callable, level: int | None, reduce_type: str = "double") -> DataFrame:
    """(key, value) per group of emitted rows."""
    rows = rows.withColumn("__group", group_key(rows, level))
    kind = rows.schema["value"].dataType
    if callable(reducer):
        return custom(rows, reducer, reduce_type)
    name = built_in(reducer)
    if name != "_count" and isinstance(kind, T.VariantType):
        return mixed(rows, name)
    if name != "_count" and not numbers(kind):
        raise QueryError(f"the {name} reducer takes numbers or lists of numbers, not {kind.simpleString()}", "invalid_value", 500)
    v = F.col("value")
    if name == "_count":
        return rows.groupBy("__group").agg(F.count("*").alias("value")).withColumnRenamed("__group", "key")
    if isinstance(kind, T.ArrayType):
        return element_wise(rows, name)
    agg = F.coalesce(F.sum(v), F.lit(0)) if name == "_sum" else stats(v)
    return rows.groupBy("__group").agg(agg.alias("value")).withColumnRenamed("__group", "key")


def stats(v: Column) -> Column:
    return F.struct(F.sum(v).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v * v).alias("sumsqr"))


def element_wise(rows: DataFrame, name: str) -> DataFrame:
    """Sums or statistics of lists, element by element. Sums take lists of any length; statistics only equal ones."""
    each = rows.select("__group", F.size("value").alias("__n"), F.posexplode_outer("value").alias("__i", "__v"))
    per = each.groupBy("__group", "__i").agg((F.sum("__v") if name == "_sum" else stats(F.col("__v"))).alias("x"), F.min("__n").alias("__low"), F.max("__n").alias("__high"))
    whole = per.groupBy("__group").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "x")))), lambda s: s["x"]).alias("value"), F.min("__low").alias("__low"), F.max("__high").alias("__high"))
    if name == "_stats":
        whole = whole.withColumn("value", F.when(F.col("__low") == F.col("__high"), F.col("value")).otherwise(F.raise_error(F.lit("the _stats reducer takes lists of one length"))))
    return whole.select(F.col("__group").alias("key"), "value")


def mixed(rows: DataFrame, name: str) -> DataFrame:
    """Sums or statistics of VARIANT values: numbers, or lists of numbers. To a sum, a number is a list of one."""
    v = F.col("value")
    rank, parts = collate.variant_rank(v), F.try_variant_get(v, "$", "array<variant>")
    good = F.when(rank == collate.NUMBER, True).when(rank == collate.ARRAY, F.forall(parts, lambda x: F.coalesce(collate.variant_rank(x) == collate.NUMBER, F.lit(False))))
    listed = F.when(rank == collate.NUMBER, F.array(F.try_variant_get(v, "$", "double"))).otherwise(F.try_variant_get(v, "$", "array<double>"))
    error = F.raise_error(F.concat(F.lit(f"the {name} reducer takes numbers or lists of numbers, not "), F.coalesce(F.to_json(v), F.lit("null"))))
    known = rows.select("__group", F.when(F.coalesce(good, F.lit(False)), listed).otherwise(error.cast("array<double>")).alias("value"), (rank == collate.ARRAY).alias("__list"))
    kinds = known.groupBy("__group").agg(F.max("__list").alias("__any"), F.min("__list").alias("__all")).withColumnRenamed("__group", "__kind")
    out = element_wise(known, name).join(kinds, F.col("key").eqNullSafe(F.col("__kind")))
    if name == "_stats":
        out = out.withColumn("__any", F.when(F.col("__any") == F.col("__all"), F.col("__any")).otherwise(F.raise_error(F.lit("the _stats reducer takes either numbers or lists")).cast("boolean")))
    shown = F.when(F.col("__any"), F.to_json("value")).otherwise(F.to_json(F.array(F.element_at("value", 1))))
    bare = F.when(F.col("__any"), shown).otherwise(F.expr("substring(x, 2, length(x) - 2)"))
    return out.withColumn("x", shown).select("key", F.parse_json(bare).alias("value"))


def custom(rows: DataFrame, reducer: Callable[[list, list, bool], Any], reduce_type: str) -> DataFrame:
    """A Python reducer of (keys, values, rereduce=False), keys being [key, id] pairs in order. One that raises gives null.

    Rows are dealt by group and sorted once; a task then walks through many groups of a batch, holding one at a time.
    """
    group = rows.schema["__group"].dataType.simpleString()
    made = to_arrow_type(T._parse_datatype_string(reduce_type))
    dealt = rows.select("__group", "key", "id", "value").repartition("__group").sortWithinPartitions("__group", "key", "id")

    def shown(key: Any) -> Any:
        return list(key.values()) if isinstance(key, dict) else collate.decode(bytes(key)) if isinstance(key, (bytes, bytearray)) else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values = None, [], []

        def finish() -> tuple[Any, Any]:
            try:
                return now, reducer(keys, values, False)
            except Exception:  # noqa: BLE001  the group's row stays
                return now, None

        def batch_of(out: list[tuple[Any, Any]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], kind), pa.array([v for _, v in out], made)], ["key", "value"])

        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for name, key, id_, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if keys:
                        out.append(finish())
                    now, keys, values = name, [], []
                keys.append([shown(key), id_])
                values.append(value)
            if out:
                yield batch_of(out)
        if keys:
            yield batch_of([finish()])

    return dealt.mapInArrow(run, f"key {group}, value {reduce_type}")


def query(df: DataFrame, view: ViewSpec | DataFrame, id_col: str = "_id", reduce: Any = None, **options: Any) -> DataFrame:
    """Query a view: a ViewSpec over df, or rows (id, key, value) that are materialised or mapped already.

    Without a reducer: id, key, value (and doc with include_docs) in the order of keys and ids. With one: key, value.
    """
    spec = view if isinstance(view, ViewSpec) else ViewSpec(())
    rows = map_rows(df, view, id_col) if isinstance(view, ViewSpec) else view
    reducer = spec.reduce if reduce in (None, True) else reduce
    keys, grouped = options.get("keys"), options.get("group") or "group_level" in options
    if reducer and keys is not None and not options.get("group"):
        raise QueryError("Multi-key fetches for reduce views must use {group: true}")
    if grouped and not reducer:
        raise QueryError("Invalid use of grouping on a map view")
    if isinstance(rows.schema["key"].dataType, T.VariantType):
        # The same query over binary keys; missing keys are null.
        coded = rows.withColumn("key", F.coalesce(collate.binary_key(F.col("key")), F.lit(collate.encode(None))))
        given = {k: ([collate.encode(x) for x in v] if k == "keys" else collate.encode(v)) if k in KEYS and v is not UNSET else v for k, v in options.items()}
        out = query(df, coded, id_col, reducer or False, **given)
        key = F.parse_json(_key_json(F.col("key"))) if reducer is None or not reducer or level_of(options) != 0 else F.parse_json(F.lit("null"))
        return out.select(*(key.alias(c) if c == "key" else F.col(c) for c in out.columns))
    down = bool(options.get("descending"))
    rows = restrict(rows, options)
    if keys is not None:
        if any(k in options for k in ("startkey", "endkey", "start_key", "end_key", "key")):
            raise QueryError("Query parameter `keys` is not compatible with `key`, `startkey` or `endkey`")
        rows = by_keys(rows, list(keys)[::-1] if down else keys)
    if reducer:
        out = reduced(rows.drop("__pos") if keys is not None else rows, reducer, level_of(options), spec.reduce_type)
        if keys is not None:
            return page(by_keys(out, keys).orderBy("__pos").select("key", "value"), options)
        return page(out.orderBy(F.col("key").desc() if down else F.col("key").asc()), options)
    # With keys, rows come in the order of the list, and of their ids for each key.
    sort = [F.col("__pos")] if keys is not None else [F.col("key").desc() if down else F.col("key").asc()]
    out = page(rows.orderBy(*sort, F.col("id").desc() if down else F.col("id").asc()), options)
    if options.get("include_docs"):
        out = include_docs(out, df, id_col, sort)
    return out.drop("__pos")


def result(df: DataFrame, view: ViewSpec | DataFrame, id_col: str = "_id", update_seq: int | None = None, **options: Any) -> dict:
    """query() as one small result: rows, and for map rows total_rows and offset."""
    rows = query(df, view, id_col, **options)
    if "id" not in rows.columns:
        return envelope(rows, update_seq=update_seq)
    whole = map_rows(df, view, id_col) if isinstance(view, ViewSpec) else view
    return envelope(rows, whole.count(), int(options.get("skip", 0)), update_seq)


def include_docs(rows: DataFrame, df: DataFrame, id_col: str, sort: list[Column]) -> DataFrame:
    """Add doc: the document that the value names by its _id, or else the emitting one."""
    kind = rows.schema["value"].dataType
    of = F.coalesce(F.col("value").getField("_id"), F.col("id")) if isinstance(kind, T.StructType) and "_id" in kind.names else F.col("id")
    docs = df.select(F.col(f"`{id_col}`").alias("__of"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"))
    return rows.withColumn("__doc", of).join(docs, F.col("__doc") == F.col("__of"), "left").drop("__doc", "__of").orderBy(*sort, "id")


class Views:
    """Named views of a collection, kept as sorted rows in files and refreshed on reading unless stale is given.

    version: what tells states of the collection apart, such as a store's last sequence; a view of the same state isn't
    refreshed. changed: the ids (a column id) that have changed since a version; then only their rows are mapped anew.
    Each refresh is a folder of its own, named by its number, the collection's version and the definition; what is there
    is found again by another session. The last two stay, so that readers of the old one can finish.
    """

    def __init__(self, df: Callable[[], DataFrame], folder: str, id_col: str = "_id", version: Callable[[], int] | None = None, changed: Callable[[int], DataFrame] | None = None):
        self.df, self.folder, self.id_col, self.marker, self.changed = df, folder, id_col, version, changed
        self.specs: dict[str, ViewSpec] = {}
        self.version: dict[str, int] = {}
        self.listeners: list[Callable[[dict], None]] = []

    def on_indexing(self, listener: Callable[[dict], None]) -> None:
        """Tell the listener of each refresh: the view's name and version."""
        self.listeners.append(listener)

    def define(self, name: str, spec: ViewSpec) -> None:
        self.specs[name] = spec

    def _files(self) -> tuple[Any, Any]:
        spark = self.df().sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._files()
        return [f.getPath().getName() for f in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []

    def _kept(self, name: str) -> list[tuple[int, int | None, str]]:
        """(number, the collection's version, definition) of all complete refreshes of a view, in order."""
        fs, path = self._files()
        found = [(int(n), None if v == "none" else int(v), d) for n, v, d in (x.split("_") for x in self._names(f"{self.folder}/{name}") if x.count("_") == 2 and x[0].isdigit())]
        return sorted((x for x in found if fs.exists(path(f"{self._path(name, x)}/_SUCCESS"))), key=lambda x: x[0])

    def _path(self, name: str, kept: tuple[int, int | None, str]) -> str:
        return f"{self.folder}/{name}/{kept[0]}_{'none' if kept[1] is None else kept[1]}_{kept[2]}"

    def refresh(self, name: str) -> tuple[int, int | None, str]:
        """Bring the view up to date: write its rows, sorted by key, and only then let readers see them."""
        spec, kept = self.specs[name], self._kept(name)
        made = hashlib.md5("|".join(f"{e.key}{e.value}{e.when}" for e in spec.emits).encode()).hexdigest()[:8]
        marker, last = self.marker() if self.marker else None, kept[-1] if kept else None
        same = last is not None and last[2] == made and None not in (last[1], marker)
        if same and last[1] == marker:
            self.version[name] = last[0]
            return last
        df = self.df()
        if same and self.changed is not None:
            ids = self.changed(last[1]).select("id").distinct()
            new = map_rows(df.join(ids.withColumnRenamed("id", self.id_col), self.id_col, "left_semi"), spec, self.id_col)
            rows = df.sparkSession.read.parquet(self._path(name, last)).join(ids, "id", "left_anti").unionByName(new)
        else:
            rows = map_rows(df, spec, self.id_col)
        fresh = (last[0] + 1 if last else 1), marker, made
        ordered = rows if isinstance(rows.schema["key"].dataType, T.VariantType) else rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
        ordered.write.mode("overwrite").parquet(self._path(name, fresh))
        fs, path = self._files()
        for old in kept[:-1]:
            fs.delete(path(self._path(name, old)), True)
        self.version[name] = fresh[0]
        for listener in self.listeners:
            listener({"view": name, "version": fresh[0]})
        return fresh

    def query(self, name: str, stale: str | None = None, **options: Any) -> DataFrame:
        """stale: 'ok' reads what is there, 'update_after' refreshes afterwards."""
        if name not in self.specs:
            raise NotFound(f"no view {name}")
        if stale not in (None, "ok", "update_after"):
            raise QueryError(f"invalid value for stale: {stale}")
        kept = self._kept(name) if stale else []
        last = kept[-1] if kept else self.refresh(name)
        spec, df = self.specs[name], self.df()
        rows = df.sparkSession.read.parquet(self._path(name, last))
        out = query(df, rows, self.id_col, options.pop("reduce", spec.reduce), **options)
        if stale == "update_after":
            self.refresh(name)
        return out

    def cleanup(self) -> list[str]:
        """Delete the files of views that are no longer defined; their names."""
        fs, path = self._files()
        gone = sorted(n for n in self._names(self.folder) if n not in self.specs)
        for n in gone:
            fs.delete(path(f"{self.folder}/{n}"), True)
            self.version.pop(n, None)
        return gone
