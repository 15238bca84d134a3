"""find: selector, fields, sort, skip, limit over a DataFrame of documents."""

from __future__ import annotations

import json as json_text
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.functions import collate
from quern.plans.indexes import ALL_DOCS, WARNING, Catalog, Index, key_range, parse_fields, state_of
from quern.plans.selector import Compiler, Typed, Variant, compile_selector, normal_form, parse_path, validate

DEFAULT_LIMIT = 25


@dataclass
class Request:
    """A checked request. limit None means all rows."""

    selector: dict
    fields: list[str] | None
    sort: tuple[tuple[str, str], ...]
    limit: int | None
    skip: int
    use_index: Any

    @classmethod
    def parse(cls, request: dict | None) -> Request:
        if not isinstance(request, dict):
            raise QueryError("you must provide search parameters to find()")
        if "selector" not in request:
            raise QueryError("you must provide a selector when you find()")
        validate(request["selector"])
        fields = request.get("fields")
        if fields is not None and (not isinstance(fields, list) or not all(isinstance(f, str) for f in fields)):
            raise QueryError("fields must be an array of names")
        sort = parse_fields(request["sort"]) if request.get("sort") is not None else ()
        limit = number(request.get("limit", DEFAULT_LIMIT), "limit")
        return cls(request["selector"], fields, sort, limit, number(request.get("skip", 0), "skip") or 0, request.get("use_index"))


def number(x: Any, what: str) -> int | None:
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float, str)) or not str(x).lstrip("-").isdigit():
        raise QueryError(f"{what} must be a number: {x}")
    if int(x) < 0:
        raise QueryError(f"{what} can't be negative: {x}")
    return int(x)


def keyed(found: DataFrame, compiler: Compiler, fields: list[tuple[str, str]]) -> DataFrame:
    """found with __key0, __key1, ...: the binary keys of sort fields that hold arrays or objects in a VARIANT, else null.

    Rows without such a value are split off first, so that they don't pass through Python.
    """
    values = {k: v for k, (name, _) in enumerate(fields) if isinstance(v := compiler.field(parse_path(name)), Variant)}
    if not values:
        return found
    nested = {k: F.coalesce(collate.variant_rank(v.column) >= collate.ARRAY, F.lit(False)) for k, v in values.items()}
    some = reduce(lambda a, b: a | b, nested.values())
    plain, rest = found.filter(~some), found.filter(some)
    for k, v in values.items():
        plain = plain.withColumn(f"__key{k}", F.lit(None).cast("binary"))
        rest = rest.withColumn(f"__key{k}", F.when(nested[k], collate.binary_key(v.column)))
    return plain.unionByName(rest)


def order(compiler: Compiler, fields: list[tuple[str, str]]) -> list[Column]:
    """Sort columns of keyed rows in the order of types and values, with the primary key last."""
    out, descending = [], bool(fields) and fields[0][1] == "desc"
    for k, (name, _) in enumerate(fields):
        value = compiler.field(parse_path(name))
        if isinstance(value, Variant):
            keys = [collate.scalar_key(value.column), F.col(f"__key{k}")]
        elif isinstance(value, Typed):
            keys = [value.column]
        else:
            keys = []
        out += [k.desc() if descending else k.asc() for k in keys]
    if not any(name == "_id" for name, _ in fields) and compiler.id_col in compiler.schema.names:
        out.append(F.col(f"`{compiler.id_col}`").desc() if descending else F.col(f"`{compiler.id_col}`").asc())
    return out


def pick(df: DataFrame, fields: list[str], compiler: Compiler) -> DataFrame:
    """Only the given paths, rebuilt as nested objects; absent ones are left out.

    Typed: columns and structs. VARIANT: one VARIANT column of that name with an object of what each document has.
    """
    tree: dict[str, Any] = {}
    for path in map(parse_path, fields):
        at = tree
        for name in path[:-1]:
            at = at.setdefault(name, {}) if isinstance(at, dict) else at
            if at is None:
                break
        if at is not None and at.get(path[-1], 0) is not None:
            at[path[-1]] = None  # a whole field takes in its parts

    def typed(value: Typed, inner: dict | None) -> Column | None:
        if inner is None:
            return value.column
        parts = []
        for name, more in inner.items():
            got = value.get(name) if isinstance(value, Typed) else None
            column = typed(got, more) if got is not None else None
            if column is not None:
                parts.append(column.alias(name))
        return F.when(value.column.isNotNull(), F.struct(*parts)) if parts else None

    def json(value: Any, inner: dict | None) -> Column:
        if inner is None:
            return F.to_json(value.column)
        parts = [F.when(j.isNotNull(), F.concat(F.to_json(F.array(F.lit(n))), F.lit(":"), j)) for n, more in inner.items() for j in [json(value.get(n), more)]]
        return F.when(F.coalesce(*parts).isNotNull(), object_json(parts)) if parts else F.lit(None).cast("string")

    def object_json(parts: list[Column]) -> Column:
        # Each part is ["name"]:json; the brackets around the name go.
        return F.concat(F.lit("{"), F.array_join(F.transform(F.filter(F.array(*parts), lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, r'^\["((?:[^"\\]|\\.)*)"\]:', '"$1":')), ","), F.lit("}"))

    if compiler.variant is None:
        columns = []
        for name, inner in tree.items():
            value = compiler.field([name])
            column = typed(value, inner) if isinstance(value, Typed) else None
            if column is not None:
                columns.append(column.alias(name))
        return df.select(*columns) if columns else df.select(F.lit(None).alias("_"))
    parts = []
    for name, inner in tree.items():
        value = compiler.field([name])
        j = F.to_json(F.array(value.column)) if isinstance(value, Typed) else json(value, inner)
        if isinstance(value, Typed):
            j = F.regexp_extract(j, r"^\[(.*)\]$", 1)
        parts.append(F.when(j.isNotNull(), F.concat(F.to_json(F.array(F.lit(name))), F.lit(":"), j)))
    return df.select(F.parse_json(object_json(parts)).alias(compiler.variant))


class Collection:
    """Documents in a DataFrame: typed columns, or an id column and one VARIANT column with all fields.

    strict: sorting needs an index on the sorted fields and a condition on them, as the request language asks.
    folder: where the definitions of indexes are kept, so that another session finds them.
    """

    def __init__(self, df: DataFrame, id_col: str = "_id", variant: str | None = None, name: str = "docs", strict: bool = False, folder: str | None = None):
        self.df, self.id_col, self.variant, self.name, self.strict = df, id_col, variant, name, strict
        self.catalog = Catalog(df.sparkSession, folder)

    def create_index(self, index: dict, ddoc: str | None = None, name: str | None = None, type: str = "json", path: str | None = None) -> dict:
        return self.catalog.create(index, ddoc, name, type, self.df, path, self.id_col)

    def get_indexes(self) -> dict:
        found = self.catalog.list()
        return {"indexes": found, "total_rows": len(found)}

    def delete_index(self, ddoc: str, name: str | None = None) -> dict:
        return self.catalog.delete(ddoc, name)

    def plan(self, request: Request) -> Index:
        index = self.catalog.choose(request.selector, request.sort, request.use_index)
        if self.strict and request.sort:
            names, required = [f for f, _ in request.sort], normal_form(request.selector)
            if names != ["_id"] and index is ALL_DOCS:
                raise QueryError(f"Cannot sort on field(s) {', '.join(names)} when using the default index", "no_usable_index")
            if names[0] not in required:
                raise QueryError(f"Cannot sort on field(s) {names[0]} when it isn't part of the selector", "no_usable_index")
        return index

    def source(self, index: Index) -> DataFrame:
        """What find reads: an index's sorted copy, unless the collection is another one than that was made of."""
        if index.path is not None and index.state == state_of(self.df):
            return self.df.sparkSession.read.parquet(index.path)
        return self.df

    def find(self, request: dict, ordered: bool = True) -> DataFrame:
        """The matching documents; in the order of sort, else of the index that was chosen, else of the primary key.

        With ordered false, a request for all documents without a sort gives them in any order, and nothing is sorted.
        """
        r = Request.parse(request)
        index = self.plan(r)
        df = self.source(index)
        compiler = Compiler(df, self.id_col, self.variant)
        found = df.filter(compiler.compile(r.selector))
        if index.partial is not None:
            found = found.filter(compile_selector(df, json_text.loads(index.partial), self.id_col, self.variant))
        if isinstance(df.schema[self.id_col].dataType, T.StringType):
            found = found.filter(~F.col(f"`{self.id_col}`").startswith("_design/"))
        by = list(r.sort) or [(f, "asc") for f in index.names if f != "_id"]
        if ordered or r.sort or r.skip or r.limit is not None:
            found = keyed(found, compiler, by).orderBy(*order(compiler, by))
        if r.skip:
            found = found.offset(r.skip)
        if r.limit is not None:
            found = found.limit(r.limit)
        found = found.drop(*(f"__key{k}" for k in range(len(by))))
        return pick(found, r.fields, compiler) if r.fields is not None else found

    def warning(self, request: dict) -> str | None:
        r = Request.parse(request)
        chosen = self.plan(r)
        return WARNING if chosen is ALL_DOCS and "_id" not in normal_form(r.selector) else None

    def explain(self, request: dict) -> dict:
        r = Request.parse(request)
        index = self.plan(r)
        return {
            "dbname": self.name, "index": index.described(), "selector": normal_form(r.selector), "fields": r.fields or "all_fields", "skip": r.skip, "limit": r.limit,
            "range": key_range(index, r.selector), "opts": {"use_index": r.use_index or [], "sort": dict(r.sort), "fields": r.fields or "all_fields"},
        }
