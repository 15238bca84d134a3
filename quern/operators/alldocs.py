"""Reads by primary key: ranges, one key, an ordered list of keys, prefixes, pages."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.operators.find import number

UNSET: Any = object()
#: Keys of a request that are looked up by a filter; more of them by a join.
FEW = 1000


def key_filter(df: DataFrame, key: str, options: dict) -> DataFrame:
    """startkey, endkey, inclusive_end, key and descending, which swaps the bounds, on a column."""
    o = {{"start_key": "startkey", "end_key": "endkey"}.get(k, k): v for k, v in options.items()}
    start, end = o.get("startkey", UNSET), o.get("endkey", UNSET)
    down, inclusive = bool(o.get("descending")), o.get("inclusive_end", True)
    column = F.col(f"`{key}`")
    if o.get("key", UNSET) is not UNSET:
        df = df.filter(column == F.lit(o["key"]))
    if start is not UNSET:
        df = df.filter(column <= F.lit(start) if down else column >= F.lit(start))
    if end is not UNSET:
        df = df.filter((column >= F.lit(end) if inclusive else column > F.lit(end)) if down else (column <= F.lit(end) if inclusive else column < F.lit(end)))
    return df


def page(df: DataFrame, options: dict) -> DataFrame:
    skip, limit = number(options.get("skip", 0), "skip"), number(options.get("limit"), "limit")
    df = df.offset(skip) if skip else df
    return df.limit(limit) if limit is not None else df


def all_docs(df: DataFrame, id_col: str = "_id", keys: Sequence[Any] | None = None, **options: Any) -> DataFrame:
    """The rows of df by primary key, ordered by it.

    keys: an ordered list, with duplicates; each gives a row with __pos and __error ('not_found' where there is none).
    """
    if keys is not None:
        if any(k in options for k in ("startkey", "endkey", "start_key", "end_key", "key")):
            raise QueryError("Query parameter `keys` is not compatible with `key`, `startkey` or `endkey`")
        kind = df.schema[id_col].dataType
        listed = list(keys)[::-1] if options.get("descending") else list(keys)
        asked = df.sparkSession.createDataFrame([(listed,)], f"k array<{kind.simpleString()}>").select(F.posexplode("k").alias("__pos", id_col))
        if len(listed) <= FEW:
            # A filter that reaches the scan; as keys are unique, no more rows than that come back to be broadcast.
            met = F.broadcast(df.filter(F.col(f"`{id_col}`").isin(listed)).withColumn("__found", F.lit(True)))
        else:
            met = df.join(asked.select(id_col).distinct(), id_col, "left_semi").withColumn("__found", F.lit(True))
        found = asked.join(met, id_col, "left")
        return page(found.withColumn("__error", F.when(F.col("__found").isNull(), "not_found")).drop("__found").orderBy("__pos"), options)
    column = F.col(f"`{id_col}`")
    return page(key_filter(df, id_col, options).orderBy(column.desc() if options.get("descending") else column.asc()), options)


def prefix(df: DataFrame, start: str, id_col: str = "_id", **options: Any) -> DataFrame:
    """Rows whose key begins with start, ordered by it."""
    return all_docs(df.filter(F.col(f"`{id_col}`").startswith(start)), id_col, **options)


def next_page(df: DataFrame, last: Any, size: int, id_col: str = "_id") -> DataFrame:
    """The page behind the key last (None for the first), without counting what came before."""
    column = F.col(f"`{id_col}`")
    return (df.filter(column > F.lit(last)) if last is not None else df).orderBy(column).limit(size)


def envelope(rows: DataFrame, total_rows: int | None = None, skip: int = 0, update_seq: int | None = None) -> dict:
    """A small result as a dict: rows, with total_rows and offset unless it is reduced (total_rows None)."""
    out: dict = {} if total_rows is None else {"total_rows": total_rows, "offset": skip}
    if update_seq is not None:
        out["update_seq"] = update_seq
    return out | {"rows": [r.asDict(recursive=True) for r in rows.collect()]}
