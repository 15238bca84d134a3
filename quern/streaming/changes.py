"""The change feed of a log: one row per document with its latest change, by sequence; in batches or as a stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.errors import QueryError
from quern.operators.find import number
from quern.operators.views import Views, ViewSpec
from quern.plans.selector import compile_selector
from quern.store import DocStore, leaves, rev, winners


def latest(log: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """The last row of each document in any log: one aggregate, combined before its shuffle."""
    columns = [c for c in log.columns if c != id_col]
    return log.groupBy(id_col).agg(F.max_by(F.struct(*columns), F.col(seq_col)).alias("__r")).select(id_col, "__r.*")


def feed(log: DataFrame, id_col: str = "id", seq_col: str = "seq", since: int = 0, limit: int | None = None, descending: bool = False, selector: dict | None = None, filter: Column | None = None, doc_ids: Sequence[Any] | None = None) -> DataFrame:
    """Changes of a typed log after a sequence, one row per document, in order. A limit of 0 gives one row."""
    if selector is not None and filter is not None:
        raise QueryError("a selector can't be given with a filter")
    rows = latest(log, id_col, seq_col).filter(F.col(seq_col) > since)
    if selector is not None:
        rows = rows.filter(compile_selector(rows, selector, id_col))
    if filter is not None:
        rows = rows.filter(filter)
    if doc_ids is not None:
        rows = rows.filter(F.col(id_col).isin(list(doc_ids)))
    rows = rows.orderBy(F.col(seq_col).desc() if descending else F.col(seq_col).asc())
    return rows.limit(max(1, limit)) if limit is not None else rows


def passes(function: Callable[[dict], bool]) -> Callable[..., Column]:
    """A Python filter of documents as a Column; it sees batches of them. A document on which it raises doesn't pass."""

    def one(id_: str, body: str | None, deleted: bool) -> bool:
        try:
            return bool(function({"_id": id_} | json.loads(body or "{}") | ({"_deleted": True} if deleted else {})))
        except Exception:  # noqa: BLE001  as a map that raises emits nothing
            return False

    @F.pandas_udf("boolean")
    def run(ids: pd.Series, bodies: pd.Series, deleted: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(ids, bodies, deleted, strict=True)], dtype=bool)

    return run


class Changes:
    """The feed of a store."""

    def __init__(self, store: DocStore):
        self.store = store
        self.filters: dict[str, Callable[[dict], Column]] = {}

    def filter(self, name: str, made: Callable[[dict], Column]) -> None:
        """Name a filter: a function of the query parameters that gives a Column on id, body (VARIANT doc) and deleted."""
        self.filters[name] = made

    def changes(
        self, since: int | str = 0, limit: int | None = None, descending: bool = False, include_docs: bool = False, conflicts: bool = False, attachments: bool = False, style: str = "main_only",
        doc_ids: Sequence[str] | None = None, selector: dict | None = None, filter: str | Column | None = None, query_params: dict | None = None, view: ViewSpec | None = None, log: DataFrame | None = None,
    ) -> DataFrame:
        """Rows id, seq, changes (revisions), deleted, and doc, conflicts and attachments (stubs) if asked for.

        The filter '_view' passes documents of which the view emits a row. A filter may be a Column, or a Python function
        of the document as a dict.
        """
        if selector is not None and filter is not None and not (isinstance(filter, str) and filter == "_selector"):
            raise QueryError("a selector can't be given with a filter")
        if style not in ("main_only", "all_docs"):
            raise QueryError(f"unknown style {style}")
        log = self.store.log() if log is None else log
        start = self.store.update_seq() if since in ("now", "latest") else number(since, "since") or 0
        rows = winners(log).filter(F.col("last_seq") > start).withColumn("doc", F.parse_json("body"))
        if doc_ids is not None:
            rows = rows.filter(F.col("id").isin(list(doc_ids)))
        if selector is not None:
            rows = rows.filter(compile_selector(rows, selector, "id", "doc"))
        if isinstance(filter, str) and filter == "_view":
            if view is None:
                raise QueryError("the filter _view needs a view", "bad_request")
            filter = reduce(lambda a, b: a | b, [F.coalesce(e.when, F.lit(False)) if e.when is not None else F.lit(True) for e in view.emits])
        if isinstance(filter, str) and filter not in ("_selector", "_doc_ids"):
            if filter not in self.filters:
                raise QueryError(f"no filter {filter}", "not_found", 404)
            filter = self.filters[filter](query_params or {})
        if isinstance(filter, Column):
            rows = rows.filter(filter)
        elif callable(filter):
            rows = rows.filter(passes(filter)(F.col("id"), F.col("body"), F.col("deleted")))
        if style == "all_docs":
            tips = leaves(log).groupBy("id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("gen", "hash")))), lambda x: F.struct(F.concat_ws("-", x["gen"].cast("string"), x["hash"]).alias("rev"))).alias("changes"))
            rows = rows.join(tips, "id")
        else:
            rows = rows.withColumn("changes", F.array(F.struct(rev().alias("rev"))))
        out = rows.select("id", F.col("last_seq").alias("seq"), "changes", "deleted", *(["doc"] if include_docs else []), *(["conflicts"] if conflicts else []), *(["attachments"] if attachments else []))
        out = out.orderBy(F.col("seq").desc() if descending else F.col("seq").asc())
        return out.limit(max(1, number(limit, "limit"))) if limit is not None else out

    def live(self, on_change: Callable[[DataFrame], None], checkpoint: str, once: bool = False, on_complete: Callable[[], None] | None = None, files: int = 1000, **options: Any) -> StreamingQuery:
        """Give each micro-batch of new changes to on_change; stop() on the result cancels. once: what is there now, then stop.

        The stream reads the log's new files. A batch names the documents that changed; their state is read from the log,
        so that a repeated batch gives the same rows or newer ones.
        """
        schema = self.store.log().schema
        stream = self.store.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{self.store.folder}/log")

        def run(batch: DataFrame, _: int) -> None:
            ids = batch.select("id").distinct()
            changed = self.changes(log=self.store.log().join(ids, "id", "left_semi"), **options)
            on_change(changed)

        writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(f"changes-{uuid.uuid4().hex[:8]}")
        query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
        if once:
            query.awaitTermination()
            if on_complete:
                on_complete()
        return query


def views_of(store: DocStore, folder: str) -> Views:
    """Views of a store's documents (_id, _rev, doc, _conflicts), refreshed by what changed."""

    def changed(since: int) -> DataFrame:
        return store.log().filter(F.col("seq") > since).select("id")

    return Views(lambda: store.docs(variant=True, conflicts=True), folder, version=store.update_seq, changed=changed)
