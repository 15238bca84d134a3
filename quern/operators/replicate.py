"""Replication: what a target lacks of a source's revisions is written to it; merging is a union, so order doesn't matter."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import NotFound
from quern.plans.selector import compile_selector
from quern.store import BLOBS, LOG, DocStore, leaves, rev, winners


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two sets of revisions (id, gen, hash, ...): commutative, associative and idempotent.

    Of two rows of one revision the one with the longer known ancestry stays (stemmed branches connect again).
    """
    both = a.unionByName(b, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("id", "gen", "hash")]
    length = F.size("path") if "path" in both.columns else F.lit(0)
    return both.groupBy("id", "gen", "hash").agg(F.max_by(F.struct(*columns), length).alias("r")).select("id", "gen", "hash", "r.*") if columns else both.distinct()


def stem(revs: DataFrame, limit: int) -> DataFrame:
    """Ancestries cut to the newest revisions."""
    return revs.withColumn("path", F.slice("path", 1, limit))


def revs_diff(asked: DataFrame, there: DataFrame, on: Sequence[str] = ("id", "rev")) -> DataFrame:
    """The asked revisions that aren't there."""
    return asked.join(there.select(*on), list(on), "left_anti")


def replication_id(source: str, target: str, filter: str | None = None, doc_ids: Sequence[str] | None = None, query_params: dict | None = None, selector: dict | None = None, view: str | None = None) -> str:
    """What a checkpoint is kept under: the ends and everything that decides which changes pass."""
    what = {"source": source, "target": target, "filter": filter, "view": view, "doc_ids": sorted(doc_ids) if doc_ids else None, "query_params": query_params, "selector": selector}
    return "_local/" + hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()


def backoff(last: float, most: float = 600.0, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait before another try: up to 2 at first, then growing, never above most."""
    if not last:
        return draw() * 2
    low = min(last, most / 2)
    return min(most, low + draw() * (low + 0.5))


def replicate(
    source: DocStore, target: DocStore, selector: dict | None = None, doc_ids: Sequence[str] | None = None, filter: Any = None, since: int | None = None, checkpoint: str | bool = True,
    batch_size: int = 100_000, retry: int = 0, on: Callable[[str, dict], None] = lambda event, what: None,
) -> dict:
    """One-shot replication, in batches of so many changes; resumes from the checkpoint that both ends remember.

    Revisions that the target's accept condition refuses count as failures and raise the event denied.
    """
    name = replication_id(source.folder, target.folder, None if filter is None else str(filter), doc_ids, None, selector)
    result = {"ok": True, "docs_read": 0, "docs_written": 0, "doc_write_failures": 0, "last_seq": 0, "status": "complete"}
    start = since if since is not None else min(_checkpoint(source, name), _checkpoint(target, name)) if checkpoint else 0
    wait = 0.0
    task = {"type": "replication", "source": source.name, "target": target.name}
    while True:
        source.tasks.append(task)
        try:
            on("active", {})
            high = source.update_seq()
            while start < high:
                end = min(high, start + batch_size)
                read, written = _batch(source, target, start, end, selector, doc_ids, filter, on)
                result["docs_read"] += read
                result["docs_written"] += written
                result["doc_write_failures"] += read - written
                start = end
                if checkpoint:
                    for store in (source, target):
                        _remember(store, name, end)
                    on("checkpoint", {"checkpoint": end})
                on("change", result | {"last_seq": end})
            break
        except Exception as e:
            on("error", {"error": str(e)})
            if not retry:
                raise
            retry, wait = retry - 1, backoff(wait)
            on("paused", {"seconds": wait})
            time.sleep(wait)
        finally:
            source.tasks.remove(task)
    result["last_seq"] = max(start, 0)
    on("complete", result)
    return result


class Replication:
    """A live replication: what is written to the source's log goes to the target, micro-batch by micro-batch, until cancel()."""

    def __init__(self, source: DocStore, target: DocStore, folder: str, on: Callable[[str, dict], None] = lambda event, what: None, **options: Any):
        self.on, self.result = on, {"ok": True, "docs_read": 0, "docs_written": 0, "doc_write_failures": 0, "last_seq": 0, "status": "active"}
        stream = source.spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{source.folder}/log")

        def run(batch: DataFrame, _: int) -> None:
            # A repeated batch finds its changes at the target already.
            done = replicate(source, target, on=lambda event, what: on(event, what) if event in ("denied", "change") else None, **options)
            for k in ("docs_read", "docs_written", "doc_write_failures"):
                self.result[k] += done[k]
            self.result["last_seq"] = done["last_seq"]
            on("paused", {})

        on("active", {})
        self.query = stream.writeStream.foreachBatch(run).option("checkpointLocation", folder).trigger(processingTime="1 second").start()

    def cancel(self) -> dict:
        """Stop after what is there now has been handed on."""
        self.query.processAllAvailable()
        self.query.stop()
        self.result["status"] = "cancelled"
        self.on("complete", self.result)
        return self.result


def _batch(source: DocStore, target: DocStore, start: int, end: int, selector: dict | None, doc_ids: Sequence[str] | None, filter: Any, on: Callable[[str, dict], None]) -> tuple[int, int]:
    """How many revisions were read and written of the documents whose last change lies after start and up to end."""
    whole = source.log()
    touched = whole.filter((F.col("seq") > start) & (F.col("seq") <= end))
    if doc_ids is not None:
        touched = touched.filter(F.col("id").isin(list(doc_ids)))
    # Only the documents that changed in this range are read whole; those that change again later come with that batch.
    log = whole.join(touched.select("id").distinct(), "id", "left_semi")
    changed = winners(log).filter(F.col("last_seq") <= end)
    if selector is not None or filter is not None:
        changed = changed.withColumn("doc", F.parse_json("body"))
        if selector is not None:
            changed = changed.filter(compile_selector(changed, selector, "id", "doc"))
        if filter is not None:
            changed = changed.filter(filter)
    wanted = leaves(log).join(changed.select("id"), "id", "left_semi")
    there = target.log().join(touched.select("id").distinct(), "id", "left_semi")
    missing = revs_diff(wanted.withColumn("rev", rev()), there.withColumn("rev", rev()))
    held = target._held(missing.withColumn("pos", F.col("seq")).withColumn("__ok", F.coalesce(target.accept(F.parse_json("body")), F.lit(False)) if target.accept else F.lit(True)))
    n, good = held.agg(F.count("*"), F.count_if("__ok")).first()
    if n > good:
        on("denied", {"docs": [r["id"] for r in held.filter("NOT __ok").select("id").limit(100).collect()]})
    if good:
        new = held.filter("__ok").drop("__ok")
        blobs = new.filter("attachments IS NOT NULL").select(F.explode(F.map_values("attachments"))).select("col.digest").distinct()
        if source._exists("blobs"):
            there = target._table("blobs", BLOBS)
            target._append("blobs", source._table("blobs", BLOBS).join(blobs, "digest", "left_semi").join(there, "digest", "left_anti"))
        target._store_revisions(new)
    target._release()
    return n, good


def _checkpoint(store: DocStore, name: str) -> int:
    try:
        return store.get_local(name)["last_seq"]
    except NotFound:
        return 0


def _remember(store: DocStore, name: str, seq: int) -> None:
    try:
        old = store.get_local(name)["_rev"]
    except NotFound:
        old = None
    store.put_local({"_id": name, "last_seq": seq} | ({"_rev": old} if old else {}))


def sync(a: DocStore, b: DocStore, push: dict | None = None, pull: dict | None = None, **options: Any) -> dict:
    """Replication both ways; push and pull have options of their own."""
    return {"push": replicate(a, b, **(options | (push or {}))), "pull": replicate(b, a, **(options | (pull or {})))}


def same_state(a: DocStore, b: DocStore) -> bool:
    """Whether both stores have the same leaves."""
    columns = [c for c in LOG.names if c in ("id", "gen", "hash", "deleted", "body")]
    x, y = leaves(a.log()).select(*columns), leaves(b.log()).select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
