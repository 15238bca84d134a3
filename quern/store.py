"""A document store: an append-only log of revisions in Parquet, read as DataFrames.

The log has a row per revision: id, gen and hash (its name is gen-hash), path (its hash and those of its ancestors,
newest first), deleted, body (JSON text; null once compacted), attachments, and seq, the position of the write that
brought it. Each write appends files, with one writer at a time. What rewrites a table (compacting, purging) writes a new
version of it in a folder of its own and then names it in the manifest, by an empty file that is made in one step: readers
take the last version that is named, so that a crash leaves the old one in place. The leaves of a document are its
revisions that no other one descends from, however many revisions between them are unknown; the winner is the leaf that
isn't deleted, then of the greatest generation, then of the greatest hash.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import NotFound, QueryError
from quern.operators.alldocs import FEW, all_docs


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRING, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
ATTACHMENT = struct(("content_type", STRING), ("digest", STRING), ("length", LONG), ("revpos", INT))
ATTACHMENTS = T.MapType(STRING, ATTACHMENT)
LOG = struct(("id", STRING), ("gen", INT), ("hash", STRING), ("path", T.ArrayType(STRING)), ("deleted", BOOL), ("body", STRING), ("attachments", ATTACHMENTS), ("seq", LONG))
LOCAL = struct(("id", STRING), ("rev", INT), ("body", STRING), ("deleted", BOOL), ("at", LONG))
BLOBS = struct(("digest", STRING), ("data", T.BinaryType()))
WRITES = struct(("pos", INT), ("id", STRING), ("rev", STRING), ("deleted", BOOL), ("body", STRING), ("attachments", ATTACHMENTS), ("path", T.ArrayType(STRING)), ("force", BOOL), ("valid", BOOL))
REVS_LIMIT, REVS_MOST = 1000, (1 << 31) - 1


def rev(gen: str | Column = "gen", hash: str | Column = "hash") -> Column:
    return F.concat_ws("-", F.col(gen).cast("string") if isinstance(gen, str) else gen.cast("string"), F.col(hash) if isinstance(hash, str) else hash)


def revision_hash(parent: Column, deleted: Column, body: Column) -> Column:
    """A deterministic hash: the same change of the same revision has the same name everywhere."""
    return F.md5(F.concat_ws("\u0001", F.coalesce(parent, F.lit("")), deleted.cast("string"), F.coalesce(body, F.lit(""))).cast("binary"))


def leaves(log: DataFrame) -> DataFrame:
    """Revisions that no other revision of the document has among its ancestors; one row each.

    Whole ancestries count, as the revisions in between may be missing here. Ancestors that many revisions share are
    combined before the shuffle.
    """
    once = log.groupBy("id", "gen", "hash").agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("id", "gen", "hash")]), "seq").alias("r")).select("id", "gen", "hash", "r.*")
    above = log.filter(F.size("path") > 1).select("id", "gen", F.posexplode(F.slice("path", 2, REVS_MOST)).alias("pos", "hash"))
    ancestors = above.select("id", (F.col("gen") - 1 - F.col("pos")).cast("int").alias("gen"), "hash").distinct()
    return once.join(ancestors, ["id", "gen", "hash"], "left_anti")


def winners(log: DataFrame) -> DataFrame:
    """One row per document: its winning revision, with conflicts (other live leaves, newest first) and last_seq."""
    rank = F.struct((~F.col("deleted")).alias("live"), F.col("gen"), F.col("hash"))
    found = leaves(log)
    live = F.filter(F.collect_list(F.when(~F.col("deleted"), F.struct("gen", "hash"))), lambda x: x.isNotNull())
    best = found.groupBy("id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "id"]), rank).alias("r"), live.alias("live"), F.max("seq").alias("last_seq"))
    out = best.select("id", "r.*", "live", "last_seq")
    others = F.filter(F.reverse(F.array_sort("live")), lambda x: (x["gen"] != F.col("gen")) | (x["hash"] != F.col("hash")))
    return out.withColumn("conflicts", F.transform(others, lambda x: F.concat_ws("-", x["gen"].cast("string"), x["hash"]))).drop("live")


class DocStore:
    """A store under a folder. Open it with the same options for the same behaviour; one writer at a time."""

    #: Listeners to the events of all stores, by event.
    watchers: dict[str, list[Callable[[dict], None]]] = {}

    def __init__(self, spark: SparkSession, folder: str, auto_compaction: bool = False, revs_limit: int = REVS_LIMIT, deterministic_revs: bool = True, purged_infos_limit: int = 1000):
        self.purged_infos_limit = purged_infos_limit
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), folder.rstrip("/").rsplit("/", 1)[-1]
        self.auto_compaction, self.revs_limit, self.deterministic = auto_compaction, revs_limit, deterministic_revs
        self.listeners: dict[str, list[Callable[[dict], None]]] = {}
        self.tasks: list[dict] = []
        self.batches: list[str] = []
        #: What replication may write here: a condition on the body (a VARIANT).
        self.accept: Callable[[Column], Column] | None = None
        self.closed = False
        self.emit("created", {"name": self.name})

    @classmethod
    def plugin(cls, methods: dict[str, Callable[..., Any]] | Callable[[type], None]) -> None:
        """Add methods to all stores; a function is given the class instead. bulk_docs may be wrapped that way."""
        if callable(methods):
            methods(cls)
        else:
            for name, method in methods.items():
                setattr(cls, name, method)

    @classmethod
    def defaults(cls, **options: Any) -> Callable[..., DocStore]:
        return lambda spark, folder, **more: cls(spark, folder, **(options | more))

    def on(self, event: str, listener: Callable[[dict], None]) -> None:
        self.listeners.setdefault(event, []).append(listener)

    @classmethod
    def watch(cls, event: str, listener: Callable[[dict], None]) -> None:
        """Listen to an event (created, destroyed) of all stores."""
        cls.watchers.setdefault(event, []).append(listener)

    def emit(self, event: str, what: dict) -> None:
        for listener in [*self.listeners.get(event, []), *self.watchers.get(event, [])]:
            listener(what)

    def close(self) -> None:
        self._release()
        self.closed = True

    def __enter__(self) -> DocStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # Files: Hadoop's file system, so that any store Spark writes to will do.
    def _fs(self) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _version(self, part: str) -> int:
        """The last version of a table that the manifest names; the first one needs no name."""
        fs, path = self._fs()
        manifest = path(f"{self.folder}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(manifest)] if fs.exists(manifest) else []
        return max((int(n.rsplit("-", 1)[1]) for n in names if n.rsplit("-", 1)[0] == part), default=0)

    def _path(self, part: str) -> str:
        return f"{self.folder}/{part}/{self._version(part)}"

    def _exists(self, part: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._path(part)))

    def _table(self, part: str, schema: T.StructType) -> DataFrame:
        if self.closed:
            raise QueryError("the store is closed")
        return self.spark.read.schema(schema).parquet(self._path(part)) if self._exists(part) else self.spark.createDataFrame([], schema)

    def _append(self, part: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path(part))

    def _replace(self, part: str, rows: DataFrame) -> None:
        """Write a new version of a table, name it, and only then delete the old one."""
        fs, path = self._fs()
        old, new = self._path(part), self._version(part) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/{new}")
        fs.mkdirs(path(f"{self.folder}/manifest"))
        fs.create(path(f"{self.folder}/manifest/{part}-{new}"), False).close()
        fs.delete(path(old), True)

    def destroy(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.folder), True)
        self.closed = True
        self.emit("destroyed", {"name": self.name})

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def update_seq(self) -> int:
        return self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def info(self) -> dict:
        n = self.docs().count()
        return {"db_name": self.name, "doc_count": n, "update_seq": self.update_seq()}

    def winners(self) -> DataFrame:
        return winners(self.log())

    def docs(self, variant: bool = False, conflicts: bool = False) -> DataFrame:
        """Live documents: _id, _rev and body as JSON text, or as a VARIANT; with conflicts also _conflicts."""
        live = self.winners().filter("NOT deleted")
        more = [F.col("conflicts").alias("_conflicts")] if conflicts else []
        return live.select(F.col("id").alias("_id"), rev().alias("_rev"), F.parse_json("body").alias("doc") if variant else F.col("body"), *more)

    def all_docs(self, include_docs: bool = False, conflicts: bool = False, keys: Sequence[str] | None = None, **options: Any) -> DataFrame:
        """Rows id, key, value (rev, deleted), doc as JSON text, and error, in the order of ids or of the given keys.

        Deleted documents come only with keys, without a doc; keys that were never there have the error not_found.
        """
        known = self.winners().withColumnRenamed("id", "_id")
        if keys is None:
            known = known.filter("NOT deleted")
        elif len(keys) <= FEW:
            known = winners(self.log().filter(F.col("id").isin(list(keys)))).withColumnRenamed("id", "_id")
        rows = all_docs(known, "_id", keys, **options)
        there = F.col("gen").isNotNull()
        value = F.when(there, F.struct(rev().alias("rev"), F.when(F.col("deleted"), True).alias("deleted")))
        out = [F.when(there, F.col("_id")).alias("id"), F.col("_id").alias("key"), value.alias("value")]
        out += [F.when(~F.col("deleted"), F.col("body")).alias("doc")] if include_docs else []
        out += [F.when(~F.col("deleted"), F.col("conflicts")).alias("conflicts")] if conflicts else []
        return rows.select(*out, (F.col("__error") if keys is not None else F.lit(None).cast("string")).alias("error"))

    def all_docs_result(self, update_seq: bool = False, **options: Any) -> dict:
        """all_docs as one small result, with total_rows and offset."""
        rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None or k == "doc"} for r in self.all_docs(**options).collect()]
        for r in rows:
            if r.get("value") and not r["value"]["deleted"]:
                del r["value"]["deleted"]
        total, last = self.docs().count(), {"update_seq": self.update_seq()} if update_seq else {}
        return {"total_rows": total, "offset": int(options.get("skip", 0))} | last | {"rows": rows}

    # Writes
    def bulk_docs(self, docs: Iterable[dict] | DataFrame, new_edits: bool = True) -> DataFrame:
        """Write documents; (pos, id, rev, ok, error) for each, in order. Those that conflict are refused one by one."""
        listed = None if isinstance(docs, DataFrame) else list(docs)
        rows = docs if listed is None else self._rows(listed, new_edits)
        if not new_edits:
            return self._store_revisions(rows)
        log = self._of(rows, listed)
        known = winners(log).select("id", F.col("gen").alias("w_gen"), F.col("hash").alias("w_hash"), F.col("deleted").alias("w_deleted"), F.col("path").alias("w_path"), F.col("attachments").alias("w_att"))
        found = leaves(log).select("id", rev().alias("rev"), F.col("path").alias("l_path"), F.col("attachments").alias("l_att"))
        met = rows.join(known, "id", "left").join(found, ["id", "rev"], "left")
        nth = F.row_number().over(Window.partitionBy("id", "rev").orderBy("pos"))
        met = met.withColumn("nth", nth)
        fresh = F.col("w_gen").isNull() | (F.col("w_deleted") & F.col("rev").isNull())
        # A base revision must be a leaf, and only the first of several changes of one base is taken.
        ok = ((fresh & F.col("rev").isNull() & (F.col("nth") == 1)) | (F.col("l_path").isNotNull() & (F.col("nth") == 1)) | (F.col("force") & F.col("rev").isNotNull())) & F.col("valid")
        base = F.when(F.col("l_path").isNotNull(), F.col("l_path")).when(F.col("force") & F.col("rev").isNotNull(), F.array(F.element_at(F.split("rev", "-"), 2))).when(F.col("w_deleted"), F.col("w_path")).otherwise(F.array().cast("array<string>"))
        parent_gen = F.when(F.col("rev").isNotNull(), F.element_at(F.split("rev", "-"), 1).cast("int")).when(F.col("w_deleted"), F.col("w_gen")).otherwise(0)
        made = met.withColumn("ok", ok).withColumn("base", base).withColumn("gen", parent_gen + 1)
        parent = F.when(F.size("base") > 0, F.concat_ws("-", parent_gen.cast("string"), F.element_at("base", 1)))
        named = revision_hash(parent, F.col("deleted"), F.concat_ws("|", "body", F.to_json("attachments"))) if self.deterministic else F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
        made = made.withColumn("hash", named).withColumn("path", F.slice(F.concat(F.array("hash"), F.col("base")), 1, self.revs_limit))
        held = self._held(self._dealt(made))
        self._append("log", self._numbered(held.filter("ok")).select(*LOG.names))
        if self.auto_compaction:
            self.compact()
        error = F.when(~F.col("valid"), "bad_request").when(~F.col("ok"), "conflict")
        out = held.select("pos", "id", F.when(F.col("ok"), rev()).alias("rev"), "ok", error.alias("error")).orderBy("pos")
        if listed is None:
            return out
        # What came from a list goes back as one.
        result = self.spark.createDataFrame(out.collect(), out.schema)
        self._release()
        return result

    def _of(self, rows: DataFrame, listed: list[dict] | None) -> DataFrame:
        """The log of the documents that rows (id, ...) are about: by a filter that reaches the scan if they are few."""
        if listed is not None and len(listed) <= FEW:
            return self.log().filter(F.col("id").isin([d["_id"] for d in listed if isinstance(d.get("_id"), str)]))
        return self.log().join(rows.select("id").distinct(), "id", "left_semi")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows in parts by ranges of pos, to be written down and then numbered."""
        return rows.repartitionByRange("pos").withColumn("__part", F.spark_partition_id())

    def _numbered(self, held: DataFrame) -> DataFrame:
        """Rows that were dealt and written, with the sequences that follow the last one, in the order of pos: each part is numbered by itself."""
        counts = held.groupBy("__part").agg(F.count("*").alias("n"))
        # One row per part is left here.
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
        nth = F.row_number().over(Window.partitionBy("__part").orderBy("pos"))
        return held.join(starts, "__part").withColumn("seq", F.lit(self.update_seq()) + F.col("__start") + nth)

    def _held(self, rows: DataFrame) -> DataFrame:
        """rows, written down once, so that all that follows sees the same."""
        path = f"{self.folder}/.batch-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.batches.append(path)
        return self.spark.read.parquet(path)

    def _release(self) -> None:
        """Delete what _held wrote down. Results of DataFrames that were written stay readable until close()."""
        fs, path = self._fs()
        while self.batches:
            fs.delete(path(self.batches.pop()), True)

    def _rows(self, docs: Iterable[dict], new_edits: bool) -> DataFrame:
        out, blobs = [], []
        for pos, doc in enumerate(docs):
            if not isinstance(doc, dict):
                raise QueryError("Document must be a JSON object", "bad_request")
            id_, given = doc.get("_id"), doc.get("_rev")
            id_ = uuid.uuid4().hex if id_ is None and new_edits else id_
            valid = isinstance(id_, str) and id_ != "" and not (id_.startswith("_") and not id_.startswith("_design/"))
            strange = [k for k in doc if k.startswith("_") and k not in ("_id", "_rev", "_deleted", "_attachments", "_revisions", "_conflicts", "_local_seq", "_revs_info", "_force")]
            if strange:
                raise QueryError(f"Bad special document member: {strange[0]}", "doc_validation", 500)
            body = json.dumps({k: v for k, v in doc.items() if not k.startswith("_")}, sort_keys=True, ensure_ascii=False)
            attachments = {}
            for name, a in (doc.get("_attachments") or {}).items():
                if "digest" in a and "data" not in a:
                    attachments[name] = (a.get("content_type"), a["digest"], a.get("length"), a.get("revpos"))
                    continue
                from base64 import b64decode, b64encode

                data = a["data"] if isinstance(a["data"], (bytes, bytearray)) else b64decode(a["data"])
                digest = "md5-" + b64encode(hashlib.md5(data).digest()).decode()
                attachments[name] = (a.get("content_type"), digest, len(data), int(given.split("-")[0]) + 1 if given else 1)
                blobs.append((digest, bytearray(data)))
            revisions = doc.get("_revisions")
            path = revisions["ids"] if revisions else [given.split("-", 1)[1]] if given and not new_edits else None
            out.append((pos, id_, given, bool(doc.get("_deleted", False)), body, attachments, path, bool(doc.get("_force", False)), valid))
        if blobs:
            known = self._table("blobs", BLOBS)
            self._append("blobs", self.spark.createDataFrame(blobs, BLOBS).dropDuplicates(["digest"]).join(known, "digest", "left_anti"))
        return self.spark.createDataFrame(out, WRITES)

    def _store_revisions(self, rows: DataFrame) -> DataFrame:
        """new_edits false: revisions as they are, with their ancestors; those that are there already change nothing."""
        gen = F.element_at(F.split("rev", "-"), 1).cast("int")
        made = rows.withColumn("gen", gen).withColumn("hash", F.regexp_extract("rev", "^[0-9]+-(.*)$", 1)).withColumn("path", F.slice("path", 1, self.revs_limit))
        new = made.dropDuplicates(["id", "gen", "hash"]).join(self.log().select("id", "gen", "hash"), ["id", "gen", "hash"], "left_anti")
        held = self._held(self._dealt(new))
        self._append("log", self._numbered(held).select(*LOG.names))
        return held.select("pos", "id", "rev", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    def put(self, doc: dict, force: bool = False) -> dict:
        if "_id" not in doc:
            raise QueryError("_id is required for puts", "missing_id", 412)
        return self.post(doc | {"_force": force})

    def post(self, doc: dict) -> dict:
        if str(doc.get("_id", "")).startswith("_local/"):
            return self.put_local(doc)
        row = self.bulk_docs([doc]).first()
        if not row["ok"]:
            raise QueryError("Document update conflict" if row["error"] == "conflict" else "bad request", row["error"], 409 if row["error"] == "conflict" else 400)
        return {"ok": True, "id": row["id"], "rev": row["rev"]}

    def remove(self, id: str, rev: str) -> dict:
        return self.post({"_id": id, "_rev": rev, "_deleted": True})

    # Point reads
    def get(
        self, id: str, rev: str | None = None, revs: bool = False, revs_info: bool = False, open_revs: Any = None, conflicts: bool = False, attachments: bool = False, latest: bool = False,
        binary: bool = False,
    ) -> Any:
        """A document as a dict: its winner, or the named revision. attachments come as base64 text, or with binary as bytes."""
        if id.startswith("_local/"):
            return self.get_local(id)
        own = self.log().filter(F.col("id") == id)
        if open_revs is not None:
            found = {f"{r['gen']}-{r['hash']}": r for r in leaves(own).collect()}
            if open_revs == "all":
                return [{"ok": self._document(r, attachments, binary)} for r in found.values()]
            every = {f"{r['gen']}-{r['hash']}": r for r in own.collect()}
            return [{"ok": self._document(every[x], attachments, binary)} if x in every else {"missing": x} for x in open_revs]
        best = winners(own).first()
        if best is None or (rev is None and best["deleted"]):
            raise NotFound("deleted" if best is not None else "missing")
        row = best
        if rev is not None:
            gen, hash_ = rev.split("-", 1)
            row = own.filter((F.col("gen") == int(gen)) & (F.col("hash") == hash_)).first()
            if latest and row is not None:
                below = [r for r in leaves(own).collect() if hash_ in r["path"]]
                row = max(below, key=lambda r: (not r["deleted"], r["gen"], r["hash"])) if below else row
            if row is None or row["body"] is None:
                raise NotFound()
        out = self._document(row, attachments, binary)
        if revs:
            out["_revisions"] = {"start": row["gen"], "ids": list(row["path"])}
        if revs_info:
            there = {(r["gen"], r["hash"]): r["body"] is not None for r in own.select("gen", "hash", "body").collect()}
            out["_revs_info"] = [{"rev": f"{row['gen'] - k}-{h}", "status": "available" if there.get((row["gen"] - k, h)) else "missing"} for k, h in enumerate(row["path"])]
        if conflicts and best["conflicts"]:
            out["_conflicts"] = list(best["conflicts"])
        return out

    def _document(self, row: Any, attachments: bool, binary: bool = False) -> dict:
        out = {"_id": row["id"], "_rev": f"{row['gen']}-{row['hash']}"} | json.loads(row["body"] or "{}")
        if row["deleted"]:
            out["_deleted"] = True
        if row["attachments"]:
            out["_attachments"] = {}
            for name, a in sorted(row["attachments"].items()):
                stub = {"content_type": a["content_type"], "digest": a["digest"], "revpos": a["revpos"]}
                if attachments:
                    from base64 import b64encode

                    data = self._blob(a["digest"])
                    out["_attachments"][name] = stub | {"data": data if binary else b64encode(data).decode()}
                else:
                    out["_attachments"][name] = stub | {"stub": True, "length": a["length"]}
        return out

    def bulk_get(self, docs: list[dict], revs: bool = False, attachments: bool = False, latest: bool = False) -> DataFrame:
        """(pos, id, rev, body, deleted, error): each asked revision, or all leaves where none is named.

        revs adds the ancestry (path), attachments their stubs, latest gives the leaves below an asked revision instead.
        """
        asked = self.spark.createDataFrame([(k, d["id"], d.get("rev")) for k, d in enumerate(docs)], "pos int, id string, asked string")
        log = self._of(asked, [{"_id": d["id"]} for d in docs])
        rows = log.withColumn("asked", rev()).dropDuplicates(["id", "asked"])
        if latest:
            tips = leaves(log)
            below = tips.withColumn("asked", F.explode(F.transform("path", lambda h, k: F.concat_ws("-", (F.col("gen") - k).cast("string"), h))))
            rows = below.select(*rows.columns)
        named = asked.filter("asked IS NOT NULL").join(rows, ["id", "asked"], "left")
        whole = asked.filter("asked IS NULL").join(leaves(log), "id", "left")
        out = named.unionByName(whole, allowMissingColumns=True)
        shown = F.when(F.col("gen").isNotNull(), rev()).otherwise(F.col("asked"))
        more = (["path"] if revs else []) + (["attachments"] if attachments else [])
        return out.select("pos", "id", shown.alias("rev"), "body", "deleted", *more, F.when(F.col("gen").isNull(), "not_found").alias("error")).orderBy("pos", "rev")

    # Attachments
    def _blob(self, digest: str) -> bytes:
        row = self._table("blobs", BLOBS).filter(F.col("digest") == digest).first()
        if row is None:
            raise NotFound()
        return bytes(row["data"])

    def _latest(self, id: str, rev: str | None) -> dict:
        try:
            return self.get(id, rev=rev)
        except NotFound:
            if rev is not None:
                raise
            return {"_id": id}

    def put_attachment(self, id: str, name: str, rev: str | None, data: bytes, content_type: str) -> dict:
        doc = self._latest(id, rev)
        doc.setdefault("_attachments", {})[name] = {"content_type": content_type, "data": data}
        return self.post(doc)

    def get_attachment(self, id: str, name: str, rev: str | None = None) -> bytes:
        doc = self.get(id, rev=rev)
        if name not in doc.get("_attachments", {}):
            raise NotFound()
        return self._blob(doc["_attachments"][name]["digest"])

    def remove_attachment(self, id: str, name: str, rev: str) -> dict:
        doc = self.get(id, rev=rev)
        doc.get("_attachments", {}).pop(name, None)
        return self.post(doc)

    # Local documents: one version, not replicated, in no other read
    def _locals(self) -> DataFrame:
        table = self._table("local", LOCAL)
        return table.groupBy("id").agg(F.max_by(F.struct("rev", "body", "deleted"), "at").alias("r")).select("id", "r.*")

    def put_local(self, doc: dict) -> dict:
        old = self._locals().filter((F.col("id") == doc["_id"]) & ~F.col("deleted")).first()
        given, known = doc.get("_rev"), f"0-{old['rev']}" if old else None
        if given != known:
            raise QueryError("Document update conflict", "conflict", 409)
        if doc.get("_attachments"):
            raise QueryError("local documents have no attachments", "bad_request")
        n = (old["rev"] if old else 0) + 1
        at = self._table("local", LOCAL).agg(F.coalesce(F.max("at"), F.lit(0))).first()[0] + 1
        body = json.dumps({k: v for k, v in doc.items() if not k.startswith("_")}, sort_keys=True, ensure_ascii=False)
        self._append("local", self.spark.createDataFrame([(doc["_id"], n, body, bool(doc.get("_deleted")), at)], LOCAL))
        return {"ok": True, "id": doc["_id"], "rev": f"0-{n}"}

    def get_local(self, id: str) -> dict:
        row = self._locals().filter((F.col("id") == id) & ~F.col("deleted")).first()
        if row is None:
            raise NotFound()
        return {"_id": id, "_rev": f"0-{row['rev']}"} | json.loads(row["body"])

    # Upkeep
    def compact(self) -> None:
        """Drop the bodies of revisions that aren't leaves, and attachments that no leaf has. Revisions stay known."""
        self.tasks.append({"type": "database_compaction", "name": self.name})
        log = self.log()
        kept = leaves(log).select("id", "gen", "hash", F.lit(True).alias("leaf"))
        new = log.join(kept, ["id", "gen", "hash"], "left")
        bare = new.withColumn("body", F.when(F.col("leaf"), F.col("body"))).withColumn("attachments", F.when(F.col("leaf"), F.col("attachments"))).select(*LOG.names)
        self._replace("log", bare)
        used = self.log().filter("attachments IS NOT NULL").select(F.explode(F.map_values("attachments"))).select("col.digest").distinct()
        if self._exists("blobs"):
            self._replace("blobs", self._table("blobs", BLOBS).join(used, "digest", "left_semi"))
        self.tasks.pop()

    def purge(self, id: str, rev_: str) -> dict:
        """Remove a leaf and its ancestors up to the next branch, as if they had never been."""
        own = self.log().filter(F.col("id") == id)
        tips = {f"{r['gen']}-{r['hash']}": r for r in leaves(own).collect()}
        if rev_ not in tips:
            raise QueryError("Invalid rev format or not a leaf", "not_found", 404)
        leaf = tips[rev_]
        shared = {(r["gen"] - k, h) for x, r in tips.items() if x != rev_ for k, h in enumerate(r["path"])}
        gone = [(id, leaf["gen"] - k, h) for k, h in enumerate(leaf["path"])]
        cut = next((k for k, (_, g, h) in enumerate(gone) if (g, h) in shared), len(gone))
        marks = self.spark.createDataFrame(gone[:cut], "id string, gen int, hash string")
        self._replace("log", self.log().join(F.broadcast(marks), ["id", "gen", "hash"], "left_anti"))
        self._note_purge(id, rev_)
        return {"ok": True, "deletedRevs": [f"{g}-{h}" for _, g, h in gone[:cut]], "documentWasRemovedCompletely": len(tips) == 1}

    def purged_infos(self) -> list[dict]:
        """The last purges: id, rev and their number, the oldest first; at most purged_infos_limit."""
        try:
            return self.get_local("_local/purges")["purges"]
        except NotFound:
            return []

    def _note_purge(self, id: str, rev_: str) -> None:
        infos = self.purged_infos()
        known = {"_rev": self.get_local("_local/purges")["_rev"]} if infos else {}
        new = {"id": id, "rev": rev_, "purge_seq": infos[-1]["purge_seq"] + 1 if infos else 1}
        self.put_local({"_id": "_local/purges", "purges": [*infos, new][-self.purged_infos_limit :]} | known)

    # Dumps
    def dump(self, folder: str) -> None:
        """All leaves with their ancestors as JSON lines."""
        leaves(self.log()).drop("seq").write.mode("overwrite").json(folder)

    def load(self, folder: str) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([f for f in LOG.fields if f.name != "seq"])).json(folder)
        return self._store_revisions(rows.withColumn("rev", rev()).withColumn("pos", F.monotonically_increasing_id()))
