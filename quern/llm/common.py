"""What several operators of this subpackage share: checkpoints, bounded broadcasts, Arrow helpers, hashing folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The setting that bounds Arrow batches, and what Spark has for it where nobody sets it.
BATCH_BYTES, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
#: A word, in the syntax that Java, RE2 and Python share.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the session names; set a temporary one only where none is set, in local mode, as in tests."""
    small_batches(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches for Python have 16 MB at most, unless the session says otherwise: a batch is held several times over."""
    if spark.conf.get(BATCH_BYTES, None) in (None, DEFAULT_BATCH):
        spark.conf.set(BATCH_BYTES, str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it again: compressed, and by columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Hint a broadcast only after counting; a larger df takes part in an ordinary shuffle join. Give a checkpointed df."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, named: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with named, a checkpointed table of a row per key (on) and the number n of rows that bear the key.

    A key that more rows bear than a quarter of what a shuffle partition holds on average is joined by a broadcast; there
    are at most four times as many of them as partitions. The other keys are joined by a shuffle, which they load evenly.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = named.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    most = max(100, whole // (4 * parts))
    hot, cold = checkpointed(named.filter(F.col(n) > most).drop(n)), named.filter(F.col(n) <= most).drop(n)
    if hot.isEmpty():
        return rows.join(cold, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def fields_of(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], ddl: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch; None leaves the batch out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, ddl)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without copying the text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
