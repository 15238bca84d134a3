"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision only where they can't decide.

A unit vector u is kept as s * q + e with q in int8, s its scale and e what rounding left, of which the exact length is
kept. For two vectors the product of u and v differs from s * s' * (q . q') by at most |e| + (1 + |e|) * |e'|. In a tile
of two blocks all products of the q are one matrix product; pairs whose bound stays below the threshold are dropped,
pairs whose bound stays above it are links, and only the rest is recomputed in double precision.

Equal vectors of a label are one representative with a count. A tile answers with a count of links per representative
and a star per connected part, not with its pairs, so a group of k near vectors makes about k rows. The work is that of
all pairs within a label, as the method asks; a label is divided into blocks, so a hot one is spread over many tiles.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, have
no links and are components of their own; vectors of unequal length don't link; equal vec_ids in several rows are
several vectors; a null vec_id names a component only if it has no other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import broadcast_if_small, checkpointed, join_hot
from quern.llm.components import components

#: Vectors in a block; a tile holds two, and multiplies them in pieces of STEP rows.
BLOCK, STEP = 4096, 512
#: Far above what rounding adds to a bound in double precision, far below what quantising adds.
SLACK = 1e-9


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All products of rows with int8's values. Up to 1024 of them sum up exactly in single precision, as 127 * 127 * 1024 < 2**24."""
    out = (x[:, :1024] @ y[:, :1024].T).astype(np.float64)
    for a in range(1024, x.shape[1], 1024):
        out += x[:, a : a + 1024] @ y[:, a : a + 1024].T
    return out


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, scale and the length of the error of each unit vector. q has int8's values, as float32 for the matrix product."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def local_roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that links (i, j) reach, for each of n indices."""
    root = np.arange(n) if root is None else root
    while len(i):
        a, b = root[i], root[j]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, check=None):
    """Blocks of index pairs (i, j) of x and y, double precision, whose cosine is at least threshold; i < j if same."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantise(x / norm_x[:, None]), quantise(y / norm_y[:, None])
    for a in range(0, len(x), STEP):
        for b in range(a if same else 0, len(y), STEP):
            about = product(qx[a : a + STEP], qy[b : b + STEP]) * sx[a : a + STEP, None] * sy[None, b : b + STEP]
            bound = ex[a : a + STEP, None] + (1 + ex[a : a + STEP, None]) * ey[None, b : b + STEP] + SLACK
            possible = about + bound >= threshold
            if same and a == b:
                possible = np.triu(possible, 1)
            i, j = np.nonzero(possible)
            unsure = np.flatnonzero((about - bound)[i, j] < threshold)
            keep = np.ones(len(i), bool)
            for at in range(0, len(unsure), 1 << 14):
                u = unsure[at : at + (1 << 14)]
                p, q = a + i[u], b + j[u]
                keep[u] = (x[p] * y[q]).sum(axis=1) / (norm_x[p] * norm_y[q]) >= threshold
            if check is not None:
                check(len(i), len(unsure))
            yield a + i[keep], b + j[keep]


def links(df: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    x = F.col(vector)
    usable = F.col(label).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(key).alias("key"), F.when(usable, F.col(label)).alias("label"), F.when(usable, x).alias("x")).withColumn("x", F.expr("CASE WHEN label IS NOT NULL THEN x END"))
    same = rows.filter("x IS NOT NULL").groupBy("label", "x").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    reps = checkpointed(same.withColumn("node", F.monotonically_increasing_id()))
    sizes = checkpointed(reps.groupBy("label", F.size("x").alias("dim")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    dealt = reps.withColumn("dim", F.size("x")).join(broadcast_if_small(sizes), ["label", "dim"]).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("label", "dim", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), "at", "node", "n", "x")

    def tile(group: pa.Table) -> pa.Table:
        p, at = group.column("p")[0].as_py(), group.column("at").to_numpy()
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        column = group.column("x").combine_chunks()
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
        left = np.flatnonzero(at == p)
        diagonal = group.column("q")[0].as_py() == p
        right = left if diagonal else np.flatnonzero(at != p)
        count, root = np.zeros(len(at), np.int64), np.arange(len(at))
        for i, j in tile_links(vectors[left], vectors[right], diagonal, threshold):
            i, j = left[i], right[j]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            root = local_roots(len(at), i, j, root)
        star, some = np.flatnonzero(root != np.arange(len(at))), np.flatnonzero(count)
        none = np.zeros(len(star), np.int64)
        return pa.table({"a": pa.array(np.concatenate((node[some], node[star]))), "b": pa.array(np.concatenate((np.full(len(some), -1), node[root[star]]))), "n": pa.array(np.concatenate((count[some], none)))})

    found = checkpointed(tiled.groupBy("label", "dim", "p", "q").applyInArrow(tile, "a bigint, b bigint, n bigint"))
    counts = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b >= 0"))
    known = reps.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("label", "x", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = join_hot(rows.filter("x IS NOT NULL"), checkpointed(named), ["label", "x"], "n").select("key", "n_links", "component_id")
    # Rows without a usable vector or a label take no part in a join.
    alone = rows.filter("x IS NULL").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return joined.unionByName(alone).select(F.col("key").alias(key), F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
