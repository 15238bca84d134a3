"""Near-duplicates by SimHash fingerprints and a byte-position inverted index.

Fingerprints: 64 majority votes over the XXH64 hashes of a text's word shingles. Two fingerprints that differ in at
most 3 bits agree in at least 5 of their 8 bytes, so shared positional bytes can be counted instead of comparing all.
Postings by one byte would hold a 256th of all rows each, and their pairs would grow with the square of the input.
The index is therefore by sets of byte positions, chosen so that any 5 positions hold one of the sets: the 3-subsets of
each half (8 keys of 24 bits). Every pair that could reach 5 matches meets under at least one key; there
the shared bytes are tallied, pairs with fewer than 5 are dropped, and only the others are compared bit by bit.

Only distinct fingerprints are indexed, and a posting list answers with a spanning forest of its links, not with all
pairs, so a group of k near copies makes at most k - 1 rows per key. A long posting list is divided by a second index
of the same kind over its other five bytes (two more of them must match).

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; fewer words than a shingle: the
whole sequence; null doc_ids never name a component unless all of its doc_ids are null; repeated rows share a
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import broadcast_if_small, checkpointed, join_hot, map_arrow, utf8
from quern.llm.components import components

#: Any 5 of the 8 byte positions hold all of at least one of these: 3 of them lie in one half.
KEYS = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
#: Posting lists longer than LONG are divided; lists are tallied together until they hold HELD postings or more.
LONG, HELD = 4096, 1 << 16


def fingerprint(text: bytes, width: int, lower: bool = True, seed: int = 42) -> int:
    """The fingerprint of one text; hashes are voted in blocks, so memory doesn't grow with the votes."""
    from xxhash import xxh64_intdigest

    words = (text.lower() if lower else text).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    m = max(1, n - width + 1)
    starts = np.concatenate(([0], ends[: m - 1]))
    stops = ends[width - 1 :] - 1 if n >= width else ends[-1:] - 1
    votes = np.zeros(64, np.int64)
    for at in range(0, m, 4096):
        a, b = starts[at : at + 4096].tolist(), stops[at : at + 4096].tolist()
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > m).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """(key, out): the fingerprint of each row as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, ends = utf8(batch.column(1))
        view, at = memoryview(raw), ends.tolist()
        prints = np.array([fingerprint(bytes(view[i:j]), width) for i, j in zip(at, at[1:], strict=False)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [key, out])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, `{out}` bigint")


def forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links (i, j) between n nodes make the spanning forest that prefers the first ones, and the smallest node that each reaches.

    In each turn every part takes the first link that leads out of it. Where two parts take the same, the smaller one stays.
    """
    root, left, made = np.arange(n) if root is None else root.copy(), np.arange(len(i)), [np.empty(0, np.int64)]
    while len(left):
        a, b = root[i[left]], root[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            break
        first = np.full(n, len(i))
        for ends in (a, b):
            # Written backwards, the first link is the last one to be written.
            mine = np.full(n, len(i))
            mine[ends[::-1]] = left[::-1]
            first = np.minimum(first, mine)
        parts = np.flatnonzero(first < len(i))
        link = first[parts]
        made.append(np.unique(link))
        to = np.arange(n)
        to[parts] = root[i[link]] + root[j[link]] - parts
        both = np.flatnonzero((to[to] == np.arange(n)) & (to > np.arange(n)))
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        root = to[root]
    _, least, of = np.unique(root, return_index=True, return_inverse=True)
    return np.concatenate(made), least[of]


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tally of each pair: at how many of the 8 byte positions two fingerprints agree."""
    return ((x ^ y)[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.uint8)


def near(keys: np.ndarray, prints: np.ndarray, bits: int, seen: Callable[[int, int], None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted postings that have one key, share enough positional bytes and then differ in few enough bits."""
    at = np.arange(len(keys))
    for step in range(1, len(keys)):
        at = at[: np.searchsorted(at, len(keys) - step)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return
        kept = at[shared(prints[at], prints[at + step]) >= 8 - bits]
        if seen is not None:
            seen(len(at), len(kept))
        close = kept[np.bitwise_count(prints[kept] ^ prints[kept + step]) <= bits]
        if len(close):
            yield close, close + step


def divided(prints: np.ndarray, positions: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of one posting list by every two of its other bytes, and the index of each posting's fingerprint."""
    parts = prints[:, None].view(np.uint8).reshape(-1, 8)[:, ::-1].astype(np.int64)
    pairs = combinations([x for x in range(8) if x not in positions], 2)
    keys = np.concatenate([k << 16 | parts[:, p] << 8 | parts[:, q] for k, (p, q) in enumerate(pairs)])
    order = np.argsort(keys, kind="stable")
    return keys[order], order % len(prints)


def links(prints: np.ndarray, positions: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one posting list of distinct fingerprints (uint64)."""
    keys, of = divided(prints, positions) if len(prints) > LONG else (np.zeros(len(prints), np.int64), np.arange(len(prints)))
    return spanned(keys, prints, of, bits)


def spanned(keys: np.ndarray, prints: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between postings (sorted by key) of the fingerprints prints[of]."""
    root, made, held, size = np.arange(len(prints)), [], [], 0

    def add() -> None:
        nonlocal root, held, size
        i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        chosen, root = forest(len(prints), i, j, root)
        made.append((i[chosen], j[chosen]))
        held, size = [], 0

    for i, j in near(keys, prints[of], bits):
        held.append((of[i], of[j]))
        size += len(i)
        if size > 1 << 18:
            add()
    if held:
        add()
    i, j = (np.concatenate([np.empty(0, np.int64), *(m[k] for m in made)]) for k in (0, 1))
    return prints[i], prints[j]


def edges(prints: DataFrame, fp: str = "fp", bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that differ in at most bits of them."""
    if not 0 <= bits <= 3:
        raise ValueError("the index covers up to 3 differing bits")

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(0).to_numpy(zero_copy_only=False)
        parts = x.view(np.uint64)[:, None].view(np.uint8).reshape(-1, 8)[:, ::-1].astype(np.int64)
        keys = [k << 24 | parts[:, p] << 16 | parts[:, q] << 8 | parts[:, r] for k, (p, q, r) in enumerate(KEYS)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(x, len(KEYS)))], ["key", "fp"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by key; a list may span batches, and many lists are tallied at once."""
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
            each = np.repeat(np.diff(cut), np.diff(cut))
            # A list's forest is one of the fingerprints' own, so equal fingerprints under different keys stay apart.
            some = each <= LONG
            out = [spanned(keys[some], prints[some], np.arange(int(some.sum())), bits)]
            for a, n in zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True):
                if n > LONG:
                    out.append(links(prints[a : a + n], KEYS[int(keys[a]) >> 24], bits))
            if any(len(a) for a, _ in out):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            key, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            keys, prints = np.concatenate((keys, key)), np.concatenate((prints, x.view(np.uint64)))
            end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if end >= HELD:
                yield from found(keys[:end], prints[:end])
                keys, prints = keys[end:], prints[end:]
        if len(keys):
            yield from found(keys, prints)

    postings = map_arrow(prints.select(fp).distinct(), index, "key bigint, fp bigint")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tally, "a bigint, b bigint")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for each row: 16 hex digits, and the smallest key that links reach."""
    prints = checkpointed(fingerprints(df, key, text, width))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    roots = components(edges(nodes, "fp", bits))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = grouped.join(least, "root").select("fp", "component_id")
    named = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_hot(prints, checkpointed(named), ["fp"], "n").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The wide fingerprint: words of 64 bits and byte positions.
WIDE, POSITIONS = 4, 32
#: Odd factors that make a word of the wide fingerprint each out of one hash.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    m = max(1, n - width + 1)
    starts = np.concatenate(([0], ends[: m - 1])).tolist()
    stops = (ends[width - 1 :] - 1 if n >= width else ends[-1:] - 1).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts, stops, strict=True)), np.uint64, m))


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    both = len(x) + len(y)
    common = both - len(np.unique(np.concatenate((x, y))))
    return common / (both - common) if both else 1.0


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 majority votes over the distinct shingles of one text; a text without words has a fingerprint of zeros."""
    votes = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):
        h = hashes[at : at + 255, None] * FACTORS
        h = (h ^ h >> np.uint64(32)) * FACTORS[::-1]
        h ^= h >> np.uint64(29)
        votes += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def wide_links(prints: np.ndarray, p: int, matches: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the posting list of position p (rows of POSITIONS bytes) that share enough bytes and differ in few enough bits.

    Those of a spanning forest that takes the nearest first, and of these the first rows. Rows are compared where another
    byte after p matches as well. As all lists prefer the same pairs, those of different lists are mostly the same.
    """
    words, held, size = np.ascontiguousarray(prints).view(np.uint64), [], 0
    later = np.arange(p + 1, POSITIONS)
    order = np.argsort(prints[:, later], axis=0, kind="stable")
    column = np.take_along_axis(prints[:, later], order, axis=0)
    none = np.empty(0, np.int64)

    def spanning() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, differ = (np.concatenate(c) for c in zip(*held, strict=True))
        nearest = np.lexsort((np.maximum(x, y), np.minimum(x, y), differ))
        made = nearest[forest(len(prints), x[nearest], y[nearest])[0]]
        return x[made], y[made], differ[made]

    for step in range(1, len(prints)):
        at, q = np.nonzero(column[step:] == column[:-step])
        if not len(at):
            break
        x, y = order[at, q], order[at + step, q]
        equal = prints[x] == prints[y]
        # The first match of the pair after p is q, so it is met once in this list.
        once = (np.argmax(equal[:, p + 1 :], axis=1) == q) & (equal.sum(axis=1) >= matches)
        x, y = x[once], y[once]
        differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int16)
        close = differ <= bits
        if not close.any():
            continue
        held.append((x[close], y[close], differ[close]))
        size += len(held[-1][0])
        if size > max(1 << 18, 4 * len(prints)):
            held = [spanning()]
            size = len(held[0][0])
    return spanning()[:2] if held else (none, none)


def wide_edges(nodes: DataFrame, matches: int, bits: int) -> DataFrame:
    """(a, b): pairs of nodes (node bigint, fp binary) that connect all that may be near copies and share at least two bytes.

    The postings are by one byte position; a list is divided by each later position in turn, so all pairs of positions
    serve as keys while a node has one posting for each position only.
    """
    if matches < 2:
        raise ValueError("the index finds pairs that share at least two bytes")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                prints = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint8).reshape(-1, POSITIONS).astype(np.int32)
                keys = np.concatenate([p << 8 | prints[:, p] for p in range(POSITIONS)])
                rows = pa.array(np.tile(np.arange(part.num_rows), POSITIONS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(part.column(c).take(rows) for c in range(2))], ["key", "node", "fp"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by key; a list may span batches."""
        held_key, nodes_held, prints_held = None, [], []

        def links_held() -> Iterator[pa.RecordBatch]:
            if len(nodes_held) < 2:
                return
            by = np.argsort(nodes_held)
            ids = np.array(nodes_held)[by]
            x, y = wide_links(np.frombuffer(b"".join(prints_held), np.uint8).reshape(-1, POSITIONS)[by], held_key >> 8, matches, bits)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

        for batch in batches:
            for key, node, fp in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if key != held_key:
                    yield from links_held()
                    held_key, nodes_held, prints_held = key, [], []
                nodes_held.append(node)
                prints_held.append(fp)
        yield from links_held()

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = nodes.select("node", "fp").mapInArrow(index, "key int, node bigint, fp binary")
    return postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tally, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have sets of shingles alike to least or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (x, to_x), (y, to_y) = utf8(batch.column(2)), utf8(batch.column(3))
        last, kept = None, []
        for k in range(batch.num_rows):
            if k == 0 or batch.column(0)[k] != batch.column(0)[k - 1]:
                last = shingles(x[to_x[k] : to_x[k + 1]].tobytes(), width)
            kept.append(alike(last, shingles(y[to_y[k] : to_y[k + 1]].tobytes(), width)) >= least)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return checkpointed(map_arrow(met.select("a", "b", "x", "y"), run, "a bigint, b bigint"))


def common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of some sets share: a product of 0-1 matrices, some columns at a time."""
    values, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.flatnonzero(np.bincount(of, minlength=len(values)) > 1)
    column = np.full(len(values), -1)
    column[often] = np.arange(len(often))
    at = column[of]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for first in range(0, len(often), columns):
        a, b = np.searchsorted(at, (first, first + columns))
        one = np.zeros((len(sets), columns), np.float32)
        one[row[a:b], at[a:b] - first] = 1
        out += one @ one.T
    return out


def tile_links(sides: np.ndarray, roots: np.ndarray, prints: np.ndarray, texts: list[bytes], matches: int, bits: int, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near copies among the nodes of one tile: within a block, or between two (sides 0 and 1)."""
    n, two = len(sides), bool(sides.any())
    words, some = np.ascontiguousarray(prints).view(np.uint64), np.zeros((n, n), bool)
    for a in range(n - 1):
        apart = roots[a + 1 :] != roots[a]
        b = a + 1 + np.flatnonzero(apart & (sides[a + 1 :] != sides[a]) if two else apart)
        # Shared positional bytes are tallied first; only pairs with enough of them are compared bit by bit.
        b = b[(prints[b] == prints[a]).sum(axis=1) >= matches]
        some[a, b[np.bitwise_count(words[b] ^ words[a]).sum(axis=1) <= bits]] = True
    met = np.flatnonzero(some.any(axis=0) | some.any(axis=1))
    if not len(met):
        return met, met
    sets = [shingles(texts[k], width) for k in met]
    both, size = common(sets), np.array([len(s) for s in sets])
    alike_enough = both / np.maximum(size[:, None] + size[None] - both, 1) >= least
    i, j = (met[x] for x in np.nonzero(some[np.ix_(met, met)] & alike_enough))
    made = forest(n, i, j)[0]
    return i[made], j[made]


#: The weight of a block of a cluster: a node weighs 1, and 1 more for each WEIGHT bytes of its text.
BLOCK, WEIGHT = 256, 1 << 16
#: Narrow rows that are broadcast at most.
NARROW = 200_000
TILE = ["cluster", "p_owner", "p", "q_owner", "q"]


def tiles(members: DataFrame, large: DataFrame) -> DataFrame:
    """TILE, side, root, node: each node of members (cluster, root, node, weight) in all tiles that may hold a link of it.

    A cluster that isn't large is one tile. In a large one, what links connect already (a root) has blocks of its own if
    it is large itself, and the others share blocks. Every two blocks are a tile but those of one root, which needs no
    more links: a large group of near copies makes a row for each node and block of others, not for each two nodes.
    """
    small = members.join(broadcast_if_small(large), "cluster", "left_anti").select("cluster", *(F.lit(0).cast("bigint").alias(c) for c in TILE[1:]), F.lit(0).alias("side"), "root", "node")
    inner = checkpointed(members.join(broadcast_if_small(large), "cluster", "left_semi"))
    groups = checkpointed(inner.groupBy("cluster", "root").agg(F.sum("weight").alias("w")))
    own = checkpointed(groups.filter(F.col("w") >= BLOCK).select("cluster", "root", F.ceil(F.col("w") / BLOCK).alias("own")))
    pools = checkpointed(groups.filter(F.col("w") < BLOCK).groupBy("cluster").agg(F.ceil(F.sum("w") / BLOCK).alias("pools")))
    dealt = inner.join(broadcast_if_small(own), ["cluster", "root"], "left").join(broadcast_if_small(pools), "cluster", "left")
    # Blocks of a root's own bear its number, which isn't negative.
    block = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("root"), "pools"))
    dealt = checkpointed(dealt.select("cluster", F.when(F.col("own").isNotNull(), F.col("root")).otherwise(-1).cast("bigint").alias("owner"), block.cast("bigint").alias("block"), "root", "node"))
    blocks = checkpointed(dealt.select("cluster", "owner", "block").distinct())
    left, right = (blocks.select("cluster", F.col("owner").alias(f"{x}_owner"), F.col("block").alias(x)) for x in "pq")
    met = left.join(right, "cluster").filter((F.struct("p_owner", "p") <= F.struct("q_owner", "q")) & ((F.col("p_owner") != F.col("q_owner")) | (F.col("p_owner") < 0)))
    one = met.select(*TILE, F.lit(0).alias("side"), F.col("p_owner").alias("owner"), F.col("p").alias("block"))
    two = met.filter((F.col("p_owner") != F.col("q_owner")) | (F.col("p") != F.col("q"))).select(*TILE, F.lit(1).alias("side"), F.col("q_owner").alias("owner"), F.col("q").alias("block"))
    placed = dealt.join(broadcast_if_small(checkpointed(one.unionByName(two))), ["cluster", "owner", "block"])
    return small.unionByName(placed.select(*TILE, "side", "root", "node"))


def compared(rows: DataFrame, matches: int, bits: int, width: int, least: float) -> DataFrame:
    """(a, b): links between the nodes of each tile; rows: TILE, side, root, node, fp, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by tile and side; one tile is held at a time."""
        now, held = None, []

        def links_held() -> Iterator[pa.RecordBatch]:
            sides, roots, nodes, prints, texts = zip(*held, strict=True)
            i, j = tile_links(np.array(sides), np.array(roots), np.frombuffer(b"".join(prints), np.uint8).reshape(-1, POSITIONS), texts, matches, bits, width, least)
            if len(i):
                ids = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

        for batch in batches:
            for *tile, side, root, node, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    if len(held) > 1:
                        yield from links_held()
                    now, held = tile, []
                held.append((side, root, node, fp, text))
        if len(held) > 1:
            yield from links_held()

    dealt = rows.select(*TILE, "side", "root", "node", "fp", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return checkpointed(dealt.repartition(*TILE).sortWithinPartitions(*TILE, "side").mapInArrow(run, "a bigint, b bigint"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, matches: int = 2, bits: int = 64, least: float = 0.8) -> DataFrame:
    """df without the near copies of others: of each group the row with the smallest key stays.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of least or more; groups are what
    they connect. At 0.8 they differ in some 15 % of fingerprint bits, out of reach for the index of 64-bit fingerprints
    and 3 bits. Here fingerprints have 256 bits, so that 32 byte positions can be tallied: such texts share nearly 9 of
    them on average, others 1 in 8. Pairs that share at least matches bytes and differ in at most bits of 256 (15 % and
    four standard deviations) are proposed.

    Fingerprints only propose; the shingles of both texts decide. What proposals connect is a cluster. The texts of a
    cluster are brought together once and all of its proposed pairs are checked there; a large cluster is first thinned
    by checking a spanning forest of each posting list, and then divided into tiles of two blocks each.

    Texts with equal sets of shingles are one node. Of rows with equal keys and texts one stays; null keys come after all
    others.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        raw, ends = utf8(batch.column(2))
        view, at = memoryview(raw), ends.tolist()
        sets, prints = [], []
        for i, j in zip(at, at[1:], strict=False):
            found = shingles(bytes(view[i:j]), width)
            sets.append(xxh3_128_digest(found.tobytes()))
            prints.append(wide_fingerprint(found))
        sizes = pa.array(np.diff(ends) // WEIGHT + 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(prints, pa.binary()), sizes], ["key", "th", "same", "fp", "weight"])

    prints = checkpointed(map_arrow(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, th bigint, same binary, fp binary, weight bigint"))
    repeats = checkpointed(prints.groupBy("key", "th").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("__sim_key"), F.col("th").alias("__sim_hash")))
    repeated = not repeats.isEmpty()
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th"))
    nodes = prints.groupBy("same", "fp").agg(first.alias("first"), F.max("weight").alias("weight"), F.count("*").alias("n"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    proposed = checkpointed(wide_edges(nodes, matches, bits).distinct())
    clusters = components(proposed).withColumnRenamed("root", "cluster")
    members = checkpointed(clusters.join(nodes, "node").select("cluster", F.col("node").alias("root"), "node", "weight", "fp", F.col("first.key").alias("k"), F.col("first.th").alias("t")))

    def with_text(wanted: DataFrame) -> DataFrame:
        """wanted with the texts of the rows (k, t)."""
        single = rows.dropDuplicates(["key", "th"]) if repeated else rows
        return single.join(broadcast_if_small(checkpointed(wanted), NARROW), F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("th")))

    large = checkpointed(members.groupBy("cluster").agg(F.sum("weight").alias("w")).filter(F.col("w") > BLOCK).select("cluster"))
    found = []
    if not large.isEmpty():
        inner = members.join(broadcast_if_small(large), "cluster", "left_semi")
        pairs = proposed.join(inner.select(F.col("node").alias("a")), "a", "left_semi")
        found.append(verified(pairs, checkpointed(with_text(inner).select("node", "text")), width, least))
        members = checkpointed(members.drop("root").join(components(found[0]), "node", "left").withColumn("root", F.coalesce("root", "node")))
    placed = tiles(members.select("cluster", "root", "node", "weight"), large).join(members.select("node", "fp", "k", "t"), "node")
    found.append(compared(with_text(placed), matches, bits, width, least))
    roots = components(reduce(DataFrame.unionByName, found))
    kept = roots.join(nodes, "node").groupBy("root").agg(F.min("first").alias("kept"))
    named = nodes.join(roots.join(kept, "root").select("node", "kept"), "node", "left").filter("n > 1 OR kept IS NOT NULL").select("same", "fp", "n", F.coalesce("kept", "first").alias("kept"))
    copies = join_hot(prints, checkpointed(named), ["same", "fp"], "n").filter(~(F.col("key").eqNullSafe(F.col("kept.key")) & (F.col("th") == F.col("kept.th"))))
    rejected = checkpointed(copies.select(F.col("key").alias("__sim_key"), F.col("th").alias("__sim_hash")).distinct())

    def on(other: DataFrame) -> Column:
        return F.col(f"`{key}`").eqNullSafe(other["__sim_key"]) & (F.col("__sim_text") == other["__sim_hash"])

    few = broadcast_if_small(rejected, NARROW)
    out = df.withColumn("__sim_text", F.xxhash64(F.col(f"`{text}`"))).join(few, on(few), "left_anti")
    if repeated:
        # Equal rows have been counted as one text so far.
        some = broadcast_if_small(repeats, NARROW)
        nth = F.row_number().over(Window.partitionBy(F.col(f"`{key}`"), "__sim_text").orderBy(F.lit(0)))
        single = out.join(some, on(some), "left_semi").withColumn("__sim_nth", nth).filter("__sim_nth = 1").drop("__sim_nth")
        out = out.join(some, on(some), "left_anti").unionByName(single)
    return out.select(*(F.col(f"`{c}`") for c in df.columns))
