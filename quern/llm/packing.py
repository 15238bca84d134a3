"""Packing documents into fixed-length sequences by bulk-synchronous best fit.

Documents become token ids, are cut only where they are longer than a sequence, and the pieces go to the tightest gaps.
Lengths and gaps are whole numbers up to the capacity, so the range-sorted lists of documents and gaps are runs of equal
values: (length, how many) and (gap, which sequences). A round sorts the runs of the longest class of lengths (those
above half of the longest one left) and of the gaps that hold any of them, widest first, and sweeps over all of them at
once: a gap opens a bracket and a document closes the last one that is open, which is its successor, the smallest gap
left that holds it. Running sums over the runs tell how deep each bracket lies, and what lies equally deep belongs
together: so conflicts are resolved by rank, side by side and for whole runs at once. A gap that holds several documents of the class takes part once for each. Then the gaps are
updated and the round is repeated; if no document fits any gap, new sequences are opened. What a round matches is a
segment: the documents of one length with ranks from a to b go to as many consecutive sequences at one offset. Segments
number at most a few for each pair of lengths, whatever the number of documents; the ranks of the documents within their
length, and the look-up of their segments, are computed over all rows side by side.

Defined cases: a null text is empty, an empty text is the end token alone; rows with equal keys are documents of their
own; null keys are kept as they are; very long texts are cut, never dropped; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed

#: A space between two other characters, at which any text can be divided; texts longer than LONG characters are.
SAFE, LONG = re.compile(r"(?<=\S) (?=\S)"), 1 << 20


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of texts, the same that tokenizers gives for a byte-level BPE file.

    The file's added tokens are found in a text as its loader finds them; the rest is encoded from the same vocabulary's
    ranks, which is faster. The pre-tokenizer always breaks before a space that stands between two other characters.
    """

    def __init__(self, file: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        added = {t.content: k for k, t in Tokenizer.from_file(file).get_added_tokens_decoder().items()}
        with open(ranks, "rb") as lines:
            of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=of, special_tokens=added)

    def whole(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, allowed_special="all")

    def part(self, text: str) -> bytes:
        return self.whole(text).astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.part(text) if len(text) <= LONG else b"".join(map(self.part, divided(text)))


def divided(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of about size characters whose ids, one after another, are those of the text."""
    at = 0
    while len(text) - at > size and (found := SAFE.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


_encoders: dict[str, Encoder] = {}


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a public vocabulary, loaded once a worker."""
    import public_tokenizers

    if name not in _encoders:
        _encoders[name] = Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
    return _encoders[name]


def pieces(docs: DataFrame, capacity: int, encoder: Callable[[], Callable[[str], bytes]] = public_encoder, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, in pieces of capacity; the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                for p in range((n - 1) // capacity + 1):
                    row.append(k), piece.append(p), start.append(at), length.append(size)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sweep(runs: DataFrame) -> DataFrame:
    """(kind, id, pos, low, high): the bracket levels (above low, up to high) that each run opens or closes, in the order of the sweep.

    runs (value, kind, id, n): n gaps (kind 0) or documents (kind 1) of one size each, a few for each size at most. From
    the widest to the narrowest, a gap opens a bracket and a document closes the last open one, if there is any.
    """
    # How many brackets are open after each run; a document that finds none leaves the depth at zero.
    return runs.sparkSession.sql(
        """
        WITH s AS (SELECT *, sum(if(kind = 0, n, -n)) OVER (ORDER BY value DESC, kind, id ROWS UNBOUNDED PRECEDING) AS total FROM {runs}),
        d AS (SELECT *, total - least(0, min(total) OVER (ORDER BY value DESC, kind, id ROWS UNBOUNDED PRECEDING)) AS depth FROM s),
        b AS (SELECT *, coalesce(lag(depth) OVER o, 0) AS before, row_number() OVER o AS pos FROM d WINDOW o AS (ORDER BY value DESC, kind, id))
        SELECT kind, id, pos, least(before, depth) AS low, greatest(before, depth) AS high FROM b WHERE before <> depth
        """,
        runs=runs,
    )


def paired(kind: np.ndarray, id: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(doc, gap, doc_at, gap_at, n) from the levels of the runs: each document closes the bracket that was opened last at its level.

    Divided at the ends of all runs, the levels of a part meet the same runs; there gaps and documents take turns.
    """
    levels = np.unique(np.concatenate((low, high)))
    first, last = np.searchsorted(levels, low), np.searchsorted(levels, high)
    run = np.repeat(np.arange(len(pos)), last - first)
    part = np.arange(len(run)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[run]
    order = np.lexsort((pos[run], part))
    run, part = run[order], part[order]
    at = 1 + np.flatnonzero((part[1:] == part[:-1]) & (kind[run[1:]] == 1))
    doc, gap, top, n = run[at], run[at - 1], levels[part[at] + 1], np.diff(levels)[part[at]]
    out: list[tuple[int, int, int, int, int]] = []
    for d, g, doc_at, gap_at, m in sorted(zip(id[doc].tolist(), id[gap].tolist(), (high[doc] - top).tolist(), (high[gap] - top).tolist(), n.tolist(), strict=True)):
        if out and out[-1][:2] == (d, g) and (out[-1][2] + out[-1][4], out[-1][3] + out[-1][4]) == (doc_at, gap_at):
            out[-1] = (*out[-1][:4], out[-1][4] + m)
        else:
            out.append((d, g, doc_at, gap_at, m))
    return out


def swept(spark: SparkSession, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which documents go to which gaps, one to each gap; there are a few runs for each size at most."""
    columns = [pa.array(np.array(c, np.int64)) for c in zip(*runs, strict=True)]
    found = sweep(spark.createDataFrame(pa.table(dict(zip(("value", "kind", "id", "n"), columns, strict=True))))).collect()
    return paired(*np.array(found, np.int64).reshape(-1, 5).T)


def best_fit(spark: SparkSession, counts: dict[int, int], capacity: int, sweeper: Callable[[SparkSession, list], list] = swept) -> np.ndarray:
    """Segments (length, first rank, first sequence, offset), sorted, of the best fit of counts[length] documents of each length."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"a piece doesn't fit a sequence of {capacity}")
    left = {length: (0, n) for length, n in counts.items() if n}
    gaps: list[tuple[int, int, int]] = []
    opened, out = 0, []
    while left:
        longest = max(left)
        own = [length for length in left if 2 * length > longest]
        least, each = min(own), capacity // longest
        fit = [g for g in gaps if g[0] >= least]
        slots = [(longest if j < m - 1 else gap - (m - 1) * longest, 0, k << 20 | j, n) for k, (gap, _, n) in enumerate(fit) for m in (max(1, gap // longest),) for j in range(m)]
        found = sweeper(spark, slots + [(length, 1, length, left[length][1]) for length in own]) if slots else []
        if not found:
            new = -(-sum(left[length][1] for length in own) // each)
            gaps.append((capacity, opened, new))
            opened += new
            continue
        taken: defaultdict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        matched: defaultdict[int, int] = defaultdict(int)
        for length, slot, doc_at, gap_at, n in found:
            taken[slot >> 20].append((slot & 0xFFFFF, gap_at, n, length, left[length][0] + doc_at))
            matched[length] += n
        shorter = [g for g in gaps if g[0] < least]
        for k, (gap, first, n) in enumerate(fit):
            here = sorted(taken[k])
            cuts = sorted({0, n, *(at for _, at, _, _, _ in here), *(at + m for _, at, m, _, _ in here)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                used = 0
                for _, at, m, length, rank in here:
                    if at <= a < at + m:
                        out.append((length, rank + a - at, first + a, capacity - gap + used))
                        used += length
                if gap > used:
                    shorter.append((gap - used, first + a, b - a))
        gaps = joined(shorter)
        for length, n in matched.items():
            rank, there = left.pop(length)
            if there > n:
                left[length] = rank + n, there - n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def joined(gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(gap, first sequence, how many) with neighbouring runs of one gap as one."""
    out: list[tuple[int, int, int]] = []
    for gap, first, n in sorted(gaps):
        if out and out[-1][0] == gap and out[-1][1] + out[-1][2] == first:
            out[-1] = gap, out[-1][1], out[-1][2] + n
        else:
            out.append((gap, first, n))
    return out


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """cut (doc_id, piece, length, ...) with sequence_id and offset. The rows are written once, so their parts stay as they are."""
    columns = cut.columns
    held = checkpointed(cut.withColumn("__part", F.spark_partition_id()))
    each = held.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # At most one row for each length up to the capacity comes to the driver.
    counts = {int(n): int(k) for n, k in each.groupBy("length").agg(F.sum("__n")).collect()}
    segments = best_fit(cut.sparkSession, counts, capacity)
    keys = segments[:, 0] << 44 | segments[:, 1]
    ranked = held.withColumn("__at", F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(starts, ["length", "__part"]).withColumn("__rank", F.col("__start") + F.col("__at")).select(*columns, "__rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence = segments[at, 2] + rank - segments[at, 1] if len(at) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(segments[at, 3] if len(at) else sequence)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(look_up, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
