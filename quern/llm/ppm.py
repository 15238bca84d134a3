"""Language-model scores by prediction by partial matching over bytes, with a model learnt from the corpus.

The model is a trie of byte contexts up to a given order with the counts of the bytes that followed them, gathered from
all training texts. A text's score is the log10 probability of its bytes (A-Z lower-cased) and of its end. Each byte is
coded in the longest known context: with the estimate of PPM's method D, a context that saw n bytes of q kinds gives a
byte seen c times (2c - 1) / 2n and the escape q / 2n; after an escape the next shorter context codes, leaving out all
bytes of the longer one (symbol exclusion), down to equal shares of the bytes never seen.

The model keeps every sequence it counted and grows with the corpus, so no worker holds all of it. It lies in the shared
folder in parts, dealt by the last two bytes of the context: a part with the counts of orders 0 and 1, which are few, is
all that a sequence dealt to it can be scored with. Texts are laid down in blocks; each block sends its distinct
sequences to the parts, gets their scores back and adds them up over its texts. A caller may give nodes; then only
sequences with at least a 1/nodes share of all training bytes are kept, and what a context saw beyond them counts
towards its escape. As a longer sequence never outnumbers its end, all that a kept context knows its shorter ones know
too; what an escape costs, given what is left out, is then a number per context.

The base score is that of single words. Word counts are complete as well; words with at least a 1/WORDS share of all
training tokens (at most WORDS of them) are scored where the text is read, the others by a join with the counts.

Defined cases: a null text is empty and has its end as the only token; a null key is held out (its crc32 is that of the
empty text); rows with equal keys are scored alike; an empty table gives an empty result; other columns are not read;
without training rows the score is that of equal shares. Very long texts are scored whole, in blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, remainder, row_blocks, utf8, written

#: Longest context in bytes; sequences have one byte more.
ORDER = 6
#: Words that are scored without a join at most.
WORDS = 1 << 20
#: No UTF-8 text holds these bytes: they stand before its start and at its end.
START, END = 0xFE, 0xFF
#: Bytes that can follow a context: all but START.
ALPHABET = 255
#: Positions that are counted or scored at a time, and bytes of the texts that ask for scores together.
COUNTED, SCORED, BLOCK = 1 << 20, 1 << 18, 1 << 23
#: Counted sequences that a task holds; beyond that it sends them on.
HELD = 1 << 20
#: An odd factor spreads keys over 64 bits, and different keys stay different.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def remove(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    sc, files = df.sparkSession.sparkContext, df.inputFiles()
    if files:
        path = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stream(raw: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with order START bytes before and one END behind each, and where each one's first START is."""
    view, at, start, end = memoryview(raw), ends.tolist(), bytes([START]) * order, bytes([END])
    joined = b"".join(x for i, j in zip(at, at[1:], strict=False) for x in (start, bytes(view[i:j]).lower(), end))
    return np.frombuffer(joined, np.uint8), ends[:-1] + np.arange(len(ends) - 1) * (order + 1)


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """The sequences of length bytes that end at data[length - 1:], as integers."""
    n = len(data) - length + 1
    key = data[:n].astype(np.uint64)
    for k in range(1, length):
        key <<= np.uint64(8)
        key |= data[k : k + n]
    return key


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums.astype(np.int64)


def pack_table(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts in a few bytes each."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    return len(keys).to_bytes(8, "little") + pa.compress(np.concatenate((gaps, counts.astype(np.uint64))).tobytes(), "zstd", asbytes=True)


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    both = np.frombuffer(pa.decompress(data[8:], 16 * n, "zstd", asbytes=True), np.uint64)
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def merge(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tables[0] if len(tables) == 1 else tally(np.concatenate([k for k, _ in tables]), np.concatenate([n for _, n in tables]))


def pack_text(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_text(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)


def pack_scores(scores: np.ndarray) -> bytes:
    """Single precision, byte by byte of all numbers, as the first ones hardly vary."""
    return pa.compress(scores.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack_scores(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<f4")[:, 0]


def dealt(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The keys and counts of each part that has any; what parts a key is told by the last two bytes of its context."""
    # Numbers of 16 bits are sorted by counting.
    part = (((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65536) % np.uint64(parts)).astype(np.uint16)
    by = np.argsort(part, kind="stable")
    keys, counts, part = keys[by], counts[by], part[by].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
        yield int(part[i]), keys[i:j], counts[i:j]


def sequences(data: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The sequences of order + 1 bytes in a stream, some at a time; those that end in START belong to no text, or to two."""
    for at in range(0, len(data) - order, COUNTED):
        piece = data[at : at + COUNTED + order]
        yield windows(piece, order + 1)[piece[order:] != START]


def parts_of(texts: DataFrame) -> int:
    return min(1 << 16, max(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def counted(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, data): all sequences of order + 1 bytes and their counts, in packed tables of which no two share a sequence.

    Each task counts its sequences and sends them on as compressed tables, dealt by the last two bytes of the context, so
    that whoever gets them can tell all orders from 2 on by itself.
    """

    def tables(held: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in dealt(*held, parts):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack_table(keys, counts)], pa.binary())], ["part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            raw, ends = utf8(batch.column(0))
            for a, b in row_blocks(ends, COUNTED):
                data, _ = stream(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], order)
                for keys in sequences(data, order):
                    held.append(tally(keys))
                    size += len(held[-1][0])
                    if size > HELD:
                        held = [merge(held)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield from tables(held[0])
                            held, size = [], 0
        if size:
            yield from tables(merge(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tables come sorted by part; those of a part are merged as they come."""
        now, held, size = None, [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            keys, counts = merge(held)
            for at in range(0, len(keys), 1 << 20):
                data = pack_table(keys[at : at + (1 << 20)], counts[at : at + (1 << 20)])
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield from merged()
                    held, size = [], 0
                now = part
                held.append(unpack_table(data.as_py()))
                size += len(held[-1][0])
                if len(held) > 1 and size > 2 * len(held[0][0]) + HELD // 4:
                    held = [merge(held)]
                    size = len(held[0][0])
        if held:
            yield from merged()

    sent = texts.mapInArrow(count, "part int, data binary").repartition(parts, "part").sortWithinPartitions("part")
    return sent.mapInArrow(add, "part int, data binary")


def levels(keys: np.ndarray, counts: np.ndarray, order: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each k from order down to 1, the sequences of k + 1 bytes that occur at least so often, their counts and those of their contexts.

    keys and counts are all sequences of order + 1 bytes of a part. Of order 1 a part knows parts; those come whole.
    """
    out = {}
    for k in range(order, 0, -1):
        if k < order:
            keys, counts = tally(keys & np.uint64((1 << 8 * (k + 1)) - 1), counts)
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.empty(0, np.int64)
        total = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))) if len(keys) else counts
        keep = counts >= least if k > 1 else np.ones(len(keys), bool)
        out[k] = keys[keep], counts[keep], total[keep]
    return out


def low_orders(tables: DataFrame, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The model's counts of orders 0 and 1; there are at most 65,536 different sequences of two bytes."""

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [tally(k & np.uint64(0xFFFF), n) for k, n in (unpack_table(x.as_py()) for x in batch.column(0))]
        keys, counts = merge(found)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    low = map_arrow(tables.select("data"), pairs, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    pair, found = low.column("key").to_numpy().astype(np.int64), low.column("n").to_numpy().astype(np.int64)
    by_context, by_byte = np.bincount(pair >> 8, found, 256).astype(np.int64), np.bincount(pair & 255, found, 256).astype(np.int64)
    kept, single = found >= least, np.flatnonzero(by_byte >= least)
    return [(single, by_byte[single], np.full(len(single), by_byte.sum())), (pair[kept], found[kept], by_context[pair[kept] >> 8])]


class Table:
    """Values by 64-bit keys, looked up for whole arrays: sorted by spread key, found through a table of its first bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        spread = keys.astype(np.uint64) * SPREAD
        order = np.argsort(spread)
        self.spread, self.values = spread[order], [v[order].astype(np.float32) for v in values]
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.spread >> self.shift, np.arange((1 << bits) + 1).astype(np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.spread):
            return out
        spread = keys * SPREAD
        slot = (spread >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, spread = at[left], end[left], spread[left]
        while len(left):
            hit = self.spread[at] == spread
            out[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            left, at, end, spread = left[go], at[go], end[go], spread[go]
        return out


class Model:
    """The kept trie with its escape estimates; see the module's text.

    counts[k]: (keys, counts, totals of their contexts) of the kept sequences of k + 1 bytes; a context is a key's all
    but last byte. Logarithms are to base 10.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.order = len(counts) - 1
        self.sequences: list[Table] = []
        self.contexts: list[Table] = []
        below: tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]] | None = None
        for k, (keys, n, totals) in enumerate(counts):
            order = np.argsort(keys)
            keys, n, totals = keys[order].astype(np.uint64), n[order].astype(np.int64), totals[order].astype(np.int64)
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.empty(0, np.int64)
            q = np.diff(np.append(first, len(keys))).astype(np.float64)
            seen = np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)
            lost = 2.0 * (totals[first] - seen)
            shares, escape = 2.0 * n - 1, q + lost
            # With every possible byte seen and kept there is nothing to escape to.
            escape[(q == ALPHABET) & (lost == 0)] = 0
            whole = (np.add.reduceat(shares, first) if len(first) else np.empty(0)) + escape
            of = np.repeat(np.arange(len(first)), q.astype(np.int64))
            own = {"lost": lost, "q": q, "shares": whole - escape}
            after_whole = after_escape = np.zeros(len(first))
            if below is not None and len(first):
                low_keys, low_shares, low = below
                # The same sequence and the same context, each without its first byte, one order below.
                mask = np.uint64((1 << 8 * k) - 1)
                excluded = np.add.reduceat(low_shares[np.searchsorted(low_keys, keys & mask)], first)
                at = np.searchsorted(low["contexts"], context[first] & np.uint64((1 << 8 * (k - 1)) - 1))
                kinds = low["q"][at] - q
                after_escape = np.where((low["q"][at] == ALPHABET) & (low["lost"][at] == 0), 0, kinds + low["lost"][at])
                after_whole = low["shares"][at] - excluded + after_escape
            log = lambda x: np.log10(np.maximum(x, 1e-300))
            self.sequences.append(Table(keys, log(shares), log(shares) - log(whole)[of]))
            # What leaving the context costs, what the next one's shares are divided by, and what leaving that one costs.
            self.contexts.append(Table(context[first], log(escape) - log(whole), log(after_whole), np.where(after_whole > 0, log(after_escape) - log(after_whole), 0)))
            own["contexts"] = context[first]
            below = (keys, shares, own)
        self.kinds = len(counts[0][0])

    def score(self, data: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte of data[order:] after those before it; 0 for START."""
        out = np.zeros(len(data) - self.order, np.float64)
        left = np.flatnonzero(data[self.order :] != START)
        out[left] = self.score_keys(windows(data, self.order + 1)[left])
        return out

    def score_keys(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each sequence of order + 1 bytes after the others."""
        order, left = self.order, np.arange(len(key))
        out = np.zeros(len(key), np.float64)
        came = np.full(len(left), -1, np.int64)
        for k in range(order, -1, -1):
            own = key & np.uint64((1 << 8 * (k + 1)) - 1)
            table, contexts = self.sequences[k], self.contexts[k]
            at = table.find(own)
            hit = at >= 0
            fresh = hit & (came < 0)
            out[left[fresh]] += table.values[1][at[fresh]]
            if k < order:
                late = hit & (came >= 0)
                out[left[late]] += table.values[0][at[late]] - self.contexts[k + 1].values[1][came[late]]
            miss = ~hit
            left, key, own, came = left[miss], key[miss], own[miss], came[miss]
            if not len(left):
                return out
            here = contexts.find(own >> np.uint64(8))
            known, later = here >= 0, came >= 0
            if k < order:
                out[left[later]] += self.contexts[k + 1].values[2][came[later]]
            start = known & ~later
            out[left[start]] += contexts.values[0][here[start]]
            came = here
        out[left] -= np.log10(max(1, ALPHABET - self.kinds))
        return out


def least_of(positions: int, order: int, nodes: int | None) -> int:
    if not 2 <= order <= 6:
        raise ValueError("contexts have 2 to 6 bytes")
    return 1 if nodes is None else max(1, -(-positions // nodes))


def train(texts: DataFrame, positions: int, order: int = ORDER, nodes: int | None = None) -> Model:
    """The whole model of all texts (one string column) with so many bytes and ends in all, on the driver."""
    least = least_of(positions, order, nodes)
    tables = written(counted(texts, order, parts_of(texts)))
    found = [unpack_table(x.as_py()) for x in tables.select("data").toArrow().column(0)]
    high = levels(*merge(found), order, least) if found else levels(np.empty(0, np.uint64), np.empty(0, np.int64), order, least)
    return Model([*low_orders(tables, order, least), *(high[k] for k in range(2, order + 1))])


def blocks(rows: DataFrame) -> DataFrame:
    """(block, keys, held, data, ends): the rows (key, text, held_out), with about BLOCK bytes of texts in each row of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, ends = utf8(batch.column(1))
            for a, b in row_blocks(ends, BLOCK):
                keys, held = (pa.array([batch.column(c).slice(a, b - a).to_pylist()], pa.list_(batch.column(c).type)) for c in (0, 2))
                data, cut = pack_text(raw[ends[a] : ends[b]].tobytes()), (ends[a : b + 1] - ends[a]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), keys, held, pa.array([data], pa.binary()), pa.array([cut], pa.binary())], ["block", "keys", "held", "data", "ends"])
                block += 1

    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.select("key", "text", "held_out").mapInArrow(run, f"block bigint, keys array<{kind}>, held array<boolean>, data binary, ends binary"))


def single(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def asked(data: np.ndarray, order: int) -> np.ndarray:
    """The distinct sequences of a block's stream, sorted."""
    held, size = [], 0
    for keys in sequences(data, order):
        held.append(single(keys))
        size += len(held[-1])
        if size > 8 * COUNTED:
            held = [single(np.concatenate(held))]
            size = len(held[0])
    return single(np.concatenate(held)) if held else np.empty(0, np.uint64)


class Places:
    """Where known keys stand, for whole arrays of them: in the order of spread keys, found through a table of their first bits."""

    def __init__(self, keys: np.ndarray):
        spread = keys * SPREAD
        self.order = np.argsort(spread)
        self.spread = spread[self.order]
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        first = np.bincount((self.spread >> self.shift).astype(np.intp), minlength=1 << bits)
        self.starts = np.concatenate(([0], np.cumsum(first))).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; all of them are among those given."""
        spread = keys * SPREAD
        at = self.starts[(spread >> self.shift).astype(np.intp)]
        left = np.flatnonzero(self.spread[at] != spread)
        while len(left):
            at[left] += 1
            left = left[self.spread[at[left]] != spread[left]]
        return at


def answers(laid: DataFrame, tables: DataFrame, low: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int, order: int, least: int) -> DataFrame:
    """(block, part, n, scores): the n scores of each block's sequences that a part was asked for, in their order."""
    few = laid.sparkSession.sparkContext.broadcast(low)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                keys = asked(stream(unpack_text(raw.as_py()), np.frombuffer(ends.as_py(), np.int64), order)[0], order)
                for part, some, none in dealt(keys, np.zeros(len(keys), np.int64), parts):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([pack_table(some, none)], pa.binary())], ["part", "block", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by part and block; those of the model (block -1) come before the questions."""
        now, held, model = None, [], None
        for batch in batches:
            for part, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != now:
                    now, held, model = part, [], None
                keys, counts = unpack_table(data.as_py())
                if block < 0:
                    held.append((keys, counts))
                    continue
                if model is None:
                    high = levels(*(merge(held) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))), order, least)
                    model, held = Model([*few.value, *(high[k] for k in range(2, order + 1))]), []
                scores = pack_scores(model.score_keys(keys))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([scores], pa.binary())], ["block", "part", "n", "scores"])

    asks = laid.select("block", "data", "ends").mapInArrow(ask, "part int, block bigint, data binary")
    both = asks.unionByName(tables.select("part", F.lit(-1).cast("bigint").alias("block"), "data"))
    return both.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, "block bigint, part int, n bigint, scores binary")


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts (one string column), added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words, n = list(held.keys()), list(held.values())
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.binary()).cast(pa.string()), pa.array(n[at : at + (1 << 16)], pa.int64())], ["word", "n"])

        for batch in batches:
            raw, ends = utf8(batch.column(0))
            view, at = memoryview(raw), ends.tolist()
            for i, j in zip(at, at[1:], strict=False):
                held.update(bytes(view[i:j]).lower().split())
                if len(held) > 200_000:
                    yield from rows()
                    held.clear()
        yield from rows()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, order: int = ORDER, nodes: int | None = None, common: int = WORDS) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the key is divisible by folds are held out; the model learns from the others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (remainder(key, folds) == 0).alias("held_out"))
    texts = rows.filter("NOT held_out").select(F.coalesce("text", F.lit("")).alias("text"))
    n_docs, n_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    least, parts = least_of(n_docs + n_bytes, order, nodes), parts_of(texts)
    tables, laid = written(counted(texts, order, parts)), blocks(rows)
    scores = answers(laid, tables, low_orders(tables, order, least), parts, order, least)

    words = written(count_words(texts))
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = n_words + n_docs, kinds + (n_docs > 0)
    divisor = tokens + 0.1 * (distinct + 1)
    often = words.filter(F.col("n") >= max(1, -(-n_words // common))).toArrow()
    logs = np.log10((often.column("n").to_numpy() + 0.1) / divisor).tolist()
    known = spark.sparkContext.broadcast(dict(zip((w.encode() for w in often.column("word").to_pylist()), logs, strict=True)))
    end = float(np.log10((n_docs + 0.1) / divisor))

    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by block and part; a block's texts (part -1) come before the answers it got."""
        frequent, row = known.value, TaskContext.get().partitionId() << 36
        text, held = None, []

        def scored() -> Iterator[pa.RecordBatch]:
            nonlocal row
            ids, held_out, raw, ends = text
            data, starts = stream(raw, ends, order)
            sought = asked(data, order)
            scores, total = np.empty(len(sought), np.float32), np.zeros(len(ends) - 1)
            if held:
                # Packed as they were asked for.
                scores[np.concatenate([at for *_, at in dealt(sought, np.arange(len(sought)), parts)])] = np.concatenate(held)
            places = Places(sought)
            scores = scores[places.order]
            for at, keys in zip(range(0, len(data) - order, COUNTED), sequences(data, order), strict=True):
                piece = data[at + order : at + order + COUNTED]
                values = np.zeros(len(piece))
                values[piece != START] = scores[places.find(keys)]
                i, j = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(values))
                total[i:j] += np.add.reduceat(values, np.maximum(starts[i:j] - at, 0))
            view = memoryview(raw)
            for a, b in row_blocks(ends, SCORED):
                to = ends[a : b + 1].tolist()
                n_tokens, n_known, base, rare, times = [], [], [], [], []
                for i, j in zip(to, to[1:], strict=False):
                    words_here = bytes(view[i:j]).lower().split()
                    here = list(map(frequent.get, words_here))
                    others = Counter([w for w, x in zip(words_here, here, strict=True) if x is None]) if None in here else {}
                    n_tokens.append(len(words_here) + 1)
                    n_known.append(len(words_here) - sum(others.values()) + (n_docs > 0))
                    base.append(sum(x for x in here if x is not None) + end)
                    rare.append([w.decode() for w in others])
                    times.append(list(others.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), ids.slice(a, b - a), held_out.slice(a, b - a), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(total[a:b]), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                    ["row", "key", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"],
                )
                row += b - a

        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                if part < 0:
                    if text is not None:
                        yield from scored()
                    text = (*(batch.column(c)[k].values for c in ("keys", "held")), unpack_text(batch.column("data")[k].as_py()), np.frombuffer(batch.column("ends")[k].as_py(), np.int64))
                    held = []
                else:
                    held.append(unpack_scores(batch.column("scores")[k].as_py(), batch.column("n")[k].as_py()))
        if text is not None:
            yield from scored()

    asks = laid.withColumn("part", F.lit(-1)).unionByName(scores, allowMissingColumns=True)
    returned = asks.repartition(parts, "block").sortWithinPartitions("block", "part")
    scored = written(returned.mapInArrow(run, f"row bigint, key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<string>, times array<bigint>"))
    remove(laid), remove(tables)
    single = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = single.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / divisor)).alias("rest"))
    whole = scored.drop("rare", "times").join(late, "row", "left")
    return whole.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
