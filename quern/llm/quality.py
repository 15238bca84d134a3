"""Quality rules with cutoffs whose false rejections are bounded by labelled texts.

Each rule is a measure of a text that is high for bad ones: symbols, capitals and marks per word, repeated lines and
word windows, word length. Its candidate cutoffs are every STEP-th of fixed levels. The good labelled texts of a stratum
(a language) bound a cutoff's false rejection rate from above, by the exact binomial (Clopper-Pearson) limit at the
allowed error probability divided by all strata, rules and candidates (Bonferroni), so that all bounds hold at once and
cutoffs may be chosen by looking at the data. They are chosen one by one: the cutoff that rejects most bad texts that
are left, the most lenient one that rejects nearly as many, as long as the bounds of all chosen ones sum up to no more than the
limit. With the stated confidence no stratum loses more than the limit of its good texts that pass the base, which is a
rule of its own without a bound; where too few are labelled, a rule rests. All labelled texts that pass the base count;
only their numbers per level are brought together.

Defined cases: a null text has no words (and fails the base); a null language is a stratum of its own; a text whose
stratum has no labels meets the base alone; labels without quality or without a text are ignored, repeated ones count
each; an empty table gives an empty result. Other columns are kept as they are; names that begin with __q_ are reserved.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import broadcast_if_small, checkpointed, utf8, written

RULES = ("symbols", "capitals", "marks", "dup_lines", "repeats", "word_length")
#: A measure x has the level floor(8 * log2(1 + 1000 x)); at most 255. Cutoffs lie at every second one.
LEVELS, STEP = 256, 2


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    levels: list[int]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated(words: list[bytes]) -> int:
    """How many words lie in windows of three that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def level(x: float) -> int:
    return min(LEVELS - 1, int(8 * math.log2(1 + 1000 * x)))


def measure(text: bytes) -> Measures:
    """What the rules and the base need of one whole text in UTF-8."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup, rep = len(lines) - len(set(lines)), repeated(words)
    capitals = sum(len(w) > 1 for w in words if w.isupper())
    marks = text.count(b"!") + text.count(b"?")
    each = max(n, 1)
    values = (symbols / each, capitals / each, marks / each, dup / max(len(lines), 1), rep / each, chars / each)
    return Measures(n, chars, symbols, dup, rep, list(map(level, values)))


ADDED = [("__q_n_words", T.LongType()), ("__q_word_chars", T.LongType()), ("__q_n_symbols", T.LongType()), ("__q_n_dup_lines", T.LongType()), ("__q_n_repeat_words", T.LongType()), ("__q_base_failed", T.BooleanType()), ("__q_levels", T.ArrayType(T.IntegerType()))]


def measured(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with the measures of each text; without the text itself if it isn't to be kept."""
    columns = [c for c in df.columns if c != text or keep_text]
    rows = df.select(*(F.col(f"`{c}`") for c in columns), F.col(text).alias("__q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = utf8(batch.column(len(columns)))
            view, at = memoryview(raw), ends.tolist()
            found = [measure(bytes(view[i:j])) for i, j in zip(at, at[1:], strict=False)]
            numbers = [pa.array([getattr(m, c) for m in found], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            more = [*numbers, pa.array([m.base_failed for m in found], pa.bool_()), pa.array([m.levels for m in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*columns, *(n for n, _ in ADDED)])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "__q_text"] + [T.StructField(n, t) for n, t in ADDED])
    # By position, as names with dots are not found there.
    return rows.toDF(*(f"_{k}" for k in range(len(columns) + 1))).mapInArrow(run, schema)


def tail(k: int, n: int, rate: float) -> float:
    """The probability of at most k of n, binomial, for a rate of at least k / n."""
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    term = total = math.exp(log)
    for i in range(k, 0, -1):  # below the mean, terms only fall
        term *= i * (1 - rate) / ((n - i + 1) * rate)
        total += term
        if term < total * 1e-15:
            break
    return total


@lru_cache(maxsize=1 << 16)
def upper(k: int, n: int, error: float, limit: float) -> float:
    """The exact upper confidence limit of a rate of which k in n were seen; 1 if it is above limit."""
    if n == 0 or k >= n * limit or tail(k, n, limit) > error:
        return 1.0
    low, high = max(k / n, 1e-12), limit
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(k, n, middle) > error else (low, middle)
    return high


def choose(good: np.ndarray, bad: np.ndarray, cuts: list[int], spent: float, rate: float, error: float, share: float = 0.99, least: float = 0.02) -> tuple[list[int], float]:
    """One more cutoff, if any is worth it: cuts and the sum of their bounds. good, bad: texts by rule and level; bad only those left.

    error is what each bound may miss by; LEVELS stands for no cutoff.
    """
    n, best = int(good[0].sum()), None
    for r in (r for r in range(len(RULES)) if cuts[r] == LEVELS):
        lost, caught = np.cumsum(good[r][::-1])[::-1], np.cumsum(bad[r][::-1])[::-1]
        bounds = [(x, int(caught[x]), upper(int(lost[x]), n, error, rate - spent)) for x in range(LEVELS - STEP, 0, -STEP)]
        allowed = [b for b in bounds if b[2] < 1]
        most = max((c for _, c, _ in allowed), default=0)
        if most and most >= least * bad[0].sum():
            x, c, u = next(b for b in allowed if b[1] >= share * most)
            if best is None or (c, -u) > (best[2], -best[3]):
                best = (r, x, c, u)
    if best is None:
        return cuts, spent
    return [best[1] if r == best[0] else c for r, c in enumerate(cuts)], spent + best[3]


def stratum(lang: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("-"))


def over(levels: str, cuts: str) -> Column:
    """Whether any level reaches its cutoff."""
    return F.exists(F.arrays_zip(F.col(levels).alias("x"), F.col(cuts).alias("y")), lambda z: z["x"] >= z["y"])


def cutoffs(levels: DataFrame, labels: DataFrame, rate: float = 0.05, error: float = 0.05) -> DataFrame:
    """(__q_stratum, __q_cuts): the cutoffs of each stratum. levels: doc_id and the columns of measured(), with __q_stratum."""
    known = labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("__q_quality"))
    met = checkpointed(levels.filter("NOT __q_base_failed").select("doc_id", "__q_stratum", "__q_levels").join(known, "doc_id").drop("doc_id"))
    state = checkpointed(met.select("__q_stratum").distinct().select("__q_stratum", F.array(*[F.lit(LEVELS)] * len(RULES)).alias("__q_cuts"), F.lit(0.0).alias("spent")))
    each = error / max(1, state.count() * len(RULES) * (LEVELS // STEP))

    def step(found: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros((len(RULES), LEVELS), np.int64), np.zeros((len(RULES), LEVELS), np.int64)
        good[found["rule"], found["level"]], bad[found["rule"], found["level"]] = found["good"], found["bad"]
        cuts, spent = choose(good, bad, list(found["__q_cuts"].iloc[0]), float(found["spent"].iloc[0]), rate, each)
        return pd.DataFrame({"__q_stratum": found["__q_stratum"][:1], "__q_cuts": [cuts], "spent": [spent]})

    active = 0
    for _ in RULES:
        left = (F.col("__q_quality") == 0) & ~over("__q_levels", "__q_cuts")
        single = met.join(broadcast_if_small(state), "__q_stratum").select("__q_stratum", (F.col("__q_quality") == 1).alias("good"), left.alias("bad"), F.posexplode("__q_levels").alias("rule", "level"))
        counts = single.groupBy("__q_stratum", "rule", "level").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
        # A group has at most a row for each rule and level.
        state = checkpointed(counts.join(state, "__q_stratum").groupBy("__q_stratum").applyInPandas(step, "__q_stratum string, __q_cuts array<int>, spent double"))
        now = state.agg(F.coalesce(F.sum(F.size(F.filter("__q_cuts", lambda c: c < LEVELS))), F.lit(0))).first()[0]
        if now == active:
            break
        active = now
    return state.select("__q_stratum", "__q_cuts")


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (measured, with __q_stratum) with __q_kept."""
    met = rows.join(broadcast_if_small(cuts), "__q_stratum", "left")
    return met.withColumn("__q_kept", ~F.col("__q_base_failed") & ~F.coalesce(over("__q_levels", "__q_cuts"), F.lit(False))).drop("__q_cuts")


def verdicts(docs: DataFrame, labels: DataFrame, rate: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, the five base measures, base_failed and kept of each document."""
    rows = checkpointed(measured(docs.select("doc_id", stratum("lang").alias("__q_stratum"), "text"), keep_text=False))
    kept = judged(rows, cutoffs(rows, labels, rate, error))
    return kept.select("doc_id", *(F.col(n).alias(n.removeprefix("__q_")) for n, _ in ADDED[:-1]), F.col("__q_kept").alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, rate: float = 0.05, error: float = 0.05) -> DataFrame:
    """The documents that are kept, with the columns of docs. Texts are measured once and not shuffled: they are written with their levels."""
    rows = written(measured(docs.withColumn("__q_stratum", stratum("lang"))), "quality")
    cuts = cutoffs(rows, labels, rate, error)
    return judged(rows, cuts).filter("__q_kept").select(*(F.col(f"`{c}`") for c in docs.columns))
