"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source; targets follow from the weights, with a ceiling; a source's repetition rate is its target
over its words. Each document is then emitted floor(rate) times plus one more copy with a probability of the rate's
fraction, drawn from a hash of the document, so that reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, sorted last; null or repeated doc_ids draw
from their own hash, so rows that are equal draw alike; sources without words have rate 0; an empty table gives no rows.
The operators leave all other columns as they are; names that begin with __mix_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, broadcast_if_small, checkpointed


def n_words(text: Column) -> Column:
    """Number of words without building a list of them: each becomes one letter, then the space goes."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """Targets of the sources in sizes (source, source_size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. With r = ceiling *
    size / weight, the sources that reach their ceiling are those with the smallest r: sorted by r, the level that the
    rest share is (total - ceilings so far) / (weights left), and the first level not above the next r is the right one.
    This is the fixed point of handing the excess to the others by weight until none is above its ceiling.
    """
    # One row per source is left here, so that one ordered window is cheap however large the corpus is.
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("r", F.col("source_size") * F.lit(float(ceiling)) / F.col("weight"))
    by_r = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, whole = by_r.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * ceiling
    level = (F.sum("source_size").over(whole) - capped) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("nth", F.row_number().over(by_r))
    w = w.withColumn("first", F.min(F.when(F.col("level") <= F.col("r"), F.struct("nth", "r", "level"))).over(whole))
    target = F.when(F.col("r") < F.col("first.r"), F.col("source_size") * F.lit(float(ceiling))).otherwise(F.col("first.level") * F.col("weight"))
    return w.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def draw(key: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the key and the seed."""
    text = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def plan(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """docs with __mix_size, __mix_source_size, __mix_target and __mix_copies.

    Texts are not shuffled unless there are more sources than may be broadcast: the counts per source are combined
    before their shuffle, and the rates come back by a join.
    """
    sized = docs.withColumn("__mix_size", n_words(F.col("text")))
    sums = sized.groupBy(F.col("source").alias("source")).agg(F.sum("__mix_size").alias("source_size"))
    rates = checkpointed(targets(checkpointed(sums), weights, ceiling)).select(
        F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target")
    )
    rated = sized.join(broadcast_if_small(rates), F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw("doc_id", seed) < rate - whole, 1).otherwise(0)
    return rated.withColumn("__mix_copies", copies.cast("int"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """The mixed corpus, with the columns of docs: each document as often as the mix takes it."""
    planned = plan(docs, seed, weights, ceiling)
    copies = planned.filter("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))
