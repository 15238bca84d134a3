"""Collections from files, memory and databases. All give a DataFrame with an id column, typed or with a VARIANT."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, id_field: str = "_id", variant: str = "doc") -> DataFrame:
    """(_id, variant): schemaless documents, one per line."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias(variant)).filter(F.col(variant).isNotNull())
    return lines.select(F.try_variant_get(variant, f"$['{id_field}']", "string").alias("_id"), variant)


def memory(spark: SparkSession, docs: Iterable[dict], variant: str | None = "doc", schema: str | None = None) -> DataFrame:
    """Documents at hand: as VARIANTs, or typed with a schema."""
    docs = list(docs)
    if schema is not None:
        return spark.createDataFrame(docs, schema)
    rows = [(d.get("_id"), json.dumps(d)) for d in docs]
    return spark.createDataFrame(rows, "_id string, body string").select("_id", F.parse_json("body").alias(variant))


def jdbc(spark: SparkSession, url: str, table: str, **options: Any) -> DataFrame:
    """A table of a database whose driver is on the class path; give partitionColumn, bounds and numPartitions for large ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


ADAPTERS = {"parquet": parquet, "json": json_lines, "memory": memory, "jdbc": jdbc}


def open_collection(spark: SparkSession, adapter: str, *args: Any, **options: Any) -> DataFrame:
    if adapter not in ADAPTERS:
        raise ValueError(f"Invalid Adapter: {adapter}")
    return ADAPTERS[adapter](spark, *args, **options)


def write_json_lines(df: DataFrame, path: str, variant: str | None = None) -> None:
    """One JSON document per line: the VARIANT column, or all columns."""
    text = F.to_json(variant) if variant else F.to_json(F.struct(*df.columns))
    df.select(text.alias("value")).write.mode("overwrite").text(path)
