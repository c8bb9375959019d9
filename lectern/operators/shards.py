"""Rows beside the model of their group, when a group may be too large for one task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that a task takes at once.
SHARD_ROWS = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by the hash of their keys in as many tasks as spark.sql.shuffle.partitions says: small groups of much work are not merged into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and what one stage keeps would stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sharded(rows: DataFrame, group: str, key: str, sizes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds shard: rows of a group are dealt by the hash of their key to parts of about shard_rows. sizes: (group, n)."""
    parts = sizes.select(F.col(group).alias("shard_group"), F.ceil(F.col("n") / shard_rows).alias("shards"))
    held = rows.join(parts, F.col(group).eqNullSafe(F.col("shard_group")))
    return held.withColumn("shard", F.pmod(F.xxhash64(key), F.col("shards")).cast("int")).drop("shard_group", "shards")


def beside(rows: DataFrame, models: DataFrame, group: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(rows of a shard, model rows of its group) for each shard; the models go to every shard of their group."""
    shards = rows.select(F.col(group).alias("of_group"), F.col("shard").alias("of_shard")).distinct()
    sent = models.join(shards, F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group").withColumnRenamed("of_shard", "shard")
    return dealt(rows, group, "shard").groupBy(group, "shard").cogroup(dealt(sent, group, "shard").groupBy(group, "shard")).applyInPandas(run, schema)
