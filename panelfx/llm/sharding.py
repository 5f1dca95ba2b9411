"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row depends on its key and on the number of shards only.  No
ring table is kept, and appending a shard moves just the rows that the new
shard takes over.

Defined results: rows with equal keys (null is a key too) share a shard; a
null text has no bytes; an empty table gives an empty table; columns besides
key and text are carried along untouched by ``shard`` and ignored by
``assignment``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

STEP = 2862933555777941757  # multiplier of the published generator (fixed value)
ROWS_PER_BIN = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys advance together until every jump passes ``shards``."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def shard_column(key: Column, shards: int) -> Column:
    """Shard number of a 64-bit key column."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards))

    return jump(key)


def shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` with the shard of its ``key`` column in ``name``."""
    return df.withColumn(name, shard_column(F.xxhash64(F.col(key)), shards))


def assignment(documents: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text",
               rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Shard, grown shard and gapless slot of every row.

    Slots number the rows of a shard from 0.  They are found without gathering
    a shard in one task: rows of a shard fall into hash bins of about
    ``rows_per_bin``, each bin is numbered by itself, and the counts of the
    bins before it are added.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.col(key)).alias("hash"),
        F.xxhash64(F.col(key), body).alias("order"),
    )
    rows = rows.withColumn("shard", shard_column(F.col("hash"), shards)).withColumn(
        "grown_shard", shard_column(F.col("hash"), shards + 1))
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / (shards * rows_per_bin))).cast("long")
    rows = rows.join(F.broadcast(n.select(bins.alias("bins"))))  # one row: an aggregate without keys
    rows = rows.withColumn("bin", F.pmod(F.col("order"), F.col("bins")))
    counts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bin", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("order", "doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("inside", inside).join(starts, ["shard", "bin"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("before") + F.col("inside")).cast("long").alias("slot"), "grown_shard")
