"""Keys that hold too many rows for one task, and joins that spread them.

Plain joins of two tables need none of this: adaptive execution splits their skewed partitions.
It cannot where one side is an aggregate by the join key, which brings no shuffle of its own to
the join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quayside.session import scratch_folder

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


class HotKeys(NamedTuple):
    """Keys with more rows than ``limit``, and the number of ``_parts`` to cut each into."""

    keys: DataFrame
    limit: int


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``hot_rows`` rows (NULL among them), or None where there are none.

    One job counts the rows of each key, reading the key column alone, and leaves the counts above ``hot_rows``
    in the shared folder. No more than ``MAX_HOT_KEYS`` keys can each hold more than 1/MAX_HOT_KEYS of
    all rows, so raising the limit to that share bounds the list, which is broadcast, and the sum
    of its parts to twice that number.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    path = scratch_folder(rows.sparkSession, "key-rows")
    seen = Observation()
    watched = counts.observe(seen, F.sum("_rows").alias("total"), F.max("_rows").alias("most"))
    watched.where(F.col("_rows") > hot_rows).write.parquet(path)
    limit = max(hot_rows, (seen.get["total"] or 0) // MAX_HOT_KEYS)
    if (seen.get["most"] or 0) <= limit:
        return None
    counts = rows.sparkSession.read.schema(counts.schema).parquet(path)
    keys = counts.where(F.col("_rows") > limit).select(
        key, F.ceil(F.col("_rows") / limit).alias("_parts")
    )
    return HotKeys(keys, limit)


def flag_hot(rows: DataFrame, hot: HotKeys, key: str, *columns: Column) -> DataFrame:
    """Rows with columns of their hot key; NULL keys find the hot key NULL."""
    marks = hot.keys.select(F.col(key).alias("_hot_key"), *columns)
    return rows.join(F.broadcast(marks), rows[key].eqNullSafe(marks["_hot_key"]), "left").drop("_hot_key")


def spread_join(
    left: DataFrame, right: DataFrame, key: str, row_id: str, hot: HotKeys | None
) -> DataFrame:
    """Left join in which the left rows of a hot key go to several tasks.

    The part follows from the row id, so that a repeated task sends each row the same way. The
    right rows of a hot key are repeated once per part.
    """
    if hot is None:
        return left.join(right, key, "left")
    part = F.pmod(F.xxhash64(row_id), F.coalesce("_parts", F.lit(1)))
    left = flag_hot(left, hot, key, F.col("_parts")).withColumn("_part", part).drop("_parts")
    last = F.coalesce("_parts", F.lit(1)) - 1
    right = flag_hot(right, hot, key, F.col("_parts")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    return left.join(right.drop("_parts"), [key, "_part"], "left").drop("_part")
