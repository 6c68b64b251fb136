"""Ordered operations per key that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here each
key is cut into ordered buckets (a time slice or an ordinal range): the window
runs inside (key, bucket), and only one summary row per bucket is ordered over
the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def number_rows(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], bucket: Column, out: str
) -> DataFrame:
    """``row_number`` per key. ``bucket`` must not decrease along ``order_by``."""
    cut = df.withColumn("_bucket", bucket)
    offsets = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(
                    W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    local = cut.withColumn(
        "_local", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order_by))
    )
    return (
        local.join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_local", "_before", "_bucket")
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """``lag(value, 1)`` per key. ``bucket`` must not decrease along ``order_by``."""
    cut = df.withColumn("_bucket", bucket).withColumn("_value", value)
    order = F.struct(*order_by)
    tails = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.max_by(F.struct("_value"), order).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_bucket")))
        .select(*keys, "_bucket", "_carry")
    )
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order_by)
    local = cut.withColumn("_lag", F.lag(F.struct("_value")).over(inner))
    return (
        local.join(tails, [*keys, "_bucket"])
        .withColumn(out, F.coalesce("_lag", "_carry")["_value"])
        .drop("_bucket", "_value", "_lag", "_carry")
    )
