"""Ordered per-key operations that never put a whole key into one task.

A plain `Window.partitionBy(key)` sends every row of a key to one task; with a
clip that holds a third of all frames that task never ends.  Here the key is
cut into buckets along its order.  Buckets are processed in parallel, and a
small per-bucket summary (one row per key and bucket) carries what a bucket
needs to know about the ones before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

BUCKET = "_bucket"


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                name: str, start: int = 0) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in `order`.

    `bucket` must not decrease along `order`; it decides how finely a key is
    split.  The order must be total within a key.
    """
    keys = list(keys)
    cut = df.withColumn(BUCKET, bucket)
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        cut.join(offsets, keys + [BUCKET])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset") + F.lit(start))
        .drop(BUCKET, "_offset")
    )


def previous_value(df: DataFrame, keys: Sequence[str], order: str, bucket: Column,
                   name: str) -> DataFrame:
    """Add the previous value of the unique integer column `order` within the key."""
    keys = list(keys)
    cut = df.withColumn(BUCKET, bucket)
    by_bucket = W.partitionBy(*keys).orderBy(BUCKET)
    carried = (
        cut.groupBy(*keys, BUCKET).agg(F.max(order).alias("_last"))
        .select(*keys, BUCKET, F.lag("_last").over(by_bucket).alias("_carried"))
    )
    inside = W.partitionBy(*keys, BUCKET).orderBy(order)
    return (
        cut.join(carried, keys + [BUCKET])
        .withColumn(name, F.coalesce(F.lag(order).over(inside), F.col("_carried")))
        .drop(BUCKET, "_carried")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, bucket: Column,
                name: str) -> DataFrame:
    """Add the sum of `value` over the key's rows up to and including this one."""
    keys = list(keys)
    cut = df.withColumn(BUCKET, bucket)
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, BUCKET).agg(F.sum(value).alias("_n"))
        .select(*keys, BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*keys, BUCKET).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.join(offsets, keys + [BUCKET])
        .withColumn(name, F.sum(value).over(inside) + F.col("_offset"))
        .drop(BUCKET, "_offset")
    )


def index_bucket(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width)}")


def with_halo(df: DataFrame, order: str, width: int, before: int,
              segment: str = "segment", halo: str = "is_halo") -> DataFrame:
    """Cut a numbered sequence into segments of `width` and repeat the last
    `before` numbers of each segment at the head of the next one.

    A window over (key, segment) then sees `before` earlier rows without the
    whole key meeting in one task.  Each row is repeated at most once when
    `width >= before`.
    """
    if before > width:
        raise ValueError(f"{before} rows of lead-in need segments at least that long, not {width}")
    own = F.expr(f"`{order}` div {int(width)}")
    tail = (F.col(order) % F.lit(width)) >= F.lit(width - before)
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("_own", own)
        .withColumn(segment, F.explode(copies))
        .withColumn(halo, F.col(segment) != F.col("_own"))
        .drop("_own")
    )
