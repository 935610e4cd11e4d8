"""Distributed dense row index (0..n-1 in a given order), without a global
single-partition window.

Plan: approximate quantiles of the order key give B balanced buckets (B
numbers reach the driver); per-bucket counts become running offsets on a
B-row table (broadcast, bounded by B); each row's index is its row_number
inside its bucket plus the bucket offset. The window is partitioned by
bucket, so each task sorts about n/B rows. The order key must be unique per
row (ties would make the index order-dependent) and below 2**53.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, key: str, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dense_index(df: DataFrame, key: str, out: str = "row_idx",
                n_buckets: int | None = None, rel_error: float = 1e-4) -> DataFrame:
    """Add ``out`` = 0-based position of each row when ordered by ``key``."""
    b = _buckets(df, key, n_buckets)
    bkt = "_dix_bucket"
    if b > 1:
        qs = df.approxQuantile(key, [i / b for i in range(1, b)], rel_error)
        splits = sorted({float(q) for q in qs if q is not None})
    else:
        splits = []
    splits = [float("-inf")] + splits + [float("inf")]
    keyed = df.withColumn("_dix_key", F.col(key).cast("double"))
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="_dix_key", outputCol=bkt).transform(keyed)
    else:
        keyed = keyed.withColumn(bkt, F.lit(0.0))
    keyed = keyed.withColumn(bkt, F.col(bkt).cast("int")).drop("_dix_key")
    counts = keyed.groupBy(bkt).agg(F.count(F.lit(1)).alias("_dix_n"))
    offsets = counts.select(
        bkt, (F.sum("_dix_n").over(Window.orderBy(bkt)) - F.col("_dix_n")).alias("_dix_off"))
    w = Window.partitionBy(bkt).orderBy(F.col(key))
    return (keyed.join(F.broadcast(offsets), bkt)
            .withColumn(out, (F.row_number().over(w) - 1 + F.col("_dix_off")).cast("long"))
            .drop(bkt, "_dix_off"))
