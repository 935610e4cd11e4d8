"""Distinct counts that add up over loads: a HyperLogLog sketch per day and key, unioned on read.

Exact distinct counts of a growing table read every row again; the sketches of a day are a few kilobytes a key,
are built once with map-side combine, and any set of days is answered from them. The relative standard error is
1.04 / sqrt(2 ** lg_k), whatever the number of rows; ``ERROR_SIGMAS`` of it are the stated bound.

Edge cases. Null items count nothing, empty text is an item like any other. Null days and keys are groups of
their own. A repeated load of the same rows changes no estimate. An empty table gives no sketches and no counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
ERROR_SIGMAS = 4


def stated_error(lg_k: int = LG_K) -> float:
    """The relative error that an estimate stays within, but for about one in 10,000."""
    return ERROR_SIGMAS * 1.04 / math.sqrt(1 << lg_k)


def day_sketches(df: DataFrame, day: Column, keys: list[str], item: str, lg_k: int = LG_K) -> DataFrame:
    """(day, keys, rows, sketch): one sketch of the items of each day and key. Items are sketched by a 64-bit hash."""
    marked = F.when(F.col(item).isNotNull(), F.xxhash64(item))  # the sketch itself would pass over empty text
    return (df.groupBy(day.alias("day"), *keys)
            .agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(marked, F.lit(lg_k)).alias("sketch")))


def distinct_over(sketches: DataFrame, keys: list[str], days: Column | None = None) -> DataFrame:
    """(keys, n_days, rows, estimate): distinct items over the days that ``days`` holds for (all, if None)."""
    chosen = sketches if days is None else sketches.where(days)
    return chosen.groupBy(*keys).agg(F.countDistinct("day").alias("n_days"), F.sum("rows").alias("rows"),
                                     F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
