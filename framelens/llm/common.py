"""Helpers shared by the corpus operators: shared-folder tables, bounded Arrow batches, hot-key joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.session import checkpoint_dir

#: Rows per Arrow batch handed to a Python worker, so that a batch of very long texts stays small.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Keep a Python worker's batch to BATCH_ROWS rows (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan above starts from files that every executor sees: losing one repeats no work below the cut,
    and rows that a nondeterministic partitioning dealt out are dealt once.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, share: int = 1000) -> DataFrame:
    """``left`` left-joined to ``right`` (one row per key) when some keys hold a large part of ``left``.

    ``right[rows]`` is the number of left rows of that key and ``total`` the number of all left rows. Keys with
    more than total/share rows number fewer than ``share``, whatever the data, so that part of ``right`` is
    broadcast; their left rows take a spread-out key in the shuffle join, which serves all other keys.
    ``right`` must be a stored table, for it is read twice. Columns of ``right`` but key and ``rows`` are added.
    """
    values = [c for c in right.columns if c not in (key, rows)]
    least = max(total // share, 1)
    hot = right.where(F.col(rows) > least).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    rest = right.where(F.col(rows) <= least).select(F.col(key).alias("_rk"), *values, F.lit(True).alias("_found"))
    tagged = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # a hot row meets no row of `rest`; any even spread of its key will do
    spread = F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id() % 4096)
    joined = tagged.withColumn("_spread", spread).join(
        rest.withColumn("_none", F.lit(None).cast("long")),
        (F.col(key) == F.col("_rk")) & F.col("_spread").eqNullSafe(F.col("_none")), "left")
    return joined.select(*left.columns, *[F.when(F.col("_hk").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c)
                                          for c in values])


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``, so that no extra column clashes with a name an operator uses."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, names: list[str], **values: Column) -> DataFrame:
    """The columns ``names`` of ``row``; those in ``values`` get that value, in their place or at the end."""
    kept = [values[c].alias(c) if c in values else F.col("row").getField(c).alias(c) for c in names]
    return rows.select(*kept, *[v.alias(c) for c, v in values.items() if c not in names])


def words_of(text: Column) -> Column:
    """White-space separated words as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
