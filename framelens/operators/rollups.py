"""Histograms and the source x tactic pivot (the read surface's rollups).

All are hash aggregates with map-side partial aggregation, so a hot source or
label is combined before the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.schema import SERVED_NA


def histogram(df: DataFrame, key: str, out_key: str | None = None,
              na_value: str | None = None) -> DataFrame:
    """``value_counts()``: (key, n) ordered by n desc, key asc.

    ``na_value`` counts nulls under that text (served table); otherwise nulls
    are left out, as pandas does.
    """
    k = F.col(key)
    if na_value is not None:
        k = F.coalesce(k, F.lit(na_value))
    out = df.select(k.alias(out_key or key))
    if na_value is None:
        out = out.where(F.col(out_key or key).isNotNull())
    return (out.groupBy(out_key or key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(out_key or key)))


def tactics_summary(df: DataFrame) -> DataFrame:
    """Served tactic histogram: null labels count as 'N/A'."""
    return histogram(df, "tactic_label", na_value=SERVED_NA)


def source_breakdown(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Source x tactic counts, 0-filled, in long form (source, tactic_label, n).

    A pivot (one column per label, 0-filled) unpivoted back to rows: the zeros
    come from the pivot, not from a cross product. ``labels`` may pin the
    pivot values; otherwise Spark finds the distinct labels (bounded by
    ``spark.sql.pivotMaxValues``).
    """
    served = df.select(F.coalesce(F.col("source"), F.lit(SERVED_NA)).alias("source"),
                       F.coalesce(F.col("tactic_label"), F.lit(SERVED_NA)).alias("tactic_label"))
    g = served.groupBy("source")
    wide = (g.pivot("tactic_label", labels) if labels is not None else g.pivot("tactic_label")).count()
    cols = [c for c in wide.columns if c != "source"]
    wide = wide.select("source", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c)
                                   for c in cols])
    if not cols:
        return served.select("source", "tactic_label", F.lit(0).cast("long").alias("n")).limit(0)
    return (wide.unpivot("source", cols, "tactic_label", "n")
            .orderBy("source", "tactic_label"))


def source_breakdown_wide(df: DataFrame) -> DataFrame:
    """The served pivot itself: one row per source, one column per label."""
    served = df.select(F.coalesce(F.col("source"), F.lit(SERVED_NA)).alias("source"),
                       F.coalesce(F.col("tactic_label"), F.lit(SERVED_NA)).alias("tactic_label"))
    wide = served.groupBy("source").pivot("tactic_label").count().na.fill(0)
    return wide.orderBy("source")
