"""Landed article files: multi-file CSV scan with per-header union (S3/U1),
and the sinks that write article tables (K1-K3).

The reference globs ``*.csv``, reads each file with its own header and
concatenates by column name. One Spark directory read would apply the first
file's header to all files, so files are grouped by header and each group is
one scan; groups are unioned by name with missing columns as null.
Row order (file order, then line order) is kept as ``_order`` for keep-first
semantics and renumbering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.operators.ingest import BROADCAST_MAX_BYTES
from framelens.schema import PANDAS_NA_TOKENS

_POS_BITS = 32  # rows per file < 2**32; files < 2**21 keeps _order < 2**53

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> list[str]:
    """File paths under ``root`` matching ``pattern``, via the binaryFile
    source with the content column pruned (no file bodies are read)."""
    rows = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(root).select("path").collect())
    return sorted(r.path for r in rows)


def sniff_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.options(**CSV_OPTIONS).csv(path).columns)


def na_normalise(df: DataFrame, cols: list[str]) -> DataFrame:
    """pandas read_csv missing-value tokens -> null (string columns)."""
    return df.select(*[
        (F.when(F.col(c).isin(PANDAS_NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
         if c in cols else F.col(c)) for c in df.columns])


def read_landed_csv(spark: SparkSession, root: str, pattern: str = "*.csv",
                    headers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Union of all CSV files under ``root`` by column name.

    Adds ``_file`` (path), ``_file_idx`` (rank of the path) and ``_order``
    (``_file_idx * 2**32 + line position``). ``headers`` may map path ->
    columns to skip sniffing (one small job per file otherwise).
    """
    files = list_files(spark, root, pattern)
    if not files:
        raise FileNotFoundError(f"no {pattern} files under {root}")
    file_idx = {p: i for i, p in enumerate(files)}
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in files:
        h = headers[p] if headers and p in headers else sniff_header(spark, p)
        groups.setdefault(h, []).append(p)
    idx_df = spark.createDataFrame([(p, i) for p, i in file_idx.items()], "_file string, _file_idx long")
    parts = []
    for cols, paths in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])
        g = (spark.read.options(**CSV_OPTIONS).schema(schema).csv(paths)
             .select(*cols, F.col("_metadata.file_path").alias("_file"),
                     F.monotonically_increasing_id().alias("_mid")))
        parts.append(na_normalise(g, list(cols)))
    allc = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # line position = id minus the file's first id (files are read whole and
    # in sequence inside a partition, so a file's ids are contiguous)
    first = allc.groupBy("_file").agg(F.min("_mid").alias("_mid0"))
    # both have a row per file, so the file list bounds their size
    few = sum(len(p.encode()) + 64 for p in files) <= BROADCAST_MAX_BYTES
    hint = F.broadcast if few else (lambda df: df)
    out = (allc.join(hint(first), "_file").join(hint(idx_df), "_file")
           .withColumn("_order", F.col("_file_idx") * (1 << _POS_BITS) + (F.col("_mid") - F.col("_mid0")))
           .drop("_mid", "_mid0"))
    return out


def write_csv(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """Overwrite one CSV table (empty input writes nothing, like the reference)."""
    if df.isEmpty():
        return
    if order_by:
        df = df.orderBy(order_by)
    (df.write.mode("overwrite")
     .options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
     .csv(path))
