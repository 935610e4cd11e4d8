"""Batches sent in bounded waves, within a token budget, with a stored ledger.

``Waves(spark, root)`` keeps two tables (``sources.snapshots``): ``plan``, the
batches with their payloads and token counts, sorted by number so that a wave
reads its own row groups, and ``runs``, one row for every batch sent.

``run_day`` sends what has no answer yet, in batch order:

* the tokens that a key will have spent at each batch are a distributed prefix
  sum (``running_total``), so the batch at which a key's budget ends is known
  before the first call, and nothing from it on is sent;
* the rest goes out in waves of ``wave_batches`` batches. A wave's answers are
  published before the next one starts. A wave with a spent quota is the last:
  at most the rest of that wave is called after the quota error;
* the batch at which the day ended has a row with status QUOTA_EXHAUSTED, so
  ``inference.quota_cut`` of a day's runs gives the analysed system's result.

A later day, or a restart after a crash, goes on from the ledger: no batch whose
answer (or third failure) was published is sent again. Calls of a wave that
was lost before it was published are repeated, as are those of a lost task.

Waves are the driver's only loop; it sees batch numbers and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelens.operators.inference import QUOTA, RUN_SCHEMA, run_batches
from framelens.session import checkpoint_dir, ship_package
from framelens.sources.snapshots import Snapshots

#: FIXED VALUES: tokens that the analysed service lets a key use a day, and the answer that it allows a batch.
TOKENS_PER_DAY, ANSWER_TOKENS = 200_000, 2_000
#: Characters taken for one token where no tokeniser is at hand.
CHARS_PER_TOKEN = 4
RUNS = RUN_SCHEMA + ", day int, tokens long, spent long"


def running_total(df: DataFrame, order: str, value: str, out: str, by: Sequence[str], block: int = 4096, top: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``by`` up to and with this ``order``.

    ``order`` is a whole number from 0, unique within ``by``. No window holds more than ``block`` rows: totals of
    blocks of consecutive numbers get running totals in the same way, one level for each factor of ``block`` in the
    largest number.
    """
    top = (df.agg(F.max(order)).first()[0] or 0) if top is None else top
    if top < block:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(order)))
    blk, own = f"{out}_b", f"{out}_s"
    cut = df.withColumn(blk, F.floor(F.col(order) / block).cast("long"))
    totals = cut.groupBy(*by, blk).agg(F.sum(value).alias(own))
    above = running_total(totals, blk, own, f"{out}_r", by, block, top // block)
    above = above.select(*by, blk, (F.col(f"{out}_r") - F.col(own)).alias(own))
    inside = F.sum(value).over(Window.partitionBy(*by, blk).orderBy(order))
    return cut.withColumn(out, inside).join(above, [*by, blk]).withColumn(out, F.col(out) + F.col(own)).drop(blk, own)


class Waves:
    def __init__(self, spark: SparkSession, root: str):
        checkpoint_dir(spark)
        self.spark, self.tables = spark, Snapshots(spark, root)

    def plan(self, batches: DataFrame, answer_tokens: int = 0) -> None:
        """Store the batches of ``inference.batch_items`` with the tokens that each will cost. A stored plan stays."""
        if self.tables.latest():
            return
        tokens = (F.ceil(F.col("text_chars") / CHARS_PER_TOKEN) + answer_tokens).cast("long")
        cost = batches.select("batch_index", "key_route", "payload", tokens.alias("tokens"))
        sorted_ = cost.repartitionByRange("batch_index").sortWithinPartitions("batch_index")
        self.tables.publish({"plan": sorted_, "runs": self.spark.createDataFrame([], RUNS)})

    def runs(self) -> DataFrame:
        """The ledger: a row for every batch sent, and for the batch at which a day's budget ended."""
        return self.tables.read("runs")

    def run_day(self, models: Callable[[str, int], str] | Sequence[Callable[[str, int], str]],
                budget: int | None = None, wave_batches: int | None = None) -> DataFrame:
        """Send the open batches until they, a quota or the budget (tokens a key) end; the day's rows of the ledger."""
        ship_package(self.spark)
        done = self.runs()
        day = (done.agg(F.max("day")).first()[0] or 0) + 1
        size = wave_batches or 64 * self.spark.sparkContext.defaultParallelism
        open_ = self.tables.read("plan").join(done.where(F.col("status") != QUOTA).select("batch_index"), "batch_index", "left_anti")
        costs = running_total(open_.select("batch_index", "key_route", "tokens"), "batch_index", "tokens", "spent", ["key_route"]).checkpoint()
        over = F.when(F.col("spent") > F.lit(budget).cast("long"), F.col("batch_index"))
        low, high, stop = costs.agg(F.min("batch_index"), F.max("batch_index"), F.min(over)).first()
        end = high if stop is None else stop - 1
        quota = False
        at = low
        while low is not None and at <= end and not quota:
            wave = F.col("batch_index").between(at, min(at + size - 1, end))
            sent = run_batches(open_.where(wave), models).join(costs.where(wave).select("batch_index", "tokens", "spent"), "batch_index")
            self._append(sent.withColumn("day", F.lit(day)))
            quota = not self.runs().where(wave & (F.col("day") == day) & (F.col("status") == QUOTA)).isEmpty()
            at += size
        if stop is not None and not quota:
            ended = costs.where(F.col("batch_index") == stop).select(
                "*", F.lit(0).alias("attempts"), F.lit(QUOTA).alias("status"), F.lit(None).cast("string").alias("answer"),
                F.lit("the day's budget of tokens is spent").alias("error"), F.lit(day).alias("day"))
            self._append(ended)
        self.tables.publish({"runs": self.runs()})  # the waves' folders in one
        return self.runs().where(F.col("day") == day)

    def _append(self, rows: DataFrame) -> None:
        names = self.spark.createDataFrame([], RUNS).columns
        self.tables.publish(append={"runs": rows.select(*names)})


def until_stop(runs: DataFrame) -> DataFrame:
    """A day's rows up to and with the batch that ended it. What the last wave sent behind it depends on its size."""
    last = runs.where(F.col("status") == QUOTA).agg(F.min("batch_index")).first()[0]
    return runs if last is None else runs.where(F.col("batch_index") <= last)
