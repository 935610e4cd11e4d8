"""Hard negatives in windows below every positive's score, by slot-decomposed selection.

An anchor has up to ``n_positives`` positives: the best rows of its own label. A positive of score p asks for the best
rows of other labels with scores from its lower to its upper limit (50 and 95 hundredths of p), so an anchor asks for
several overlapping windows. The upper limits in falling order split the scores into disjoint slots, and a row of
another label falls into one slot only. Every task keeps the ``k`` best rows of each anchor's slots among those it has
seen (a combiner), the tasks' rows are merged per slot, and a window's answer is the beginning of the slots from its own
on, in falling order, as far as its lower limit: each window is a suffix of the slots. Rows below the lowest lower limit
that a slot's windows have can't be asked for and are passed over.

Anchors meet all rows in blocks: a grid of anchor groups and row groups, both of bounded size, each cell one task's
matrix product. No pair of rows is stored; a cell gives at most n_positives, or k a slot, rows an anchor.

Edge cases. Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part.
Vectors are compared within their dimension only. Identical rows (id, label, vector) count once; a row with the
anchor's id is not its positive, nor its negative. Equal scores go by smaller id. Rows with a component of 2^27 or
more take no part, for products of such need not fit a long. An anchor without positives, and a positive whose window
holds nothing (always so if its score is negative), give no rows. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.llm.common import cut

#: Anchors and rows of one cell of the grid, at most about.
ANCHORS, ROWS = 4096, 32_768
LIMIT = 2 ** 27
#: Rows of a cell that are multiplied at once, which bounds a task's matrix.
STEP = 2048


def whole_rows(embeddings: DataFrame, label: Column, factor: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, v): floor(factor * component), for the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * factor) < LIMIT))
    rows = embeddings.where(F.col(id_col).isNotNull() & label.isNotNull() & (F.size(vec_col) > 0) & sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.transform(x, lambda c: F.floor(c * factor)).alias("v")).distinct()


def _points(column: pd.Series) -> np.ndarray:
    """Vectors as whole numbers in doubles, or in Python's integers where products could pass 2^52."""
    x = np.array(column.tolist(), np.int64)
    return x.astype(np.float64) if float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < 2 ** 52 else x.astype(object)


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``score``, the columns of its k best finite entries (ties: smaller id)."""
    for i, row in enumerate(score):
        on = np.flatnonzero(row > -np.inf)
        if len(on) > k:
            least = np.partition(row[on], len(on) - k)[len(on) - k]
            on = on[row[on] >= least]
        if len(on):
            yield i, on[np.lexsort((ids[on], -row[on].astype(np.float64)))][:k] if row.dtype != object else np.array(sorted(on, key=lambda j: (-row[j], ids[j]))[:k])


class Slots:
    """An anchor's upper limits in falling order, each with its lower limit."""

    def __init__(self, positives: np.ndarray, low: int, high: int):
        p = np.sort(positives[positives >= 0])[::-1]
        self.upper = np.array([high * int(x) // 100 for x in p], np.int64)
        # slot j is asked by the windows of positives 0..j; the last of them reaches lowest
        self.lower = np.array([-(-low * int(x) // 100) for x in p], np.int64)

    def of(self, score: np.ndarray) -> np.ndarray:
        """The slot of each score: the last upper limit that is not below it; -1 if none is, or no window reaches down to it."""
        j = len(self.upper) - np.searchsorted(self.upper[::-1], score, side="left") - 1
        return np.where((j >= 0) & (score >= self.lower[np.maximum(j, 0)]), j, -1) if len(self.upper) else np.full(len(score), -1)


def _grid(anchors: DataFrame, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with the cells (dim, i, j) that they belong to: every anchor meets every row of its dimension in one cell."""
    spark = rows.sparkSession
    n_anchors, n_rows = anchors.count(), rows.count()
    across = max(1, -(-n_anchors // ANCHORS))
    down = max(1, -(-n_rows // ROWS), min(n_rows, -(-4 * spark.sparkContext.defaultParallelism // across)))  # enough cells for all cores
    own = lambda n: F.pmod(F.xxhash64("id", "label", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("v").alias("dim")
    left = anchors.select(dim, own(across).alias("i"), *columns, every(down).alias("j"))
    right = rows.select(dim, own(down).alias("j"), F.col("id").alias("r_id"), F.col("label").alias("r_label"), F.col("v").alias("r_v"), every(across).alias("i"))
    return left, right


def _scores(a: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the cell's rows: inner products (anchors x rows), the rows' ids and labels."""
    x, y = _points(a["v"]), _points(r["r_v"])
    if x.dtype != y.dtype or (x.dtype != object and float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] >= 2 ** 52):
        x, y = (t if t.dtype == object else t.astype(np.int64).astype(object) for t in (x, y))
    ids, labels = r["r_id"].to_numpy(np.int64), r["r_label"].to_numpy(np.int64)
    for b in range(0, len(r), STEP):
        yield x @ y[b:b + STEP].T, ids[b:b + STEP], labels[b:b + STEP]


HITS = "key long, anchor_id long, slot int, id long, score long"


def _hits(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(parts, columns=["key", "anchor_id", "slot", "id", "score"])


def _merged(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def positives(anchors: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(key, anchor_id, id, score, rank): each anchor's ``n`` best other rows of its label."""
    def run(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(a) or not len(r):
            return _hits(out)
        keys, own, label = (a[c].to_numpy(np.int64) for c in ("key", "id", "label"))
        for score, ids, labels in _scores(a, r):
            score = np.where((label[:, None] == labels) & (own[:, None] != ids), score, -np.inf)
            out += [(keys[i], own[i], 0, ids[j], int(score[i, j])) for i, best in best_rows(score, ids, n) for j in best]
        return _merge_cell(_hits(out), n)

    left, right = _grid(anchors, rows, ["key", "id", "label", "v"])
    cells = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInPandas(run, HITS)
    return _merged(cells, ["key", "anchor_id"], n).drop("slot")


def _merge_cell(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each anchor's slot in a cell, merged from its parts."""
    hits = hits.sort_values(["key", "anchor_id", "slot", "score", "id"], ascending=[True, True, True, False, True])
    return hits[hits.groupby(["key", "anchor_id", "slot"]).cumcount() < k]


def slot_tops(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(key, anchor_id, slot, id, score, rank): the ``k`` best rows of other labels in every slot of each anchor.

    ``anchors``: (key, id, label, v, scores), the scores of the anchor's positives.
    """
    def run(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(a) or not len(r):
            return _hits(out)
        keys, own, label = (a[c].to_numpy(np.int64) for c in ("key", "id", "label"))
        slots = [Slots(np.array(p, np.int64), low, high) for p in a["scores"]]
        for score, ids, labels in _scores(a, r):
            for i, s in enumerate(slots):
                on = np.flatnonzero((labels != label[i]) & (ids != own[i]))
                row = score[i, on].astype(np.int64)
                slot = s.of(row)
                for j in np.unique(slot[slot >= 0]).tolist():
                    some = np.flatnonzero(slot == j)
                    best = some[np.lexsort((ids[on[some]], -row[some]))[:k]]
                    out += [(keys[i], own[i], j, ids[on[x]], int(row[x])) for x in best]
        return _merge_cell(_hits(out), k)

    left, right = _grid(anchors, rows, ["key", "id", "label", "v", "scores"])
    cells = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInPandas(run, HITS)
    return _merged(cells, ["key", "anchor_id", "slot"], k)


def mine(embeddings: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, k: int = 3, low: int = 50, high: int = 95,
         factor: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on a column named id, ``label`` an expression over the columns of ``embeddings``.
    """
    rows = cut(whole_rows(embeddings, label, factor, id_col, vec_col), "hn-rows")
    anchors = rows.where(is_anchor).withColumn("key", F.xxhash64("id", "label", "v"))
    best = cut(positives(anchors, rows, n_positives), "hn-positives")
    scores = best.groupBy("key", "anchor_id").agg(F.collect_list("score").alias("scores"))  # n_positives at most
    asked = cut(anchors.join(scores.withColumnRenamed("anchor_id", "id"), ["key", "id"]), "hn-anchors")
    tops = slot_tops(asked, rows, k, low, high)
    # a few rows an anchor: k a slot, in falling order of slots and scores, which is the order of all scores
    slots = tops.groupBy("key", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("tops"))
    place = F.row_number().over(W.partitionBy("key", "anchor_id").orderBy(F.col("score").desc(), "id")) - 1
    windows = best.withColumn("place", place).join(slots, ["key", "anchor_id"])
    # a suffix of the slots: from the first slot whose upper limit this positive's window has
    suffix = F.filter("tops", lambda t: (t["score"] * 100 <= F.col("score") * high) & (t["slot"] >= F.col("place")))
    inside = F.filter(F.slice(suffix, 1, k), lambda t: t["score"] * 100 >= F.col("score") * low)
    found = windows.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(inside).alias("at", "t"))
    return found.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("negative_id"),
                        "positive_score", F.col("t.score").alias("negative_score"))


#: The same by brute force in DuckDB.
SQL = """
WITH e AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
