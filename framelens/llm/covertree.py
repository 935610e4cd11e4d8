"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells by their nearest pivot (pivots: a bounded sample), cells to blocks of bounded size by a hash,
and every block gets a cover tree: a node's children have centres farther apart than half its radius, and every
point lies within that of its child's centre. Queries get trees of their own in the same way. For a query node
with centre q and radius r and a data node with centre c and radius s, no pair scores above

    <q, c> + r |c| + s |q| + r s

so the node pair is pruned when that lies below the worst kth score among the node's queries. Blocks are pruned
by the same bound first, in the join: every query block searches its most promising data block, and only the
data blocks whose bound reaches the worst kth score found there are searched in a second pass. Bounds prune
strictly below, so ties survive; the result is exact whatever the pivots.

Edge cases. Vectors that are null or hold null or non-finite components take no part, nor do null ids. Repeated
rows (same id and vector) count once. Vectors are compared within their dimension only. A query's own id is no
candidate. Fewer than k candidates: all. No queries, no candidates or an empty table: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.llm.common import cut

DATA_BLOCK, QUERY_BLOCK, LEAF, PIVOTS = 2048, 256, 24, 64
#: Block pairs per task, which also bounds a worker's Arrow batch.
PAIRS = 64
#: Parts into which the data blocks of a dimension are dealt when they meet the query blocks.
SHARES = 32
BLOCKS = "dim long, cell long, part long, block long, n long, centre array<double>, radius double, tree binary"


class CoverTree:
    """Points reordered so that every node covers a range of them; children follow their parent's levels."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        centre, radius, lo, hi, kids = [], [], [], [], []
        order = np.zeros(0, np.int64)
        parts = [(np.arange(len(ids)), -1)]
        while parts:  # depth first, so a node's points stay together
            own, parent = parts.pop()
            node = len(centre)
            if parent >= 0:
                kids[parent].append(node)
            far = np.sqrt(((points[own] - points[own[0]]) ** 2).sum(axis=1))
            centre.append(int(own[0]))
            radius.append(float(far.max()))
            kids.append([])
            lo.append(own)
            if radius[-1] == 0 or len(own) <= LEAF:
                continue
            rest, scale = own, radius[-1] / 2
            while len(rest):
                near = ((points[rest] - points[rest[0]]) ** 2).sum(axis=1) <= scale * scale
                parts.append((rest[near], node))
                rest = rest[~near]
        # children were pushed after their parent and popped in turn: leaves in node order give the point order
        leaves = [k for k in range(len(kids)) if not kids[k]]
        order = np.concatenate([lo[k] for k in leaves]) if leaves else order
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(order))
        self.lo = np.array([place[x].min() for x in lo])
        self.hi = np.array([place[x].max() + 1 for x in lo])
        self.ids, self.points = ids[order], points[order]
        self.centre = points[centre].astype(np.float64)
        self.length = np.sqrt((self.centre ** 2).sum(axis=1))
        self.radius = np.array(radius) * (1 + 1e-9)
        self.kids = [np.array(k, np.int64) for k in kids]


class Search:
    """The k best of a data tree for every query of a query tree."""

    def __init__(self, queries: CoverTree, data: CoverTree, k: int, least: float):
        self.q, self.d, self.k = queries, data, k
        n = len(queries.ids)
        big = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0)) * queries.points.shape[1]
        self.exact = np.float64 if big < 2 ** 52 else object  # whole numbers of any size stay whole
        self.qp, self.dp = queries.points.astype(self.exact), data.points.astype(self.exact)
        self.score = np.full((n, k), -np.inf, self.exact)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.least = least

    def bound(self, node: int, nodes: np.ndarray) -> np.ndarray:
        q, r, size = self.q.centre[node], self.q.radius[node], self.q.length[node]
        c, s = self.d.centre[nodes], self.d.radius[nodes]
        b = c @ q + r * self.d.length[nodes] + s * size + r * s
        return b + 1e-9 * np.abs(b) + 1e-6

    def worst(self, node: int) -> float:
        """Below this, nothing matters to any query of the node."""
        return max(self.least, float(self.score[self.q.lo[node]:self.q.hi[node], -1].min()))

    def compare(self, node: int, nodes: np.ndarray) -> None:
        at = np.concatenate([np.arange(self.d.lo[x], self.d.hi[x]) for x in nodes.tolist()])
        ids = self.d.ids[at]
        rows = slice(self.q.lo[node], self.q.hi[node])
        new = self.qp[rows] @ self.dp[at].T
        for i, row in zip(range(rows.start, rows.stop), new, strict=True):
            on = np.flatnonzero((row >= max(self.least, self.score[i, -1])) & (ids != self.q.ids[i]))
            if len(on):
                s = np.concatenate([self.score[i], row[on]])
                x = np.concatenate([self.id[i], ids[on]])
                best = np.lexsort((x, -s))[:self.k] if self.exact is np.float64 else np.array(sorted(range(len(s)), key=lambda j: (-s[j], x[j])))[:self.k]
                self.score[i], self.id[i] = s[best], x[best]

    def run(self) -> Iterator[tuple[int, int, int]]:
        stack = [(0, np.zeros(1, np.int64))]
        while stack:
            node, nodes = stack.pop()
            while len(nodes):
                bound = self.bound(node, nodes)
                order = np.argsort(-bound)
                nodes = nodes[order[bound[order] >= self.worst(node)]]
                inner = np.array([len(self.d.kids[x]) > 0 for x in nodes.tolist()], bool)
                if len(self.q.kids[node]):
                    if len(nodes):
                        below = [self.d.kids[x] if e else np.array([x]) for x, e in zip(nodes.tolist(), inner.tolist(), strict=True)]
                        stack += [(c, np.concatenate(below)) for c in self.q.kids[node].tolist()]
                    break
                leaves = nodes[~inner]
                for a in range(0, len(leaves), 16):
                    some = leaves[a:a + 16]
                    some = some[self.bound(node, some) >= self.worst(node)]
                    if len(some):
                        self.compare(node, some)
                nodes = np.concatenate([self.d.kids[x] for x in nodes[inner].tolist()]) if inner.any() else leaves[:0]
        for i, q in enumerate(self.q.ids.tolist()):
            for s, x in zip(self.score[i].tolist(), self.id[i].tolist(), strict=True):
                if s != -np.inf:
                    yield q, x, int(s)


def whole_vectors(embeddings: DataFrame, id_col: str, vec_col: str, factor: int) -> DataFrame:
    """(id, v): floor(factor * component), for the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col(id_col).isNotNull() & sound & (F.size(vec_col) > 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * factor)).alias("v")).distinct()


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id", kind="stable")
    points = np.array(frame["v"].tolist(), np.int64)
    small = next((t for t in (np.int16, np.int32) if np.abs(points).max() < np.iinfo(t).max), np.int64)
    tree = CoverTree(frame["id"].to_numpy(np.int64), points.astype(np.float64) if small is not np.int64 else points)
    tree.points = tree.points.astype(small)
    first = frame.iloc[0]
    return pd.DataFrame({"dim": [points.shape[1]], "cell": [first["cell"]], "part": [first["part"]], "block": [0], "n": [len(points)],
                         "centre": [tree.centre[0]], "radius": [tree.radius[0]], "tree": [pickle.dumps(tree)]})


def _blocks(dealt: DataFrame, size: int, name: str) -> DataFrame:
    """A stored row per block of about ``size`` vectors, its tree inside."""
    counts = cut(dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")), f"{name}-cells")
    parted = dealt.join(counts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
    grown = parted.select("dim", "cell", "part", "id", "v").groupBy("dim", "cell", "part").applyInPandas(_grow, BLOCKS)
    return cut(grown.withColumn("block", F.xxhash64("dim", "cell", "part")), name)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of every query row.

    ``is_query`` is a condition on a column named id.
    """
    vectors = cut(whole_vectors(embeddings, id_col, vec_col, factor), "vectors")
    dims = [(r.dim, r.n) for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per dimension
    pivots = {}
    for dim, n in dims:
        some = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // DATA_BLOCK))).collect()
        pivots[dim] = np.array([r.v for r in some], np.float64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim = b["v"].map(len)
            cell = pd.Series(0, b.index, dtype="int64")
            for d in dim.unique().tolist():
                p = pivots[d]
                x = np.array(b["v"][dim == d].tolist(), np.float64)
                cell[dim == d] = ((p ** 2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pd.DataFrame({"dim": dim, "cell": cell, "id": b["id"], "v": b["v"]})

    dealt = cut(vectors.mapInPandas(deal, "dim long, cell long, id long, v array<long>"), "dealt")
    data = _blocks(dealt, DATA_BLOCK, "data-blocks")
    queries = _blocks(dealt.where(is_query), QUERY_BLOCK, "query-blocks")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    side = lambda t, s, share: t.select("dim", share.alias("share"), *[F.col(c).alias(f"{s}_{c}") for c in ("block", "centre", "radius")])
    bound = (dot(F.col("q_centre"), F.col("d_centre")) + F.col("q_radius") * F.sqrt(dot(F.col("d_centre"), F.col("d_centre")))
             + F.col("d_radius") * F.sqrt(dot(F.col("q_centre"), F.col("q_centre"))) + F.col("q_radius") * F.col("d_radius"))
    # every query block goes to all shares of the data blocks, so a dimension's blocks are not met in one task
    every = side(queries, "q", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = every.join(side(data, "d", F.pmod("block", F.lit(SHARES)).cast("int")), ["dim", "share"])
    pairs = cut(met.select("q_block", "d_block", (bound + 1e-9 * F.abs(bound) + 1e-6).alias("bound")), "block-pairs")
    nearest = pairs.groupBy("q_block").agg(F.max(F.struct("bound", "d_block")).alias("top")).select("q_block", F.col("top.d_block").alias("top"))
    ranked = cut(pairs.join(nearest, "q_block").withColumn("nearest", F.col("d_block") == F.col("top")).drop("top"), "ranked-pairs")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qb, qt, dt, least in zip(b["q_block"], b["q_tree"], b["d_tree"], b["least"], strict=True):
                s = Search(pickle.loads(qt), pickle.loads(dt), k, least)
                found = list(s.run())
                floor = float(s.score[:, -1].min()) if len(s.score) else -np.inf
                yield pd.DataFrame({"q_block": qb, "query_id": [x[0] for x in found], "vec_id": [x[1] for x in found],
                                    "score": [x[2] for x in found], "least": floor})

    def searched(work: DataFrame, name: str) -> DataFrame:
        q = queries.select(F.col("block").alias("q_block"), F.col("tree").alias("q_tree"))
        d = data.select(F.col("block").alias("d_block"), F.col("tree").alias("d_tree"))
        rows = work.join(q, "q_block").join(d, "d_block").select("q_block", "q_tree", "d_tree", "least")
        parts = max(embeddings.sparkSession.sparkContext.defaultParallelism, -(-work.count() // PAIRS))
        out = rows.repartition(parts).mapInPandas(search, "q_block long, query_id long, vec_id long, score long, least double")
        return cut(out, name)

    first = searched(ranked.where("nearest").withColumn("least", F.lit(float("-inf"))), "first-hits")
    least = first.groupBy("q_block").agg(F.max("least").alias("least"))
    others = ranked.where("not nearest").join(least, "q_block", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    second = searched(others.where(F.col("bound") >= F.col("least")), "second-hits")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = first.unionByName(second).select("query_id", "vec_id", "score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by brute force in DuckDB.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 5
"""
