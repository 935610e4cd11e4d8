"""k-means over a VA-file (Weber, Schek and Blott 1998): few-bit cells first, full vectors only where these leave it open.

Every dimension is cut into 2^bits cells, between the quantiles of a bounded sample and equal widths, with the true extremes as outer borders;
a vector's approximation is its cell in each dimension, one byte. For a set of centroids, a lookup table per dimension
holds the least and the greatest part that a cell can have in the squared distance to each centroid, so that sums of
table entries enclose each distance. (The vector's own squared length is the same in all its distances and is left
out of all, which makes the intervals much narrower.) A vector whose greatest distance to one centroid is below the
least one to all others is assigned by its cells alone; for the others, and only for these, the full vector is
fetched and the centroids whose intervals reach the best one are compared exactly.

A round reads the approximations with each vector's last cluster. Sums and counts of the clusters are kept as whole
numbers and changed by the vectors that moved, so a round fetches full vectors for those still open and those that
moved, no others. Vectors are stored in buckets by their key, and fetched by a join that moves only the keys asked for.
The first round and the last assignment, whose exact sums and distances need every vector, scan them once each.

Edge cases. Vectors that are null, of another number of components, or with null or non-finite components take no
part; nor do those with a component of 2^27 or more, whose distances don't fit a long. Sums of distances that don't
fit one are null. Repeated rows are vectors of their own. A null id has no hash, so it comes last among the starts,
and is clustered. Fewer vectors than centroids: one centroid for each. Empty clusters keep their centroid. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import cut, shared_path

#: Vectors per stored bucket, at most about.
BUCKET_ROWS = 500_000
#: Rows that are compared with all centroids at once, which bounds a worker's arrays.
STEP = 2048
LIMIT = 2 ** 27


def whole_vectors(embeddings: DataFrame, dim: int, id_col: str, vec_col: str, factor: int) -> DataFrame:
    """(id, v): floor(factor * component), for the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * factor) < LIMIT))
    rows = embeddings.where((F.size(vec_col) == dim) & sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * factor).cast("int")).alias("v"))


@dataclass
class Cells:
    """Borders of the cells of each dimension: cell j holds the values from borders[j] to borders[j + 1] - 1."""

    borders: list[np.ndarray]

    @classmethod
    def of(cls, vectors: DataFrame, dim: int, bits: int, sample_rows: int) -> Cells:
        """Borders at the quantiles of about ``sample_rows`` vectors and at the extremes of all."""
        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, low, high = 0, np.full(dim, LIMIT), np.full(dim, -LIMIT)
            for b in batches:
                x = _matrix(b["v"], dim)
                n += len(x)
                low, high = np.minimum(low, x.min(axis=0, initial=LIMIT)), np.maximum(high, x.max(axis=0, initial=-LIMIT))
            yield pd.DataFrame({"d": np.arange(dim), "low": low, "high": high, "n": n})

        found = (vectors.select("v").mapInPandas(ends, "d int, low long, high long, n long").groupBy("d")
                 .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("d").collect())  # a row a dimension
        drawn = min(1 << 30, -(-(1 << 30) * sample_rows // max(found[0].n, 1)))
        some = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < drawn).select("v").limit(4 * sample_rows).collect()
        x = np.array([r.v for r in some], np.int64).reshape(-1, dim)
        borders = []
        for d, low, high, _ in found:
            share = np.arange(1, 2 ** bits) / 2 ** bits
            even = low + share * (high + 1 - low)
            # between equal counts, whose outer cells are wide, and equal widths, which waste cells where few values are
            inner = (np.quantile(x[:, d], share, method="lower") + even) / 2 if len(x) else even
            borders.append(np.unique(np.concatenate(([low], np.clip(np.rint(inner), low, high), [high + 1]))).astype(np.int64))
        return cls(borders)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, d], side="right") - 1 for d, b in enumerate(self.borders)], axis=1).astype(np.uint8)


@dataclass
class Bounds:
    """Lookup tables of what each cell can add to the squared distance to each centroid, less the vector's own square."""

    cells: Cells
    centroids: np.ndarray
    least: list[np.ndarray] = field(default_factory=list)
    most: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for d, b in enumerate(self.cells.borders):
            low, high, c = b[:-1, None], b[1:, None] - 1, self.centroids[None, :, d]
            ends = c * c - 2 * c * low, c * c - 2 * c * high  # (x - c)^2 - x^2 falls or rises all along a cell
            self.least.append(np.minimum(*ends))
            self.most.append(np.maximum(*ends))

    def near(self, cells: np.ndarray) -> np.ndarray:
        """Whether each centroid can be nearest to each vector: its interval begins no later than any ends."""
        least = np.zeros((len(cells), len(self.centroids)), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            least += self.least[d][cells[:, d]]
            most += self.most[d][cells[:, d]]
        return least <= most.min(axis=1, keepdims=True)

    def exact(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The nearest of the centroids that are ``near`` (ties: the smaller number)."""
        far = np.iinfo(np.int64).max
        d = np.full(near.shape, far)
        rows, cols = np.nonzero(near)
        for a in range(0, len(rows), STEP * 8):
            r, c = rows[a:a + STEP * 8], cols[a:a + STEP * 8]
            d[r, c] = ((x[r] - self.centroids[c]) ** 2).sum(axis=1)
        return d.argmin(axis=1)


class Sums:
    """Whole-number sums and counts of clusters, from the vectors that enter and leave them."""

    def __init__(self, k: int, dim: int):
        self.sum, self.n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)

    def add(self, x: np.ndarray, to: np.ndarray, sign: int) -> None:
        on = to >= 0
        np.add.at(self.sum, to[on], sign * x[on])
        np.add.at(self.n, to[on], sign)

    def merge(self, rows: pd.DataFrame) -> None:
        np.add.at(self.sum, rows["cluster"].to_numpy(np.int64), _matrix(rows["total"], self.sum.shape[1]))
        np.add.at(self.n, rows["cluster"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))

    def rows(self) -> pd.DataFrame:
        on = np.flatnonzero(self.n.astype(bool) | self.sum.any(axis=1))
        nothing = pd.Series([None] * len(on), dtype=object)
        return pd.DataFrame({"key": nothing, "cells": nothing, "cluster": on, "total": pd.Series(list(self.sum[on]), dtype=object), "n": self.n[on]})


PARTS = "cluster int, total array<long>, n long"
MOVES = "key long, cells binary, cluster int, total array<long>, n long"


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(-1, dim)


def _cells(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, dim)


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), STEP):
            yield b.iloc[a:a + STEP]


def _placed(x: np.ndarray, cells: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The nearest centroid of each vector when the full vectors are at hand: they're used where the cells leave it open."""
    near = bounds.near(cells)
    out = near.argmax(axis=1)
    open_ = near.sum(axis=1) > 1
    if open_.any():
        out[open_] = bounds.exact(x[open_], near[open_])
    return out


def first_round(stored: DataFrame, bounds: Bounds, dim: int) -> DataFrame:
    """Every vector assigned and summed, in one scan."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums(len(bounds.centroids), dim)
        for b in _steps(batches):
            x = _matrix(b["v"], dim)
            to = _placed(x, _cells(b["cells"], dim), bounds)
            sums.add(x, to, 1)
            yield pd.DataFrame({"key": b["key"], "cells": b["cells"], "cluster": to, "total": None, "n": None})
        yield sums.rows()

    return stored.select("key", "cells", "v").mapInPandas(run, MOVES)


def by_cells(state: DataFrame, bounds: Bounds, dim: int) -> DataFrame:
    """(key, cells, old, cluster, fetch): clusters by the cells alone; ``fetch`` where the full vector is needed, ``cluster`` is null where still open."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _steps(batches):
            near = bounds.near(_cells(b["cells"], dim))
            sure = near.sum(axis=1) == 1
            to = near.argmax(axis=1)
            yield pd.DataFrame({"key": b["key"], "cells": b["cells"], "old": b["cluster"], "cluster": pd.Series(to, b.index, "Int32").where(sure),
                                "fetch": ~sure | (to != b["cluster"].to_numpy())})

    return state.mapInPandas(run, "key long, cells binary, old int, cluster int, fetch boolean")


def fetched(asked: DataFrame, stored: DataFrame, bounds: Bounds, dim: int) -> DataFrame:
    """The rows asked for, settled by their full vectors, and what the moved ones change in the sums."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums(len(bounds.centroids), dim)
        for b in _steps(batches):
            x, old = _matrix(b["v"], dim), b["old"].to_numpy(np.int64)
            to = _placed(x, _cells(b["cells"], dim), bounds)
            moved = to != old
            sums.add(x[moved], to[moved], 1)
            sums.add(x[moved], old[moved], -1)
            yield pd.DataFrame({"key": b["key"], "cells": b["cells"], "cluster": to, "total": None, "n": None})
        yield sums.rows()

    return asked.select("key", "cells", "old").join(stored.select("key", "v"), "key").select("cells", "old", "key", "v").mapInPandas(run, MOVES)


def _add(moves: DataFrame, total: np.ndarray, n: np.ndarray) -> None:
    """Add the sums that the tasks gave: combined where they are read, then per cluster, of which a row each comes to the driver."""
    k, dim = total.shape

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums(k, dim)
        for b in batches:
            sums.merge(b)
        yield sums.rows()[["cluster", "total", "n"]]

    def per_cluster(part: pd.DataFrame) -> pd.DataFrame:
        sums = Sums(k, dim)
        sums.merge(part)
        c = int(part["cluster"].iloc[0])
        return pd.DataFrame({"cluster": [c], "total": [sums.sum[c]], "n": [sums.n[c]]})

    parts = moves.where(F.col("total").isNotNull()).select("cluster", "total", "n").mapInPandas(combine, PARTS)
    for r in parts.groupBy("cluster").applyInPandas(per_cluster, PARTS).collect():
        total[r.cluster] += np.array(r.total, np.int64)
        n[r.cluster] += r.n


def starts(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The ``k`` vectors that come first by ``order``, as centroids."""
    return np.array([r.v for r in vectors.orderBy(order.asc_nulls_last(), "id", "v").limit(k).collect()], np.int64)


@dataclass
class Clustering:
    """``rows``: (id, cluster, distance), stored; ``centroids``: whole numbers; ``fetched``: full vectors read per round beyond the scans."""

    rows: DataFrame
    centroids: np.ndarray
    fetched: list[int]


def k_means(embeddings: DataFrame, k: int, rounds: int, order: Column, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding",
            factor: int = 256, bits: int = 6, sample_rows: int = 4096) -> Clustering:
    """Lloyd's rounds with whole-number centroids, floor(sum / count), from the first ``k`` vectors by ``order`` (on column id)."""
    spark = embeddings.sparkSession
    # keys are dealt once, by the write
    vectors = cut(whole_vectors(embeddings, dim, id_col, vec_col, factor).withColumn("key", F.monotonically_increasing_id()), "va-vectors")
    centroids = starts(vectors, k, order)
    if not len(centroids):
        return Clustering(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, [])
    cells = Cells.of(vectors, dim, bits, sample_rows)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cells=[row.tobytes() for row in cells.encode(_matrix(b["v"], dim))])

    keyed = vectors.mapInPandas(encode, "id long, v array<int>, key long, cells binary")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // BUCKET_ROWS))
    name, path = "va_" + shared_path(spark, "va")[-12:], shared_path(spark, "va-buckets")
    keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    stored = spark.table(name)
    total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    state, reads = None, []
    for r in range(rounds):
        bounds = Bounds(cells, centroids)
        if state is None:
            moves = cut(first_round(stored, bounds, dim), "va-first")
            state = moves.where("key is not null").select("key", "cells", "cluster")
        else:
            sure = cut(by_cells(state, bounds, dim), f"va-cells-{r}")
            asked = sure.where("fetch")
            reads.append(asked.count())
            moves = cut(fetched(asked, stored, bounds, dim), f"va-fetched-{r}")
            state = sure.where("not fetch").select("key", "cells", "cluster").unionByName(
                moves.where("key is not null").select("key", "cells", "cluster"))
        _add(moves, total, n)
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
    bounds = Bounds(cells, centroids)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _steps(batches):
            x = _matrix(b["v"], dim)
            to = _placed(x, _cells(b["cells"], dim), bounds)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "cluster": to, "distance": ((x - centroids[to]) ** 2).sum(axis=1)})

    rows = cut(spark.read.schema(stored.schema).parquet(path).select("id", "cells", "v").mapInPandas(last, "id long, cluster int, distance long"), "va-last")
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files are the shared folder's
    return Clustering(rows, centroids, reads)


def digest(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = found.rows.sparkSession
    hashes = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(found.centroids)]
    sums = found.rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    every = found.rows.agg(F.try_sum("distance").alias("inertia"))
    per = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string").join(sums, "cluster").crossJoin(every)  # a row per centroid and one row
    return found.rows.join(F.broadcast(per), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    """The same by brute force in DuckDB, a pair of tables per round."""
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT v.row, v.vec_id, v.v, c.n AS cluster, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
  FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.n) = 1)"""  # noqa: E731
    move = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY d) AS v FROM
  (SELECT cluster, d, CAST(floor(CAST(sum(v[d]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{r}, range(1, 65) t(d) GROUP BY cluster, d) GROUP BY cluster) m ON m.cluster = c.n)"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, vec_id, v) - 1 AS n, v FROM v QUALIFY n < {k}),
{steps},
{near(rounds)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = a.cluster
"""


SQL = _sql(40, 5)
