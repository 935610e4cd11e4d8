"""Events kept up to date as days arrive: DBSCAN over dense vectors, by loads.

``EventStore`` keeps, in versions (``sources.snapshots``):

* ``members`` (id, cls): every point and its class of equal vectors, null for
  a vector that takes no part;
* ``classes`` (cls, v): one vector a class, named by the first id seen;
* ``links`` (src, dst): classes within eps of each other;
* ``cores`` (cls, comp): core classes and their component.

A load compares its new classes with each other and with the stored ones,
never stored with stored. Points only arrive, so a core point stays one and
components only merge. What a load can change is: the new classes, classes
that got more members, and the neighbours of both. Those of them that turn
core are joined, over the links that they lie on, with the components that
the old cores already have; the connected components of this contracted graph
are the relabel table. Labels are then those of one DBSCAN over all points:
they don't depend on how the points were dealt into loads.

Work per load: new x all distances, links of the touched classes, and one
pass over ``cores`` for the relabel. Copies meet in their class only.

Defined results: an id that is stored already is ignored; of rows of one id
in a load the least vector counts; null, empty, non-finite and zero vectors
are noise (-1); vectors of different lengths are never neighbours; rows
without an id are skipped; an empty load adds an empty version.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators.components import connected_components, label_points
from framelens.operators.similarity import sound_vectors
from framelens.session import checkpoint_dir
from framelens.sources.snapshots import Snapshots

SCHEMAS = {"members": "id long, cls long", "classes": "cls long, v array<double>",
           "links": "src long, dst long", "cores": "cls long, comp long"}


#: Bytes of the vectors of one side of a block pair, and cells of one product.
BLOCK_BYTES = 64 << 20
PRODUCT_ROWS = 2048


def link_blocks(n_new: int, n_all: int, cores: int, wide: int, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """(blocks of new vectors, blocks of all): a new vector goes to as many groups as there are blocks of all, a told one to
    as many as there are of new ones."""
    most = max(1, block_bytes // (8 * max(wide, 1)))
    rows = max(1, min(most, math.ceil(math.sqrt(n_new * n_all / (4 * cores)))))
    return max(1, math.ceil(n_new / rows)), max(1, math.ceil(n_all / rows))


def dense_links(new: DataFrame, old: DataFrame, eps: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(src, dst) of the classes within cosine distance ``eps``, of which at least one is new.

    New vectors are dealt into blocks and so are all vectors; each block of new ones meets each block of all in one
    bounded group, by products of a bounded size. There are as many groups as the cores need; blocks that would come to
    more than ``block_bytes`` are cut further. So a vector travels to a number of groups that does not grow with the
    rows until blocks are that large. Groups emit only pairs within eps.
    """
    import numpy as np
    import pyarrow as pa

    size = [F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))]
    (n_new, wide_new), (n_old, wide_old) = new.agg(*size).first(), old.agg(*size).first()
    cores = new.sparkSession.sparkContext.defaultParallelism
    nq, nd = link_blocks(n_new, n_new + n_old, cores, max(wide_new, wide_old), block_bytes)

    def dealt(df: DataFrame, fresh: bool) -> DataFrame:
        return df.select(F.col("cls").alias("id"), "v", F.size("v").alias("dim"), F.lit(fresh).alias("fresh"))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    every = dealt(new, True).unionByName(dealt(old, False))
    asks = dealt(new, True).select("*", F.lit(True).alias("asks"), block(nq).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("d"))
    told = every.select("*", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), block(nd).alias("d"))

    def meet(table: pa.Table) -> pa.Table:
        ids, fresh = table["id"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False)
        side = table["asks"].to_numpy(zero_copy_only=False)
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out = [np.zeros((2, 0), np.int64)]
        for r in range(0, len(right), PRODUCT_ROWS):
            to = right[r:r + PRODUCT_ROWS]
            told = (x[to] / norm[to]).T
            for q in range(0, len(left), PRODUCT_ROWS):
                by = left[q:q + PRODUCT_ROWS]
                i, j = np.nonzero(1.0 - (x[by] / norm[by]) @ told <= eps)
                a, b = ids[by][i], ids[to][j]
                # a pair of new classes is met from both sides
                once = (a < b) | ((a != b) & ~fresh[to][j])
                out.append(np.stack([np.minimum(a, b)[once], np.maximum(a, b)[once]]))
        pairs = np.concatenate(out, axis=1)
        return pa.table({"src": pairs[0], "dst": pairs[1]})

    # as many parts as groups: the groups are few and small, but work
    met = asks.unionByName(told).repartition(min(2000, nq * nd), "dim", "q", "d")
    return met.groupBy("dim", "q", "d").applyInArrow(meet, "src long, dst long")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("v"), F.col("dst").alias("u")).unionByName(
        links.select(F.col("dst").alias("v"), F.col("src").alias("u")))


class EventStore:
    def __init__(self, spark: SparkSession, root: str, eps: float, min_samples: int):
        if not 0 < eps < 1:
            raise ValueError("eps must lie between 0 and 1")
        checkpoint_dir(spark)
        self.spark, self.eps, self.min_samples = spark, eps, min_samples
        self.tables = Snapshots(spark, root)

    def _stored(self) -> dict[str, DataFrame]:
        # one version for all tables of a load
        version = self.tables.latest()
        if not version:
            return {t: self.spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
        return {t: self.tables.read(t, version) for t in SCHEMAS}

    def load(self, points: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
        """Add points and return the new version."""
        old = self._stored()
        ids = (points.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
               .join(old["members"], "id", "left_anti"))
        vectors = sound_vectors(points, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
        vectors = vectors.where(F.exists("v", lambda x: x != 0))
        keys = [F.xxhash64("v", F.lit(s)).alias(f"k{s}") for s in (1, 2)]
        fresh = ids.join(vectors, "id", "left").select("id", "v", *keys).checkpoint()

        known = old["classes"].select("cls", *keys)
        sound = fresh.where("v is not null")
        named = sound.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.min_by("v", "id").alias("v"))
        named = named.join(known, ["k1", "k2"], "left").checkpoint()
        classes = named.where("cls is null").select(F.col("first").alias("cls"), "v")
        grown = named.select(F.coalesce("cls", "first").alias("cls"))  # new, or with more members
        members = sound.select("id", "k1", "k2").join(named.select("k1", "k2", F.coalesce("cls", "first").alias("cls")), ["k1", "k2"])
        members = members.select("id", "cls").unionByName(
            fresh.where("v is null").select("id", F.lit(None).cast("long").alias("cls"))).checkpoint()
        new_links = dense_links(classes, old["classes"], self.eps).checkpoint()

        adj = _both_ways(old["links"].unionByName(new_links))
        touched = grown.unionByName(adj.join(grown.withColumnRenamed("cls", "u"), "u", "left_semi").select(F.col("v").alias("cls"))).distinct()
        open_ = touched.join(old["cores"], "cls", "left_anti").checkpoint()
        sizes = old["members"].unionByName(members).where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
        near = (adj.join(open_.withColumnRenamed("cls", "v"), "v", "left_semi").join(sizes.withColumnRenamed("cls", "u"), "u")
                .select(F.col("v").alias("cls"), "n"))
        own = sizes.join(open_, "cls", "left_semi")
        turned = (near.unionByName(own.select("cls", "n")).groupBy("cls").agg(F.sum("n").alias("n"))
                  .where(F.col("n") >= self.min_samples).select("cls")).checkpoint()

        # links with an end that turned core, both ends core, old cores standing for their component
        place = old["cores"].unionByName(turned.select("cls", F.col("cls").alias("comp"))).checkpoint()
        joined = (adj.join(turned.withColumnRenamed("cls", "v"), "v", "left_semi")
                  .join(place.select(F.col("cls").alias("u"), F.col("comp").alias("cu")), "u"))
        relabel = connected_components(joined, "v", "cu").withColumnRenamed("comp", "to")
        cores = (place.join(relabel, F.col("comp") == F.col("vertex"), "left")
                 .select("cls", F.coalesce("to", "comp").alias("comp")))
        return self.tables.publish({"cores": cores}, {"members": members, "classes": classes, "links": new_links})

    def labels(self) -> DataFrame:
        """(id, label): the clusters of all loads, numbered by their least core id; -1 is noise."""
        now = self._stored()
        first = now["members"].where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"))
        # classes named by the least id of their members, components by that of their cores
        named = now["cores"].join(first, "cls").select("cls", "comp", F.col("first").alias("vertex"))
        least = named.groupBy("comp").agg(F.min("vertex").alias("name"))
        core = named.join(least, "comp").select("vertex", F.col("name").alias("comp"))
        adj = (_both_ways(now["links"]).join(first.toDF("v", "fv"), "v").join(first.toDF("u", "fu"), "u")
               .select(F.col("fv").alias("v"), F.col("fu").alias("u")))
        points = now["members"].select("id")
        members = now["members"].join(first, "cls").select("id", F.col("first").alias("rep"))
        return label_points(points, adj, core.checkpoint(), members)
