"""Connected components and DBSCAN over an edge DataFrame.

Connected components: the large-star / small-star alternation of Kiveris,
Lattanzi, Mirrokni, Rastogi and Vassilvitskii ("Connected Components in
MapReduce and Beyond", SoCC 2014), O(log^2 n) rounds in the worst case and
about log n in practice, also on long chains (plain min-label propagation
needs ~diameter rounds). The edge set is kept undirected as (hi, lo), hi > lo:

* large-star: every node u links each strictly larger neighbour to
  m(u) = min(u, neighbours);
* small-star: every node u links itself and each smaller neighbour to the
  least of them;

until a round leaves the edge set unchanged: each component is then a star
around its least vertex. Each step is a min aggregate (map-side partial
aggregation) and an equi-join on the node; AQE splits a hub's skewed join
partition. Every round's edges are cut from the lineage with a reliable
``checkpoint()`` in the shared checkpoint folder, so a lost executor costs
one round. Only vertices that lie on an edge take part; the edge-set size
and the changed-edge count are the only values that reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.operators.indexing import dense_index
from framelens.session import checkpoint_dir


def _sym(edges: DataFrame, src: str, dst: str) -> DataFrame:
    e = edges.select(F.col(src).alias("v"), F.col(dst).alias("u")).where(F.col("v") != F.col("u"))
    return e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()


def _both(e: DataFrame) -> DataFrame:
    """(u, v): v is a neighbour of u, from undirected (hi, lo) edges."""
    return e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both(e)
    m = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(m, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    both = _both(e)
    down = both.where(F.col("v") < F.col("u"))
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    j = down.join(m, "u")
    nbrs = j.where(F.col("v") != F.col("m")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    self_ = m.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    return nbrs.unionByName(self_).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 100, log: list | None = None) -> DataFrame:
    """(vertex, comp): comp = least vertex id of the component."""
    checkpoint_dir(edges.sparkSession)
    e = (edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
         .where(F.col("hi") != F.col("lo")).distinct().checkpoint())
    for _ in range(max_rounds):
        new = _small_star(_large_star(e)).checkpoint()
        # one action: edges added plus edges removed by this round
        diff = (new.withColumn("_n", F.lit(True)).join(e.withColumn("_o", F.lit(True)), ["hi", "lo"], "full_outer")
                .agg(F.count_if(F.col("_n").isNull() | F.col("_o").isNull()).alias("d")).first().d)
        if log is not None:
            log.append(diff)
        e = new
        if diff == 0:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    members = e.select(F.col("hi").alias("vertex"), F.col("lo").alias("comp"))
    centres = e.select(F.col("lo").alias("vertex"), F.col("lo").alias("comp"))
    return members.unionByName(centres).distinct()


def dbscan(points: DataFrame, edges: DataFrame, min_samples: int, id_col: str = "id",
           src: str = "src", dst: str = "dst", members: DataFrame | None = None) -> DataFrame:
    """DBSCAN labels from the eps-neighbour edges: (id, label), -1 = noise.

    ``members`` (id, rep, n; stored) lets one point stand for a class of n equal
    points: the edges then join representatives (the least id of each class),
    a neighbour counts as often as its class has points, and every point takes
    its representative's label.

    A point is core when it has >= min_samples neighbours counting itself.
    Clusters are the connected core points, numbered 0.. by their least core
    id; a border point takes the least cluster number among its core
    neighbours; everything else is noise. With min_samples <= 2 every point on
    an edge is core, so clusters are the components of the edge graph.
    """
    adj = _sym(edges, src, dst)
    if members is None:
        deg = adj.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
        core = deg.where(F.col("deg") + 1 >= min_samples).select(F.col("v").alias("c"))
    else:
        own = members.where("id = rep").select(F.col("id").alias("c"), "n")
        deg = adj.join(own, F.col("u") == F.col("c")).groupBy("v").agg(F.sum("n").alias("deg"))
        core = (own.join(deg, F.col("c") == F.col("v"), "left")
                .where(F.coalesce("deg", F.lit(0)) + F.col("n") >= min_samples).select("c"))
    core_edges = (adj.join(core.withColumnRenamed("c", "v"), "v")
                  .join(core.withColumnRenamed("c", "u"), "u").where(F.col("v") < F.col("u")))
    comp = connected_components(core_edges, "v", "u")
    # cores without a core neighbour are clusters of their own
    comp_all = (core.join(comp.withColumnRenamed("vertex", "c"), "c", "left")
                .select(F.col("c").alias("vertex"), F.coalesce("comp", "c").alias("comp")))
    return label_points(points.select(F.col(id_col).alias("id")), adj, comp_all, members)


def label_points(points: DataFrame, adj: DataFrame, comp_all: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, label) of ``points`` (id) from the components (vertex, comp) of the
    core points and the neighbours ``adj`` (v, u) both ways: clusters numbered
    by ``comp``, border points with the least number among their core
    neighbours, -1 for the rest. ``members`` (id, rep): points stand for classes."""
    numbers = dense_index(comp_all.select("comp").distinct(), "comp", "label")
    core_lab = comp_all.join(numbers, "comp").select("vertex", "label")
    border = (adj.join(core_lab.select(F.col("vertex").alias("u"), F.col("label").alias("l")), "u")
              .join(core_lab.select(F.col("vertex").alias("v")), "v", "left_anti")
              .groupBy("v").agg(F.min("l").alias("label")).withColumnRenamed("v", "vertex"))
    labelled = core_lab.unionByName(border)
    if members is not None:
        labelled = members.join(labelled, F.col("rep") == F.col("vertex")).select(F.col("id").alias("vertex"), "label")
    return (points.select("id").join(labelled.withColumnRenamed("vertex", "id"), "id", "left")
            .select("id", F.coalesce(F.col("label"), F.lit(-1)).cast("long").alias("label")))
