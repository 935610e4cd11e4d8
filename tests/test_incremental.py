"""Versioned table sets, and events kept up to date by loads against DBSCAN over all points at once."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import incremental
from framelens.operators.incremental import EventStore
from framelens.sources.snapshots import Snapshots

SCHEMA = "vec_id long, embedding array<double>, load int"


def brute(rows, eps, m):
    """{id: label} of DBSCAN by the definition, clusters numbered by their least core id."""
    sound = {i: np.array(v, float) for i, v in rows.items()
             if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    def near(a, b):
        x, y = sound[a], sound[b]
        return len(x) == len(y) and 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) <= eps
    nbrs = {a: {b for b in sound if near(a, b)} | {a} for a in sound}
    core = sorted(a for a in sound if len(nbrs[a]) >= m)
    label, n = {}, 0
    for c in core:
        if c in label:
            continue
        todo = [c]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = n
                todo += [y for y in nbrs[x] if y in set(core)]
        n += 1
    out = dict(label)
    for a in sound:
        if a not in label:
            out[a] = min((label[b] for b in nbrs[a] if b in label), default=-1)
    return {i: out.get(i, -1) for i in rows}


@pytest.mark.parametrize("m", [2, 4])
def test_loads_equal_one_dbscan(spark, tmp_path, m):
    rng = np.random.default_rng(m)
    rows = {}
    for i in range(90):
        v = rng.normal(size=3) + 3 * np.eye(3)[i % 3]
        rows[i] = [float(x) for x in np.round(v, 3)]
    for i in range(90, 100):
        rows[i] = rows[7]  # copies, dealt over the loads
    rows |= {100: None, 101: [], 102: [0.0, 0.0, 0.0], 103: [0.0, 0.0, 0.0], 104: [1.0, None, 0.0],
             105: [float("nan"), 1.0, 0.0], 106: [1.0, 0.0], 107: [1.0, 0.0]}
    data = [(i, v, int(rng.integers(3))) for i, v in rows.items()] + [(None, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(data, SCHEMA)
    store = EventStore(spark, str(tmp_path / "events"), 0.01, m)
    for k in (2, 0, 1):
        store.load(df.where(F.col("load") == k))
    store.load(df.where(F.col("load") == 0))  # delivered again
    version = store.load(df.where("false"))
    assert version == 5
    got = {r.id: r.label for r in store.labels().collect()}
    want = brute(rows, 0.01, m)
    assert got == want
    assert max(want.values()) > 2 and -1 in want.values()


def test_events_of_nothing(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"), 0.2, 2)
    assert store.labels().count() == 0
    store.load(spark.createDataFrame([], SCHEMA))
    assert store.labels().count() == 0


def test_snapshots_show_complete_versions_only(spark, tmp_path):
    root = str(tmp_path / "t")
    tables = Snapshots(spark, root)
    assert tables.latest() == 0
    with pytest.raises(FileNotFoundError):
        tables.read("a")
    assert tables.publish({"a": spark.range(3).toDF("id")}) == 1
    # the rewrite reads the version that it replaces
    assert tables.publish({"a": tables.read("a").withColumn("x", F.col("id") * 0.5)}, {"b": spark.range(2)}) == 2
    assert tables.read("a").columns == ["id", "x"] and tables.read("a", 1).columns == ["id"]
    assert tables.publish(append={"b": spark.range(2, 5)}) == 3
    assert sorted(r.id for r in tables.read("b").collect()) == [0, 1, 2, 3, 4]
    # torn: data written, the manifest's job never committed
    spark.range(9).write.parquet(f"{root}/data/a-torn")
    os.makedirs(f"{root}/manifest/v4/_temporary/0")
    assert Snapshots(spark, root).latest() == 3 and tables.read("a").count() == 3
    # a write that fails midway shows nothing either, and the next one takes its number
    with pytest.raises(Exception):
        tables.publish({"a": spark.range(5).select(F.raise_error(F.lit("lost")).cast("int").alias("id"))})
    assert tables.latest() == 3
    assert tables.publish({"a": spark.range(7)}) == 4 and tables.read("a").count() == 7
    with pytest.raises(FileNotFoundError):
        tables.read("a", 9)


def test_copies_of_a_vector_do_not_grow_with_the_rows(spark):
    few, many = (incremental.link_blocks(n // 2, n, 12, 64) for n in (20_000, 600_000))
    assert sum(many) <= sum(few) + 2
    assert incremental.link_blocks(10_000_000, 10_000_000, 12, 64)[0] == -(-10_000_000 // (incremental.BLOCK_BYTES // 512))


def test_links_by_small_products_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if 1 - unit[i] @ unit[j] <= 0.02 and (i % 2 or j % 2)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(1000, [1.0, 0.0])], "cls long, v array<double>")
    monkeypatch.setattr(incremental, "PRODUCT_ROWS", 7)
    got = incremental.dense_links(rows.where("cls % 2 = 1"), rows.where("cls % 2 = 0"), 0.02, block_bytes=24 * 64).collect()
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want
