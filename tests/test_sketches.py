from pyspark.sql import functions as F

from framelens.operators import sketches


def table(spark, rows):
    return spark.createDataFrame(rows, "d int, source string, item string, rows string")


def test_union_of_days_is_within_the_stated_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).cast("int").alias("d"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                      (F.col("id") % 10_007).cast("string").alias("item"))
    exact = {r.source: r.n for r in rows.groupBy("source").agg(F.countDistinct("item").alias("n")).collect()}
    got = sketches.distinct_over(sketches.day_sketches(rows, F.col("d"), ["source"], "item"), ["source"]).collect()
    assert {r.source for r in got} == set(exact)
    assert all(abs(r.estimate - exact[r.source]) <= sketches.stated_error() * exact[r.source] for r in got)
    assert sum(r.rows for r in got) == 60_000


def test_loads_add_up_and_repeats_change_nothing(spark):
    rows = table(spark, [(k % 4, "a" if k % 2 else "b", str(k % 50), "x") for k in range(400)])
    whole = sketches.distinct_over(sketches.day_sketches(rows, F.col("d"), ["source"], "item"), ["source"])
    halves = [sketches.day_sketches(rows.where(c), F.col("d"), ["source"], "item") for c in ("d < 2", "d >= 2", "d >= 1")]
    loads = sketches.distinct_over(halves[0].unionByName(halves[1]).unionByName(halves[2]), ["source"])
    pick = lambda df: {r.source: (r.n_days, r.estimate) for r in df.collect()}
    assert pick(whole) == pick(loads) == {"a": (2, 25), "b": (2, 25)}
    assert pick(sketches.distinct_over(halves[0], ["source"], F.col("day") == 1)) == {"a": (1, 25)}


def test_nulls_empty_text_and_empty_table(spark):
    rows = table(spark, [(1, None, None, None), (1, None, "", "x"), (None, "a", None, "x"), (None, "a", None, None)])
    got = {r.source: (r.rows, r.estimate) for r in sketches.distinct_over(sketches.day_sketches(rows, F.col("d"), ["source"], "item"), ["source"]).collect()}
    assert got == {None: (2, 1), "a": (2, 0)}
    assert sketches.day_sketches(rows.limit(0), F.col("d"), ["source"], "item").count() == 0
