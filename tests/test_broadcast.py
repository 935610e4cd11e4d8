from framelens.operators.ingest import checked_broadcast


def hinted(df):
    return "hint" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_is_judged_by_rows_and_bytes(spark):
    few = spark.createDataFrame([(k, "é" * 1000, None) for k in range(20)], "id long, text string, `odd.name` string")
    assert hinted(checked_broadcast(few))
    assert not hinted(checked_broadcast(few, max_rows=19))
    assert hinted(checked_broadcast(few, max_bytes=41_000)) and not hinted(checked_broadcast(few, max_bytes=40_000))
    assert hinted(checked_broadcast(few.limit(0)))
