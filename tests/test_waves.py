"""Bounded waves with a ledger: calls are counted by the lines that models append to files."""
import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import inference
from framelens.operators.inference import QUOTA, QuotaExhausted
from framelens.operators.waves import Waves, running_total, until_stop


def counting(folder, quota_from=None, fail=False):
    os.makedirs(folder, exist_ok=True)

    def model(payload, attempt=0):
        batch = json.loads(payload)[0]["id"] // 5
        open(os.path.join(folder, f"{batch}-{uuid.uuid4().hex}"), "w").close()
        if quota_from is not None and batch >= quota_from:
            raise QuotaExhausted("spent")
        return "not JSON" if fail else inference.lexicon_model(payload)
    return model


def calls(folder):
    return sorted(int(f.split("-")[0]) for f in os.listdir(folder))


def planned(spark, path, n_batches, n_keys=1):
    rows = spark.range(5 * n_batches).select(F.col("id").alias("row_idx"), F.repeat(F.lit("was "), 10).alias("full_text"))
    w = Waves(spark, str(path))
    w.plan(inference.batch_items(rows, n_keys))  # 200 characters, so 50 tokens a batch
    return w


def test_running_total_by_levels(spark):
    rng = np.random.default_rng(0)
    data = [(int(i), int(i) % 3, int(v)) for i, v in zip(rng.choice(900, 300, replace=False), rng.integers(-5, 9, 300))]
    df = spark.createDataFrame(data, "n long, k int, v long")
    got = {(r.n, r.k): r.t for r in running_total(df, "n", "v", "t", ["k"], block=7).collect()}
    assert got == {(n, k): sum(v2 for n2, k2, v2 in data if k2 == k and n2 <= n) for n, k, _ in data}
    assert running_total(df.where("false"), "n", "v", "t", ["k"]).count() == 0


def test_at_most_one_wave_behind_a_spent_quota(spark, tmp_path):
    w = planned(spark, tmp_path / "w", 40)
    day = w.run_day(counting(str(tmp_path / "one"), quota_from=13), wave_batches=10)
    assert calls(tmp_path / "one") == list(range(20))
    assert [r.batch_index for r in until_stop(day).orderBy("batch_index").collect()] == list(range(14))
    # the next day sends what has no answer, each batch once
    w.run_day(counting(str(tmp_path / "two")), wave_batches=10)
    assert calls(tmp_path / "two") == list(range(13, 40))
    good = w.runs().where(F.col("status") != QUOTA)
    assert sorted(r.batch_index for r in good.collect()) == list(range(40))
    # nothing is left for a third
    assert w.run_day(counting(str(tmp_path / "three")), wave_batches=10).count() == 0 and calls(tmp_path / "three") == []


def test_budget_is_kept_and_a_restart_goes_on(spark, tmp_path):
    w = planned(spark, tmp_path / "w", 12, n_keys=2)
    # 6 batches of 50 tokens a key; 180 tokens let a key send three
    models = [counting(str(tmp_path / "even")), counting(str(tmp_path / "odd"))]
    day = {r.batch_index: r for r in w.run_day(models, budget=180, wave_batches=4).collect()}
    assert sorted(day) == list(range(7)) and day[6].status == QUOTA and day[6].attempts == 0
    assert [day[i].spent for i in range(6)] == [50, 50, 100, 100, 150, 150]
    assert calls(tmp_path / "even") == [0, 2, 4] and calls(tmp_path / "odd") == [1, 3, 5]  # a key's model gets its batches
    again = Waves(spark, str(tmp_path / "w"))  # another run of the program
    again.plan(spark.createDataFrame([], "batch_index long, key_route long, payload string, text_chars long"))
    again.run_day(models, wave_batches=4)
    assert calls(tmp_path / "even") == [0, 2, 4, 6, 8, 10] and calls(tmp_path / "odd") == [1, 3, 5, 7, 9, 11]


def test_waves_published_before_a_crash_are_not_sent_again(spark, tmp_path):
    w = planned(spark, tmp_path / "w", 12)
    first = counting(str(tmp_path / "calls"))

    def breaks(payload, attempt=0):
        if json.loads(payload)[0]["id"] // 5 == 6:
            raise ImportError("lost")  # fails the job
        return first(payload, attempt)
    with pytest.raises(Exception):
        w.run_day(breaks, wave_batches=4)
    before = calls(tmp_path / "calls")
    assert w.runs().count() == 4 and set(before) >= {0, 1, 2, 3} and max(before) < 8
    w.run_day(first, wave_batches=4)
    assert w.runs().count() == 12 and calls(tmp_path / "calls").count(3) == 1


def test_failures_use_their_attempts_and_stay(spark, tmp_path):
    w = planned(spark, tmp_path / "w", 2)
    rows = w.run_day(counting(str(tmp_path / "c"), fail=True)).collect()
    assert [r.attempts for r in rows] == [3, 3] and {r.status for r in rows} == {inference.FAILED}
    empty = planned(spark, tmp_path / "e", 0)
    assert empty.run_day(inference.lexicon_model).count() == 0
