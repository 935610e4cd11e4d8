"""Every registered query against its DuckDB oracle (the driver's gate),
at sf0.001, plus a smoke run of entry()."""
import pytest

import __spark_entry__ as E
from framelens.plans.catalog import QUERIES
from tests.conftest import SF_SMALL
from tools.check_oracle import run

NAMES = sorted(QUERIES)


def test_every_query_has_oracle_or_is_listed():
    no_sql = set(QUERIES) - set(E.oracle_sql())
    assert no_sql == {"map_coords", "fuzzy_graph", "map_layout", "page_bodies", "similar_pairs_lsh"}, no_sql


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = run(spark, SF_SMALL, [name], verbose=False)[name]
    assert "error" not in res, res.get("error")
    if res["ok"] is not None:
        assert res["ok"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "event_id" in df.columns
