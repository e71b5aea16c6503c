"""Every registered query against its SQL check on the smallest tables, and ordered ones on skewed tables."""

import pytest

from tests.skewed import write_skewed
from tidemark.plans import catalog
from tidemark.sources.stage import clear_stages
from tools.compare import compare, connect

SMALL = "/root/testdata/sf0.001"

SKEWED = [
    "row_index", "row_index_long", "chunk_split", "mask_around_events", "run_stride", "anomaly_covered_rows",
    "slide_windows", "tumble_windows_wide", "upsample_linear", "upsample_cubic", "join_asof", "join_interval",
    "balance_ratio", "error_distribution", "roc_curve", "early_stop_epoch", "running_best", "windows_to_timeline",
]


@pytest.fixture(autouse=True)
def tidy(spark):
    yield
    clear_stages(spark)


@pytest.fixture(scope="module")
def small():
    return connect(SMALL)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    path = write_skewed(SMALL, str(tmp_path_factory.mktemp("skewed")), copies=3)
    return path, connect(path)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, name):
    state, _, _, note = compare(spark, small, name, catalog.QUERIES[name], catalog.SQL.get(name), SMALL)
    assert state in ("ok", "rows only"), note


@pytest.mark.parametrize("name", SKEWED)
def test_skewed(spark, skewed, name):
    path, con = skewed
    state, _, _, note = compare(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], path)
    assert state == "ok", note


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
