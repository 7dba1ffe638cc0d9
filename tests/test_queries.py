"""Every registered query against its SQL on the smallest data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, note


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 1000 and rows.columns[:2] == ["image_id", "box_ord"]


def test_session_gap_is_inclusive(spark):
    """A pause of exactly the gap does not end a session, in the table and in the stream form."""
    from annospark.streaming import events as ev

    rows = [("a", 0), ("a", 1800000), ("b", 0), ("b", 1800001), ("b", 1800002)]
    df = spark.createDataFrame(rows, "session_id string, ts_ms long").withColumn("event_type", F.lit("undo"))
    df = df.withColumn("ts", F.timestamp_millis("ts_ms"))
    key = lambda d: sorted(tuple(r) for r in d.select("session_id", "start_ms", "end_ms", "events").collect())
    assert key(ev.session_activity(df)) == key(ev.stream_session_activity(df))
    assert len(key(ev.session_activity(df))) == 3


def test_scan_is_pruned_and_filtered(spark):
    """Only the needed columns are read, and a fitted cut reaches the scan."""
    from annospark import fixtures as fx
    from annospark.operators import acceptance as ac

    df = ac.fixed(ac.with_score(fx.candidates(spark, SF)), 0.5)[0].select("image_id", "box_ord")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_good,0.5)" in plan
    assert "ReadSchema: struct<image_id:bigint,box_ord:bigint,p_good:double>" in plan


def test_literal_bound_limits_before_the_shuffle(spark):
    from annospark import fixtures as fx
    from annospark.operators import acceptance as ac

    df, _ = ac.adaptive_k(ac.with_score(fx.candidates(spark, SF)), ac.Seed(3.0, 3.0))
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
