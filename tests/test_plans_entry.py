"""Plan shape checks, the driver entry points, and the oracle on the smallest scale."""

import importlib.util
import os

import pytest

from oracle_harness import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_mod)

from skylane.plans import catalog  # noqa: E402


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "SEGMENT_TYPE" in df.columns


def test_registry_is_consistent():
    qs, oracle = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 60


def test_event_type_filter_reaches_scan(spark, sf_small):
    from skylane.plans import listings
    plan = _plan(listings.q_event_funnel(spark, sf_small))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_segment_scan_is_pruned_and_aggregated_partially(spark, sf_small):
    from skylane.plans import experiments
    plan = _plan(experiments.q_ab_segments_all(spark, sf_small))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
    assert "partial_count" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle_small(spark, sf_small, name):
    con = duck(sf_small)
    res = compare(entry_mod.queries()[name](spark, sf_small), entry_mod.oracle_sql()[name], con)
    assert res["names_match"] and res["rows_match"] and res["types_match"] and res["approx"], res


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cartesian_or_nested_loop_join(spark, sf_small, name):
    plan = _plan(entry_mod.queries()[name](spark, sf_small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["label_shares", "marketing_actions"])
def test_review_texts_are_scored_once(spark, sf_small, name):
    from skylane.plans import text
    one, plan = (_plan(q(spark, sf_small)) for q in (text.q_sentiment_by_topic, text.QUERIES[name]))
    assert plan.count("FileScan") <= one.count("FileScan") and plan.count("Generate posexplode") == 1


def test_first_seen_key_is_parsed_once(spark, sf_small):
    from skylane.plans import landing
    assert _plan(landing.q_dedup_first_seen(spark, sf_small)).count("get_json_object") == 1
