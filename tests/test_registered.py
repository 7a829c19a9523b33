"""A sample of the registered queries next to their SQL on the small data set, and plan checks."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from wardlog.plans.detection import detect  # noqa: E402
from wardlog.sources import fixtures  # noqa: E402
from wardlog.sources.rules import builtin_rules  # noqa: E402

SAMPLE = ["parse_auto_detect", "rule_fan_out", "alerts_consolidated", "alerts_status_aware",
          "ip_features", "closure_per_finding", "ip_locations", "hourly_alerts", "roc_auc",
          "technologies", "real_paths", "variant_comparison"]


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, sf, name):
    status, rows, _, note = compare.check(spark, con, sf, name)
    assert status == "ok" and rows > 0, note


def test_contract(spark):
    queries, sql = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert len(spark_entry.entry(spark).collect()) > 0


def test_plans_do_not_cross_join_or_evaluate_python(spark, sf):
    hits = detect(fixtures.security_events(spark, sf), builtin_rules(86400, 2))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan


def test_scan_reads_only_what_is_needed(spark, sf):
    plan = spark_entry.queries()["tumbling_buckets"](spark, sf)._jdf.queryExecution().toString()
    read = [line for line in plan.splitlines() if "FileScan" in line][-1]
    assert "event_id" in read and "value" not in read.split("ReadSchema")[1]
