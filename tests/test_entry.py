"""Driver contract and a sample of the SQL oracle at sf0.001."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from shopflow.plans import catalog
from tests.conftest import SF001

SAMPLE = ["funnel_rates", "session_features", "segment_stats", "revenue_quintiles", "pareto_curve",
          "ltv_segments", "insights", "filtered_kpis", "top_products", "event_gaps", "executive_summary",
          "insights_browsing", "insights_weekend", "baseline_alerts_stored", "summary_lists", "clean_events_text",
          "top20pct_share", "pareto_8020", "temporal_union", "text_search"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def test_contract(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 75
    assert set(sql) <= set(qs)
    shop = set(catalog.spark_queries())
    assert shop <= set(qs) and shop - set(sql) == {"summary"}
    assert {"summary_fields", "summary_lists"} <= set(sql)
    df = E.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in ["part", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    idx = [res.columns.index(c) for c in sdf.columns]
    a = sorted([tuple(_norm(x) for x in r) for r in sdf.collect()], key=repr)
    b = sorted([tuple(_norm(r[i]) for i in idx) for r in res.fetchall()], key=repr)
    assert a == b


def test_rules_that_are_silent_on_the_whole_log_fire(spark):
    from shopflow.operators.insights import RULE_TEXTS
    qs = E.queries()
    browsing = [r.insight for r in qs["insights_browsing"](spark, SF001).collect()]
    for rule in ("low_view_to_cart", "low_cart_to_purchase"):
        assert any(m.startswith(RULE_TEXTS[rule].split("{}")[0]) for m in browsing)
    assert RULE_TEXTS["no_revenue"] in browsing and RULE_TEXTS["zero_spenders"] in browsing
    assert RULE_TEXTS["weekend"] in [r.insight for r in qs["insights_weekend"](spark, SF001).collect()]


def test_without_the_training_data_package(spark, monkeypatch):
    """A package that is absent or broken takes only its own queries away."""
    import sys
    monkeypatch.setitem(sys.modules, "shopflow.llm", None)
    assert set(E.queries()) == set(catalog.spark_queries()) and "pipeline" not in E.oracle_sql()
