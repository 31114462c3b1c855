"""Plan shape checks: pushdown, pruning, and no single-task windows over rows."""

from pyspark.sql import functions as F

from shopflow.operators.clean import add_session_clock, clean_base
from shopflow.operators.explore import apply_filters
from shopflow.operators.retention import pareto_curve
from shopflow.plans.context import ShopContext
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    ctx = ShopContext.for_source(spark, SF001)
    f = apply_filters(ctx.events, ("1997-01-01", "1997-12-31"), ["Brand#1"], None).select("user_session", "brand")
    plan = _plan(f)
    assert "EqualTo(brand,Brand#1)" in plan
    assert "GreaterThanOrEqual(event_time," in plan
    assert "ReadSchema: struct<user_session:string,brand:string,event_time" in plan


def test_ordered_scans_are_partitioned(spark):
    ctx = ShopContext.for_source(spark, SF001)
    for df in (add_session_clock(ctx.events), pareto_curve(ctx.users)):
        # one-task exchanges only carry the table with one row per range
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert any("Aggregate" in x and "_pid" in x for x in lines[i:i + 10]), line


def test_session_features_need_one_scan_and_no_join(spark):
    from shopflow.operators.features import session_features
    plan = _plan(session_features(ShopContext.for_source(spark, SF001).events))
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Expand" not in plan
    cells = plan.index("any_row")  # facts are made of collapsed cells
    assert plan.index("Generate explode") < cells


def test_prefix_sums_need_one_row_shuffle(spark, monkeypatch):
    from shopflow.operators import ordered
    written = []
    keep = ordered._written
    monkeypatch.setattr(ordered, "_written", lambda df: written.append(_plan(df)) or keep(df))
    out = pareto_curve(ShopContext.for_source(spark, SF001).users)
    assert len(written) == 1 and written[0].count("Exchange rangepartitioning") == 1 and written[0].count("Exchange") == 1
    rows = [line for line in _plan(out).splitlines() if "Exchange hashpartitioning" in line]
    assert len(rows) <= 1 and "Window" not in _plan(out).split("BroadcastExchange")[0]


def test_temporal_tables_share_one_scan_of_sessions(spark):
    import __spark_entry__ as E
    ctx = ShopContext.for_source(spark, SF001)
    assert ctx.start_cells.count() <= 289
    for name in ("monthly", "quarterly", "time_periods", "hourly", "temporal_peaks", "temporal_union", "peak_quarter"):
        plan = _plan(E.queries()[name](spark, SF001))
        assert "session_features" not in plan and "start_cells" in plan, name


def test_one_index_per_column(spark, monkeypatch):
    from shopflow.operators import binning
    from shopflow.plans.report import build_report
    from shopflow.plans.summary import build_summary
    built = []
    keep = binning.OrderStatistics.__init__
    monkeypatch.setattr(binning.OrderStatistics, "__init__", lambda self, df, value: built.append(str(value)) or keep(self, df, value))
    base = ShopContext.for_source(spark, SF001)
    ctx = ShopContext(spark, base._raw)
    ctx._tables = {k: v for k, v in base._tables.items()}
    build_report(ctx)
    build_summary(ctx)
    assert sorted(built) == ["Column<'session_duration'>", "Column<'user_total_spending'>"]


def test_search_looks_at_distinct_values(spark):
    from shopflow.operators.explore import text_search
    ctx = ShopContext.for_source(spark, SF001)
    plan = _plan(text_search(ctx.events, "brand#2", None, ctx.search_values))
    line = next(x for x in plan.splitlines() if "RLIKE" in x and "Filter" in x)
    below = plan[plan.index(line):]
    assert "search_values" in below and "events_base" not in below


def test_session_features_plan_has_partial_aggregation(spark):
    from shopflow.operators.features import session_features
    ctx = ShopContext.for_source(spark, SF001)
    plan = _plan(session_features(ctx.events))
    assert "partial_count" in plan


def test_distinct_products_need_no_expand(spark):
    from shopflow.operators.features import brand_features, category_features, session_unique_products
    ctx = ShopContext.for_source(spark, SF001)
    for df in (brand_features(ctx.events), category_features(ctx.events), session_unique_products(ctx.events)):
        assert "Expand" not in _plan(df)


def test_no_cross_joins(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for name in ["summary", "summary_fields", "pareto_curve", "brand_search", "top20pct_share",
                 "executive_summary", "insights", "behavior_table"]:
        plan = _plan(qs[name](spark, SF001))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
