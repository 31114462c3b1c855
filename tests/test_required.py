"""IO12: every analysis names the columns it lacks before anything runs."""

import pytest

from shopflow.operators import behavior, funnel, products, retention, revenue, segments, temporal
from shopflow.plans.context import ShopContext
from shopflow.plans.summary import build_summary
from tests.conftest import SF001

CASES = [
    (funnel.funnel_counts, "sessions", "cart_count", "session_df"), (funnel.funnel_rates, "sessions", "view_count", "session_df"),
    (funnel.duration_conversion, "sessions", "session_duration", "session_df"),
    (segments.loyalty, "users", "user_total_sessions", "user_df"), (segments.spending_segments, "users", "user_total_spending", "user_df"),
    (segments.activity_levels, "users", "user_total_sessions", "user_df"),
    (temporal.weekend_conversion, "sessions", "is_weekend", "session_df"), (temporal.monthly, "sessions", "session_started_at", "sessions"),
    (temporal.quarterly, "sessions", "session_total_spending", "sessions"), (temporal.hourly, "sessions", "user_session", "sessions"),
    (temporal.time_periods, "sessions", "view_to_purchase_rate", "sessions"), (temporal.temporal_peaks, "sessions", "session_started_at", "sessions"),
    (products.top_brands, "brands", "purchase_spending", "brand_df"), (products.efficient_brands, "brands", "brand_view_to_purchase_rate", "brand_df"),
    (products.top_categories, "categories", "category_code", "category_df"),
    (products.efficient_categories, "categories", "purchase_spending", "category_df"),
    (revenue.revenue_totals, "sessions", "session_total_spending", "session_df"),
    (revenue.order_value_distribution, "sessions", "session_total_spending", "session_df"),
    (revenue.cart_abandonment, "sessions", "purchase_count", "session_df"), (revenue.top10_user_share, "users", "user_total_spending", "user_df"),
    (revenue.top20pct_share, "users", "user_total_spending", "user_df"), (revenue.revenue_quintiles, "users", "user_total_spending", "user_df"),
    (behavior.brand_breadth, "sessions", "n_unique_brands", "session_df"), (behavior.multi_category, "sessions", "n_unique_categories", "session_df"),
    (behavior.session_quality, "sessions", "view_to_purchase_rate", "session_df"), (behavior.session_quality_flag, "sessions", "view_count", "session_df"),
    (retention.ltv_segments, "users", "user_total_spending", "user_df"), (retention.high_value_users, "users", "user_total_spending", "user_df"),
    (retention.session_frequency, "users", "user_total_sessions", "user_df"), (retention.repeat_rate, "users", "user_total_sessions", "user_df"),
    (retention.pareto_curve, "users", "user_id", "user_df"), (retention.pareto_8020, "users", "user_total_spending", "user_df"),
]


@pytest.mark.parametrize("analysis,table,column,name", CASES, ids=lambda x: getattr(x, "__name__", str(x)))
def test_missing_column_is_named(spark, analysis, table, column, name):
    df = getattr(ShopContext.for_source(spark, SF001), table)
    with pytest.raises(ValueError, match=f"Missing required columns in {name[:7]}.*{column}"):
        analysis(df.drop(column))


def test_product_averages_checks_both_tables(spark):
    ctx = ShopContext.for_source(spark, SF001)
    with pytest.raises(ValueError, match="category_df"):
        products.product_averages(ctx.brands, ctx.categories.drop("category_view_to_purchase_rate"))


def test_summary_checks_every_table(spark):
    class Lacking:
        def __init__(self, ctx):
            self.sessions, self.users, self.brands, self.categories = ctx.sessions, ctx.users.drop("user_purchase_per_session"), ctx.brands, ctx.categories

    with pytest.raises(ValueError, match="user_features.*user_purchase_per_session"):
        build_summary(Lacking(ShopContext.for_source(spark, SF001)))
