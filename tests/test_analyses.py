"""Analysis edge cases: empty cohorts, ties, fallbacks."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopflow.operators import behavior, explore, funnel, insights, report, retention, revenue, segments, temporal
from shopflow.operators.common import zip_one_row

USERS = ("user_id long, user_total_sessions long, user_total_spending decimal(28,2), "
         "user_view_to_purchase_rate double, user_purchase_per_session double")


def users(spark, rows):
    return spark.createDataFrame([(i, s, Decimal(str(v)), 0.5, 1.0) for i, (s, v) in enumerate(rows)], USERS)


def test_loyalty_needs_both_cohorts(spark):
    assert segments.loyalty(users(spark, [(5, 1), (6, 2)])).count() == 0
    row = segments.loyalty(users(spark, [(5, 10), (1, 2), (2, 4)])).first()
    assert row.loyal_user_count == 1 and row.casual_user_count == 2 and row.casual_user_avg_spend == 3.0
    prem = explore.loyalty_premium(segments.loyalty(users(spark, [(5, 1), (6, 2)]))).first()
    assert prem.loyalty_premium_pct == 0.0 and prem.loyal_user_count == 0


def test_spending_segments_all_zero(spark):
    u = users(spark, [(1, 0), (2, 0)])
    assert {r.spending_segment for r in segments.spending_segments(u).collect()} == {"Zero Spender"}


def test_ltv_fallbacks(spark):
    # fewer than 5 distinct values, repeated edges -> 33/67 fallback
    u = users(spark, [(1, 1), (1, 1), (1, 1), (1, 1), (1, 5)])
    got = [r.ltv_segment for r in retention.ltv_segments(u).orderBy("user_id").collect()]
    assert got == ["Low", "Low", "Low", "Low", "High"]
    assert {r.ltv_segment for r in retention.ltv_segments(users(spark, [(1, 0), (2, 0)])).collect()} == {"No Spending"}
    # q33 = q67 = 0 with a large max: Zero / Low / High
    u = users(spark, [(1, 0)] * 8 + [(1, 10), (1, 100)])
    got = [r.ltv_segment for r in retention.ltv_segments(u).orderBy("user_id").collect()]
    assert got == ["Zero"] * 8 + ["Low", "High"]
    # nine distinct values: quintiles
    u = users(spark, [(1, v) for v in range(1, 10)])
    got = [r.ltv_segment for r in retention.ltv_segments(u).orderBy("user_id").collect()]
    assert got[0] == "Bronze" and got[-1] == "Diamond"
    # report variant: <= q33 Low, <= q67 Medium, else High
    u = users(spark, [(1, 1), (1, 1), (1, 1), (1, 1), (1, 5)])
    got = [r.ltv_segment for r in report.report_users(u).orderBy("user_id").collect()]
    assert got == ["Low", "Low", "Low", "Low", "High"]


SESS = ("user_session string, view_count long, cart_count long, purchase_count long, n_unique_brands long, "
        "n_unique_categories long, session_started_at timestamp_ntz, session_total_spending decimal(28,2), "
        "session_duration double, view_to_purchase_rate double, is_weekend boolean")


def sessions(spark, rows):
    return spark.createDataFrame(rows, SESS)


def test_funnel_zero_denominators(spark):
    import datetime as dt
    s = sessions(spark, [("a", 0, 0, 1, 1, 1, dt.datetime(2024, 1, 1), Decimal("5"), 0.0, 0.0, False)])
    r = funnel.funnel_rates(s).first()
    assert (r.view_to_cart, r.cart_to_purchase, r.view_to_purchase) == (0.0, 0.0, 0.0)
    d = {x.duration_category: x.view_to_purchase_rate for x in funnel.duration_conversion(s).collect()}
    assert d == {"<1min": 0.0, "1-5min": 0.0, "5-15min": 0.0, ">15min": 0.0}


def test_peak_ties_pick_smallest_key(spark):
    import datetime as dt
    rows = [("a", 1, 0, 0, 1, 1, dt.datetime(2024, 1, 1, 3), Decimal("1"), 10.0, 0.5, False),
            ("b", 1, 0, 0, 1, 1, dt.datetime(2024, 2, 1, 1), Decimal("1"), 10.0, 0.5, False)]
    p = temporal.temporal_peaks(sessions(spark, rows)).first()
    assert p.peak_activity_hour == 1 and p.best_conversion_hour == 1
    assert p.peak_revenue_month == 1 and p.peak_conversion_month == 1
    tp = {r.time_period: r.user_session for r in temporal.time_periods(sessions(spark, rows)).collect()}
    assert tp == {"Night": 2, "Morning": 0, "Afternoon": 0, "Evening": 0}


def test_empty_peaks_are_null(spark):
    p = temporal.temporal_peaks(sessions(spark, [])).first()
    assert p.peak_activity_hour is None and p.peak_revenue_month is None


def test_order_value_labels_and_abandonment(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(str(i), 1, c, p, 1, 1, t, Decimal(str(v)), 1.0, 0.0, False)
            for i, (v, c, p) in enumerate([(0, 1, 0), (25, 0, 1), (25.01, 0, 1), (100, 0, 1), (500, 0, 1),
                                           (501, 1, 1), (0, 2, 0)])]
    s = sessions(spark, rows)
    d = {r.order_value_category: r["count"] for r in revenue.order_value_distribution(s).collect()}
    assert d == {"Small": 1, "Medium": 2, "Large": 1, "Premium": 1}
    a = revenue.cart_abandonment(s).first()
    assert a.cart_abandonment_sessions == 2
    assert a.potential_revenue_from_abandonment == pytest.approx(2 * (25 + 25.01 + 100 + 500 + 501) / 5)


def test_session_quality_median(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(str(i), v, 0, 0, 1, 1, t, Decimal("0"), None if d is None else float(d), 0.0, False)
            for i, (v, d) in enumerate([(3, 10), (3, 20), (3, 30), (1, 40), (5, None)])]
    q = {r.user_session: r.session_quality for r in behavior.session_quality_flag(sessions(spark, rows)).collect()}
    assert q == {"0": "Low", "1": "Low", "2": "High", "3": "Low", "4": "Low"}


def test_report_session_buckets(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(str(i), 1, 0, 0, 1, 1, t, Decimal("0"), d, 0.0, False)
            for i, d in enumerate([0.0, 60.0, 60.6, 300.0, 900.0, 901.0, None])]
    got = {r.user_session: r.session_quality for r in report.report_sessions(sessions(spark, rows)).collect()}
    assert got == {"0": None, "1": "Quick", "2": "Short", "3": "Short", "4": "Medium", "5": "Long", "6": None}


def test_baseline_alerts(spark):
    cur = spark.createDataFrame([(0.2, 0.5, 0.1)], "view_to_cart double, cart_to_purchase double, view_to_purchase double")
    base = spark.createDataFrame([(0.25, 0.0, 0.08)], "view_to_cart double, cart_to_purchase double, view_to_purchase double")
    got = {r.metric: (r.status, r.message) for r in insights.baseline_alerts(cur, base).collect()}
    assert got["view_to_cart"] == ("dropped", "⚠️ view_to_cart dropped by 20.0% compared to baseline.")
    assert got["cart_to_purchase"] == (None, None)
    assert got["view_to_purchase"] == ("increased", "✅ view_to_purchase increased by 25.0% compared to baseline.")


def test_insight_rules(spark):
    facts = spark.createDataFrame([(0.05, 0.5, 0.6, 0.3, 3, 1234.5, 0.3, 0.2, 14, 3, 4, True, 300.0, 100.0,
                                    Decimal("0"), 0.9)],
                                  "view_to_cart double, cart_to_purchase double, top_10_pct double, "
                                  "top_20_pct_of_user_revenue double, cart_abandonment_sessions long, "
                                  "potential_revenue_from_abandonment double, weekend_conversion_rate double, "
                                  "weekday_conversion_rate double, best_conversion_hour int, peak_revenue_month int, "
                                  "peak_conversion_month int, has_loyalty boolean, loyal_user_avg_spend double, "
                                  "casual_user_avg_spend double, total_revenue decimal(28,2), zero_spender_share double")
    got = [r.insight for r in insights.insight_messages(facts).orderBy("insight_number").collect()]
    assert got == [
        "⚠️ View→Cart conversion is low (5.0%).",
        "💡 Top 10 users contribute 60.0% of user revenue (high concentration).",
        "💡 Top 20% of users account for 30.0% of user revenue.",
        "💰 3 cart abandonment sessions represent potential recovery of $1,234.50.",
        "📈 Weekend conversion notably higher than weekday; consider shifting spend.",
        "⏰ Best conversion hour: 14:00.",
        "📅 Peak revenue month: 3.",
        "📅 Peak conversion month: 4.",
        "⭐ Loyal users have 200.0% higher average spend than casual users.",
        "⚠️ Total revenue is zero—check data ingestion or filtering.",
        "⚠️ Majority of users are zero spenders; consider focusing on activation strategies.",
    ]


def test_pareto_and_shares(spark):
    u = users(spark, [(1, 10), (2, 30), (1, 0), (3, 60), (1, 0)])
    curve = retention.pareto_curve(u).orderBy("user_rank").collect()
    assert [r.user_total_spending for r in curve] == [Decimal("60.00"), Decimal("30.00"), Decimal("10.00"),
                                                       Decimal("0.00"), Decimal("0.00")]
    assert curve[-1].cumulative_users_pct == 100.0 and curve[-1].cumulative_revenue_pct == 100.0
    assert curve[0].cumulative_revenue_pct == 60.0
    assert revenue.top20pct_share(u).first().top_20_pct_of_user_revenue == 0.6
    assert retention.pareto_8020(u).first().revenue_concentration_pct == 60.0
    zero = users(spark, [(1, 0), (1, 0)])
    assert retention.pareto_8020(zero).first().revenue_concentration_pct == 0.0
    assert revenue.top20pct_share(zero).first().n_top_20_percent == 1


def test_bad_search_expression_raises(spark):
    from shopflow.operators.explore import text_search
    from shopflow.plans.context import ShopContext
    ctx = ShopContext.for_source(spark, "/root/testdata/sf0.001")
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        text_search(ctx.events, "brand#(").count()


def test_tied_means_round_half_even(spark):
    """A mean rate of 0.8725 made of thirds and others is a tie, whatever the last digits of its parts."""
    from shopflow.operators import temporal
    rates = [2 / 3] * 3 + [1.0] * 6 + [0.725]  # 8.725 / 10
    df = spark.createDataFrame([(f"s{i}", dt.datetime(2024, 1, 1, 13), r) for i, r in enumerate(rates)],
                               "user_session string, session_started_at timestamp_ntz, view_to_purchase_rate double")
    row = temporal.hourly(df.selectExpr("*", "cast(0 as decimal(28,2)) as session_total_spending")).first()
    assert (row.user_session, row.view_to_purchase_rate) == (10, 0.872)
