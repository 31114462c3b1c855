"""Baseline alerts and the ordered list of rule-based insights.

All rules read one wide row of global aggregates, so the whole list is a
single-row computation after distributed aggregation.  Numbers are
formatted like Python's ``:.1f`` / ``:,.2f``: rounded half-even first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.operators.common import zip_one_row
from shopflow.schema import ALERT_DROP_PCT, LOW_FUNNEL_ALERT_THRESHOLD

RATE_KEYS = ("view_to_cart", "cart_to_purchase", "view_to_purchase")


# The texts of alerts and insights; {} stands for a number or name.
ALERT_TEXTS = {
    "dropped": "⚠️ {} dropped by {}% compared to baseline.",
    "increased": "✅ {} increased by {}% compared to baseline.",
}
RULE_TEXTS = {
    "low_view_to_cart": "⚠️ View→Cart conversion is low ({}%).",
    "low_cart_to_purchase": "⚠️ Cart→Purchase conversion is low ({}%).",
    "top_10_users": "💡 Top 10 users contribute {}% of user revenue (high concentration).",
    "top_20_percent": "💡 Top 20% of users account for {}% of user revenue.",
    "abandonment": "💰 {} cart abandonment sessions represent potential recovery of ${}.",
    "weekend": "📈 Weekend conversion notably higher than weekday; consider shifting spend.",
    "weekday": "📈 Weekday conversion notably higher than weekend; optimize campaigns accordingly.",
    "best_hour": "⏰ Best conversion hour: {}:00.",
    "revenue_month": "📅 Peak revenue month: {}.",
    "conversion_month": "📅 Peak conversion month: {}.",
    "loyalty": "⭐ Loyal users have {}% higher average spend than casual users.",
    "no_revenue": "⚠️ Total revenue is zero—check data ingestion or filtering.",
    "zero_spenders": "⚠️ Majority of users are zero spenders; consider focusing on activation strategies.",
}


def say(text: str, *values: Column) -> Column:
    """A text with its places filled."""
    parts = text.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def fmt1(x: Column) -> Column:
    """Python ``f"{x:.1f}"``."""
    return F.format_string("%.1f", F.rint(x * 10) / 10)


def fmt_money(x: Column, digits: int = 2) -> Column:
    """Python ``f"{x:,.2f}"`` (thousands separators)."""
    return F.format_number(x, digits)


def _change(cur: Column, base: Column) -> Column:
    return F.when(F.coalesce(base, F.lit(0.0)) != 0, (cur - base) / base)


def _status(change: Column) -> Column:
    return F.when(change <= -ALERT_DROP_PCT, "dropped").when(change >= ALERT_DROP_PCT, "increased")


def _alert_message(metric: Column, change: Column) -> Column:
    out = F.lit(None).cast("string")
    for status, text in ALERT_TEXTS.items():
        out = F.when(_status(change) == status, say(text, metric, fmt1(F.abs(change) * 100))).otherwise(out)
    return out


def baseline_alerts(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Relative change of each funnel rate against a baseline summary.

    ``current`` and ``baseline`` are one-row frames with the three rate
    columns.  A zero baseline gives no change; a change of -10 % or less is
    a drop, +10 % or more an increase.
    """
    cur = current.select(*[F.col(k).alias(f"c_{k}") for k in RATE_KEYS])
    base = baseline.select(*[F.col(k).cast("double").alias(f"b_{k}") for k in RATE_KEYS])
    w = zip_one_row(cur, base)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("metric"),
                              F.col(f"c_{k}").alias("current"), F.col(f"b_{k}").alias("baseline"))
                     for i, k in enumerate(RATE_KEYS)])
    r = w.select(F.explode(rows).alias("r")).select("r.*")
    r = r.withColumn("change", _change(F.col("current"), F.col("baseline")))
    return (r.withColumn("status", _status(F.col("change")))
             .withColumn("message", _alert_message(F.col("metric"), F.col("change"))))


def alert_message_cols() -> list[Column]:
    """Alert messages from columns ``<rate>`` (current) and ``b_<rate>``."""
    return [_alert_message(F.lit(k), _change(F.col(k), F.col(f"b_{k}"))) for k in RATE_KEYS]


def rule_message_cols() -> list[Column]:
    """A35/A36 rule messages, in order, from one row of facts.

    Fact columns: view_to_cart, cart_to_purchase, top_10_pct,
    top_20_pct_of_user_revenue, cart_abandonment_sessions,
    potential_revenue_from_abandonment, weekend_conversion_rate,
    weekday_conversion_rate, best_conversion_hour, peak_revenue_month,
    peak_conversion_month, has_loyalty, loyal_user_avg_spend,
    casual_user_avg_spend, total_revenue, zero_spender_share (null when
    the segment is absent).
    """
    c = F.col
    wc, wd = c("weekend_conversion_rate"), c("weekday_conversion_rate")
    premium = (c("loyal_user_avg_spend") / c("casual_user_avg_spend") - 1) * 100
    texts = RULE_TEXTS
    return [
        F.when(c("view_to_cart") < LOW_FUNNEL_ALERT_THRESHOLD, say(texts["low_view_to_cart"], fmt1(c("view_to_cart") * 100))),
        F.when(c("cart_to_purchase") < LOW_FUNNEL_ALERT_THRESHOLD,
               say(texts["low_cart_to_purchase"], fmt1(c("cart_to_purchase") * 100))),
        F.when(c("top_10_pct") > 0.5, say(texts["top_10_users"], fmt1(c("top_10_pct") * 100))),
        F.when(c("top_20_pct_of_user_revenue") > 0, say(texts["top_20_percent"], fmt1(c("top_20_pct_of_user_revenue") * 100))),
        F.when(c("cart_abandonment_sessions") > 0,
               say(texts["abandonment"], c("cart_abandonment_sessions"), fmt_money(c("potential_revenue_from_abandonment")))),
        F.when(wc > wd * 1.1, F.lit(texts["weekend"])).when(wd > wc * 1.1, F.lit(texts["weekday"])),
        F.when(c("best_conversion_hour").isNotNull(), say(texts["best_hour"], c("best_conversion_hour"))),
        F.when(c("peak_revenue_month").isNotNull(), say(texts["revenue_month"], c("peak_revenue_month"))),
        F.when(c("peak_conversion_month").isNotNull(), say(texts["conversion_month"], c("peak_conversion_month"))),
        F.when(c("has_loyalty") & (c("casual_user_avg_spend") > 0), say(texts["loyalty"], fmt1(premium))),
        F.when(c("total_revenue") == 0, F.lit(texts["no_revenue"])),
        F.when(c("zero_spender_share") > 0.8, F.lit(texts["zero_spenders"])),
    ]


def insight_array(with_alerts: bool = False) -> Column:
    """The ordered list of non-null messages as one array column."""
    msgs = (alert_message_cols() if with_alerts else []) + rule_message_cols()
    return F.filter(F.array(*msgs), lambda m: m.isNotNull())


def insight_messages(facts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """A35/A36 as a table (insight_number, insight) from a one-row facts
    frame; with a baseline (one row of the three rates) the alerts come
    first."""
    if baseline is not None:
        facts = zip_one_row(facts, baseline.select(*[F.col(k).cast("double").alias(f"b_{k}") for k in RATE_KEYS]))
    return facts.select(F.posexplode(insight_array(baseline is not None)).alias("position", "insight")).select(
        (F.col("position") + 1).alias("insight_number"), "insight")
