"""Report tables (one DataFrame per sheet)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.functions.buckets import cut
from shopflow.functions.text import leaf_name
from shopflow.operators.binning import OrderStatistics, index_of, qcut_column
from shopflow.operators.products import with_efficiency
from shopflow.operators.retention import SPEND, _fits, _tier_plan
from shopflow.schema import REPORT_EVENT_BINS, REPORT_SESSION_BINS, REPORT_SESSION_LABELS

# Executive summary rows (category, metric, source column, description).
EXECUTIVE_ROWS = [
    ("📊 Funnel Metrics", "Total Sessions", "total_sessions", "Total number of user sessions"),
    ("📊 Funnel Metrics", "Sessions with Views", "sessions_with_views", "Sessions that included product views"),
    ("📊 Funnel Metrics", "Sessions with Carts", "sessions_with_carts", "Sessions where items were added to cart"),
    ("📊 Funnel Metrics", "Sessions with Purchases", "sessions_with_purchases", "Sessions that resulted in purchases"),
    ("📊 Funnel Metrics", "View to Cart Rate", "view_to_cart", "Conversion rate from views to cart additions"),
    ("📊 Funnel Metrics", "View to Purchase Rate", "view_to_purchase", "Conversion rate from views to purchases"),
    ("💰 Revenue Metrics", "Total Revenue", "total_revenue", "Total revenue generated"),
    ("💰 Revenue Metrics", "Average Order Value", "avg_order_value", "Average spending per purchase"),
    ("💰 Revenue Metrics", "Revenue Generating Sessions", "revenue_generating_sessions",
     "Number of sessions that generated revenue"),
    ("💰 Revenue Metrics", "Cart Abandonment Sessions", "cart_abandonment_sessions",
     "Sessions with cart items but no purchase"),
    ("💰 Revenue Metrics", "Potential Recovery Revenue", "potential_revenue_from_abandonment",
     "Estimated revenue from abandoned carts"),
    ("👥 Customer Insights", "Loyal Users", "loyal_user_count", "Users with repeat purchase behavior"),
    ("👥 Customer Insights", "Casual Users", "casual_user_count", "Users with infrequent purchases"),
    ("👥 Customer Insights", "Loyal User Avg Spend", "loyal_user_avg_spend", "Average spending of loyal customers"),
    ("👥 Customer Insights", "Casual User Avg Spend", "casual_user_avg_spend", "Average spending of casual customers"),
    ("⏰ Temporal Insights", "Weekend Conversion Rate", "weekend_conversion_rate", "Conversion rate during weekends"),
    ("⏰ Temporal Insights", "Weekday Conversion Rate", "weekday_conversion_rate", "Conversion rate during weekdays"),
    ("⏰ Temporal Insights", "Best Conversion Hour", "best_conversion_hour", "Hour with highest conversion rate"),
    ("⏰ Temporal Insights", "Peak Revenue Month", "peak_revenue_month", "Month with highest revenue"),
]
# Loyalty values read 0 when the cohorts are missing; temporal peaks read N/A (null).
_ZERO_DEFAULT = {"loyal_user_count", "casual_user_count", "loyal_user_avg_spend", "casual_user_avg_spend"}


def executive_summary(wide: DataFrame) -> DataFrame:
    """19 rows (Category, Metric, Value, Description) from one wide row."""
    structs = []
    for i, (cat, metric, col, desc) in enumerate(EXECUTIVE_ROWS, 1):
        v = F.col(col).cast("double")
        if col in _ZERO_DEFAULT:
            v = F.coalesce(v, F.lit(0.0))
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(cat).alias("Category"),
                                F.lit(metric).alias("Metric"), v.alias("Value"), F.lit(desc).alias("Description")))
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def report_ltv_column(users: DataFrame, index: OrderStatistics | None = None):
    """E2's tiering: as R1, but the fallback is <= q33 Low, <= q67 Medium, else High."""
    index = index_of(users, SPEND, index)
    n, labels, edges = _tier_plan(index)
    spend = F.col(SPEND)
    if _fits(edges):
        return qcut_column(spend, edges, labels)
    if index.most is None:
        return F.lit(None).cast("string")
    if index.most == 0:
        return F.lit("No Spending")
    q33, q67 = index.quantiles([0.33, 0.67])
    v = spend.cast("double")
    return F.when(v <= q33, "Low").when(v <= q67, "Medium").when(v > q67, "High").otherwise("Low")


def report_users(users: DataFrame, k: int | None = 1000, index: OrderStatistics | None = None) -> DataFrame:
    """Users with LTV tier, top ``k`` by spend (the sheet's size)."""
    out = users.withColumn("ltv_segment", report_ltv_column(users, index)).orderBy(
        F.col(SPEND).desc(), F.col("user_id").asc())
    return out.limit(k) if k else out


def session_quality_bucket(sessions: DataFrame):
    """Duration buckets in minutes (0 -> null), else event-count
    buckets, else 'Standard', depending on the available columns."""
    cols = set(sessions.columns)
    if "session_duration_minutes" in cols or "session_duration" in cols:
        minutes = (F.col("session_duration_minutes") if "session_duration_minutes" in cols
                   else F.col("session_duration") / 60)
        return cut(minutes, REPORT_SESSION_BINS, REPORT_SESSION_LABELS, right=True)
    if "n_events" in cols:
        return cut(F.col("n_events"), REPORT_EVENT_BINS, REPORT_SESSION_LABELS, right=True)
    return F.lit("Standard")


def report_sessions(sessions: DataFrame, k: int | None = 1000) -> DataFrame:
    """Sessions with a quality bucket, top ``k`` by spend."""
    s = sessions
    if "session_duration_minutes" not in s.columns and "session_duration" in s.columns:
        s = s.withColumn("session_duration_minutes", F.col("session_duration") / 60)
    s = s.withColumn("session_quality", session_quality_bucket(s))
    sort_col = next((c for c in ["session_total_spending", "total_spending", "spending", "revenue"]
                     if c in s.columns), None)
    if sort_col is None:
        numeric = [f.name for f in s.schema.fields if isinstance(f.dataType, T.NumericType)]
        sort_col = numeric[0] if numeric else "user_session"
    out = s.orderBy(F.col(sort_col).desc(), F.col("user_session").asc())
    return out.limit(k) if k else out


def report_brands(brands: DataFrame) -> DataFrame:
    """Every brand with its efficiency score, best first."""
    return with_efficiency(brands, "brand_view_to_purchase_rate").orderBy(
        F.col("efficiency_score").desc(), F.col("brand").asc())


def report_categories(categories: DataFrame) -> DataFrame:
    """E5: every category with display name and efficiency score."""
    return with_efficiency(categories.withColumn("category_display", leaf_name(F.col("category_code"))),
                           "category_view_to_purchase_rate").orderBy(
        F.col("efficiency_score").desc(), F.col("category_code").asc())


def temporal_union(periods: DataFrame, hourly: DataFrame, quarterly: DataFrame) -> DataFrame:
    """Periods, hours and quarters in one shape (hourly has no spend -> 0)."""
    p = periods.select(F.lit("Time Period").alias("Analysis_Type"), F.col("time_period").alias("Period"),
                       F.col("user_session").alias("Sessions"),
                       F.col("view_to_purchase_rate").alias("Conversion_Rate"),
                       F.col("session_total_spending").cast("double").alias("Total_Spending"))
    h = hourly.select(F.lit("Hourly").alias("Analysis_Type"),
                      F.concat(F.lit("Hour "), F.col("hour").cast("string")).alias("Period"),
                      F.col("user_session").alias("Sessions"),
                      F.col("view_to_purchase_rate").alias("Conversion_Rate"),
                      F.lit(0.0).alias("Total_Spending"))
    q = quarterly.select(F.lit("Quarterly").alias("Analysis_Type"),
                         F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("Period"),
                         F.col("user_session").alias("Sessions"),
                         F.col("view_to_purchase_rate").alias("Conversion_Rate"),
                         F.col("session_total_spending").cast("double").alias("Total_Spending"))
    return p.unionByName(h).unionByName(q)


def _dollars(x) -> object:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def recovery_report(abandonment: DataFrame, loyalty: DataFrame) -> DataFrame:
    """Cart recovery row, plus the casual-to-loyal row when cohorts exist."""
    pot = F.col("potential_revenue_from_abandonment")
    cart = abandonment.select(
        F.lit(1).alias("position"),
        F.lit("Cart Abandonment Recovery").alias("Opportunity_Type"),
        F.concat(F.format_number(F.col("cart_abandonment_sessions"), 0), F.lit(" abandoned carts")).alias("Current_State"),
        F.concat(_dollars(pot), F.lit(" potential revenue")).alias("Potential_Impact"),
        _dollars(pot * 0.25).alias("Recovery_at_25%"), _dollars(pot * 0.5).alias("Recovery_at_50%"),
        F.lit("High").alias("Priority"))
    up = F.col("casual_user_count") * (F.col("loyal_user_avg_spend") - F.col("casual_user_avg_spend"))
    loyal = loyalty.select(
        F.lit(2).alias("position"),
        F.lit("Casual to Loyal Upgrade").alias("Opportunity_Type"),
        F.concat(F.format_number(F.col("casual_user_count"), 0), F.lit(" casual users")).alias("Current_State"),
        F.concat(_dollars(up), F.lit(" if upgraded to loyal spending")).alias("Potential_Impact"),
        _dollars(up * 0.25).alias("Recovery_at_25%"), _dollars(up * 0.5).alias("Recovery_at_50%"),
        F.lit("Medium").alias("Priority"))
    return cart.unionByName(loyal)


def numbered_insights(insight_list: DataFrame) -> DataFrame:
    """1-based insight table."""
    return insight_list.select(F.col("insight_number").alias("Insight_Number"),
                               F.col("insight").alias("Business_Insight"))
