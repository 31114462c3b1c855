"""Fixed schemas and the fixed values the analyses depend on."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Raw event log.  event_time arrives as text in CSV and is parsed by the
# cleaning step (bad text becomes null).
EVENTS_RAW_CSV = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("event_time", T.StringType()),
])

EVENT_COLUMNS = [f.name for f in EVENTS_RAW_CSV.fields]

# Event types that always get their own columns in the feature tables
# (absent types give zero columns instead of a missing column).
EVENT_TYPES = ("view", "cart", "purchase")

# Columns of the feature tables and their types; an event type beyond the fixed
# ones adds a column of distinct products.
TYPE_COUNT = "bigint"
_RATES = "double"
FEATURE_COLUMNS: dict[str, dict[str, str]] = {
    "session_features": {
        "user_session": "string", "user_id": "bigint", "category_code": "string", "brand": "string",
        "view_count": "bigint", "cart_count": "bigint", "purchase_count": "bigint",
        "n_unique_brands": "bigint", "n_unique_categories": "bigint",
        "session_started_at": "timestamp_ntz", "session_ended_at": "timestamp_ntz",
        "session_total_spending": "decimal(28,2)", **{f"{t}_unique": TYPE_COUNT for t in EVENT_TYPES},
        "session_duration": "double", "view_to_purchase_rate": _RATES, "is_weekend": "boolean"},
    "user_features": {
        "user_id": "bigint", "user_total_sessions": "bigint", "total_view_count": "bigint", "total_cart_count": "bigint",
        "total_purchase_count": "bigint", "total_unique_purchase_count": "bigint", "total_unique_view_count": "bigint",
        "user_avg_session_duration": "double", "user_total_spending": "decimal(38,2)",
        "user_view_to_purchase_rate": _RATES, "user_purchase_per_session": _RATES},
    "brand_features": {
        "brand": "string", **{t: TYPE_COUNT for t in EVENT_TYPES}, "brand_view_to_purchase_rate": _RATES,
        "purchase_spending": "decimal(38,2)"},
    "category_features": {
        "category_code": "string", **{t: TYPE_COUNT for t in EVENT_TYPES}, "category_view_to_purchase_rate": _RATES,
        "purchase_spending": "decimal(38,2)"},
}

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# ---------------------------------------------------------------------------
ALERT_DROP_PCT = 0.1
LOYALTY_SESSION_CUTOFF = 5
LOW_FUNNEL_ALERT_THRESHOLD = 0.1

MAX_SESSION_DURATION_MINUTES = 120
DURATION_BINS = [-1, 1, 5, 15, 120]
DURATION_LABELS = ["<1min", "1-5min", "5-15min", ">15min"]

TIME_PERIOD_BINS = [-1, 6, 12, 18, 24]
TIME_PERIOD_LABELS = ["Night", "Morning", "Afternoon", "Evening"]

ORDER_VALUE_BINS = [0, 25, 100, 500, float("inf")]
ORDER_VALUE_LABELS = ["Small", "Medium", "Large", "Premium"]

ACTIVITY_LEVEL_BINS = [-1, 1, 5, 10, float("inf")]
ACTIVITY_LEVEL_LABELS = ["One-time", "Casual", "Regular", "Power"]

SPENDING_SEGMENT_LABELS = ["Low Nonzero", "Mid Nonzero", "High Nonzero", "Top Nonzero"]
ZERO_SPENDER = "Zero Spender"

MIN_VIEWS_FOR_HIGH_QUALITY = 3
MIN_BRANDS_FOR_HIGH_QUALITY = 1

REVENUE_QUINTILE_LABELS = ["Bottom 20%", "Low 20%", "Middle 20%", "High 20%", "Top 20%"]

HIGH_CONVERTING_BRAND_THRESHOLD = 0.1

# Cleaning: event hour -> period, left-closed [0,6) [6,12) [12,18) [18,24).
EVENT_PERIOD_BINS = [0, 6, 12, 18, 24]
EVENT_PERIOD_LABELS = ["night", "morning", "afternoon", "evening"]

# Dashboard periods on event hours (< 6, < 12, < 18, else).
DASH_PERIOD_LABELS = ["Night", "Morning", "Afternoon", "Evening"]

# Lifetime-value tiers.
LTV_TIER_LABELS = ["Bronze", "Silver", "Gold", "Platinum", "Diamond"]
LTV_SMALL_LABELS = ["Low", "Medium", "High"]

# Report session buckets (minutes, then event counts as a fallback).
REPORT_SESSION_BINS = [0, 1, 5, 15, float("inf")]
REPORT_EVENT_BINS = [0, 2, 5, 10, float("inf")]
REPORT_SESSION_LABELS = ["Quick", "Short", "Medium", "Long"]
