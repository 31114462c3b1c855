"""Report assembly: the ten sheets in their order, from one context.

Sheets are the registered queries' plans, presented as everywhere else;
``write_full_report`` writes one table per sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.plans import catalog
from shopflow.plans.context import ShopContext
from shopflow.sources.summary import write_report

# Sheet names in order, with the query each one shows and the
# column it is sorted by, largest first.
SHEETS = [
    ("📋 Executive Summary", "executive_summary", None),
    ("👥 User Analysis", "report_users", "user_total_spending"),
    ("📊 Session Analysis", "report_sessions", "session_total_spending"),
    ("🏷️ Brand Performance", "report_brands", "efficiency_score"),
    ("📂 Category Performance", "report_categories", "efficiency_score"),
    ("🏆 Top Brands", "report_top_brands", "efficiency_score"),
    ("📈 Top Categories", "report_top_categories", "efficiency_score"),
    ("⏰ Temporal Analysis", "temporal_union", None),
    ("💡 Revenue Recovery", "recovery_report", None),
    ("🧠 Business Insights", "numbered_insights", None),
]


def build_report(ctx: ShopContext) -> dict[str, DataFrame]:
    """Sheet name -> table, in the report's order."""
    catalog.spark_queries()
    out = {}
    for sheet, name, by in SHEETS:
        df = catalog.finish(catalog.REGISTRY[name].build(ctx))
        out[sheet] = df.orderBy(F.col(by).desc_nulls_last(), *[c for c in df.columns[:1] if c != by]) if by else df
    return out


def write_full_report(ctx: ShopContext, output_dir: str, tag: str, fmt: str = "parquet") -> dict[str, str]:
    return write_report(build_report(ctx), output_dir, tag, fmt)


def sheet_index(ctx: ShopContext) -> DataFrame:
    """One row per sheet: its position, name and number of rows."""
    rows = None
    for position, (sheet, df) in enumerate(build_report(ctx).items(), 1):
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(position).alias("position"), F.lit(sheet).alias("sheet"), "n_rows")
        rows = row if rows is None else rows.unionByName(row)
    return rows
