"""Brand and category performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.numeric import mean_exact
from shopflow.functions.text import leaf_name
from shopflow.operators.common import requires, top_k, zip_one_row
from shopflow.schema import HIGH_CONVERTING_BRAND_THRESHOLD


def with_efficiency(df: DataFrame, rate: str) -> DataFrame:
    """score = rate x purchase spending."""
    return df.withColumn("efficiency_score", F.col(rate) * F.col("purchase_spending").cast("double"))


@requires(brands=["brand", "purchase_spending", "brand_view_to_purchase_rate"])
def top_brands(brands: DataFrame, k: int = 10) -> DataFrame:
    """A16."""
    return top_k(brands, "purchase_spending", k, "brand").select(
        "brand", "purchase_spending", "brand_view_to_purchase_rate")


@requires(brands=["brand", "purchase_spending", "brand_view_to_purchase_rate"])
def efficient_brands(brands: DataFrame, k: int = 5) -> DataFrame:
    """A19."""
    return top_k(with_efficiency(brands, "brand_view_to_purchase_rate"), "efficiency_score", k, "brand") \
        .select("brand", "efficiency_score")


@requires(categories=["category_code", "purchase_spending", "category_view_to_purchase_rate"])
def top_categories(categories: DataFrame, k: int = 5) -> DataFrame:
    """A20."""
    return top_k(categories, "purchase_spending", k, "category_code").select(
        "category_code", "purchase_spending", "category_view_to_purchase_rate")


@requires(categories=["category_code", "purchase_spending", "category_view_to_purchase_rate"])
def efficient_categories(categories: DataFrame, k: int = 3) -> DataFrame:
    """A22."""
    return top_k(with_efficiency(categories, "category_view_to_purchase_rate"), "efficiency_score", k,
                 "category_code").select("category_code", "efficiency_score")


@requires(brands=["brand_view_to_purchase_rate"], categories=["category_view_to_purchase_rate"])
def product_averages(brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Unweighted mean rates and the high-converting count."""
    return zip_one_row(
        brands.agg(mean_exact(F.col("brand_view_to_purchase_rate")).alias("avg_brand_conversion"),
                   F.count_if(F.col("brand_view_to_purchase_rate") > HIGH_CONVERTING_BRAND_THRESHOLD)
                   .alias("high_converting_brands_count")),
        categories.agg(mean_exact(F.col("category_view_to_purchase_rate")).alias("avg_category_conversion")),
    )


def with_leaf(categories: DataFrame) -> DataFrame:
    return categories.withColumn("category_display", leaf_name(F.col("category_code")))
