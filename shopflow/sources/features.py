"""IO3/IO6 feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.operators.common import require_columns
from shopflow.schema import FEATURE_COLUMNS, TYPE_COUNT

FEATURE_TABLES = tuple(FEATURE_COLUMNS)


def write_features(tables: dict[str, DataFrame], base: str) -> None:
    """IO6: overwrite each feature table under ``base/data/features``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/data/features/{name}")


def read_features(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """IO3: the four feature tables in their fixed types.

    Whatever the files' own types are, every known column is read as
    ``FEATURE_COLUMNS`` says (times stored as text are parsed, unparseable
    ones null) and columns of further event types as counts; a missing column
    raises.
    """
    return {name: conform(spark.read.parquet(f"{base.rstrip('/')}/data/features/{name}"), name) for name in FEATURE_TABLES}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the fixed columns and types of feature table ``name``."""
    fixed = FEATURE_COLUMNS[name]
    require_columns(df, fixed, name)

    def typed(field: T.StructField):
        c, want = F.col(f"`{field.name}`"), fixed.get(field.name, TYPE_COUNT)
        if field.dataType.simpleString() == want:
            return c
        if want == "timestamp_ntz" and isinstance(field.dataType, T.StringType):
            return F.try_to_timestamp(c).cast(want).alias(field.name)
        return c.cast(want).alias(field.name)
    return df.select(*[typed(f) for f in df.schema.fields])
