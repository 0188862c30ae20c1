"""Schema checks of inputs, from the schema alone: no job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def panel(df: DataFrame, id_col: str, time_col: str, target_col: str) -> None:
    """ValueError unless ``df`` is a DataFrame with the three columns and a date or timestamp in ``time_col``."""
    if not isinstance(df, DataFrame):
        raise ValueError("a Spark DataFrame is expected")
    missing = [c for c in (id_col, time_col, target_col) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    if not isinstance(df.schema[time_col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise ValueError(f"{time_col} has to be a timestamp or date")


def features(df: DataFrame, columns: list[str] | None = None, keys: list[str] = ()) -> list[str]:
    """Names of the feature columns: those given, or all but the keys; TypeError or ValueError where they don't fit."""
    if not isinstance(df, DataFrame):
        raise TypeError("a Spark DataFrame is expected")
    names = list(columns) if columns else [c for c in df.columns if c not in keys]
    same_columns(df, names)
    return names


def same_columns(df: DataFrame, names: list[str]) -> None:
    """ValueError unless ``df`` has every fitted column."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"fitted columns not found: {', '.join(missing)}")


def finite(df: DataFrame, columns: list[str]) -> None:
    """ValueError if a column of numbers holds NaN or infinity (one aggregate); nulls pass."""
    from pyspark.sql import functions as F

    names = [c for c, kind in df.dtypes if c in columns and kind in ("double", "float")]
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    row = df.agg(F.lit(0), *[F.max(odd(F.col(f"`{c}`"))).alias(c) for c in names]).first().asDict() if names else {}
    wrong = [c for c in names if row[c]]
    if wrong:
        raise ValueError(f"values that are not finite in {', '.join(wrong)}")


def table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read parquet, csv, json or orc."""
    return spark.read.format(fmt).options(**options).load(path)


def transactions(df: DataFrame, tx_col: str, items_col: str) -> DataFrame:
    """Distinct (tx, item) pairs from a column of item lists or from one item a row; null items are dropped."""
    from pyspark.sql import functions as F

    item = F.explode(items_col) if isinstance(df.schema[items_col].dataType, T.ArrayType) else F.col(items_col)
    return df.select(F.col(tx_col).alias("tx"), item.alias("item")).filter("item is not null").distinct()


def synthetic_panel(spark: SparkSession, ids: int, periods: int, seed: int = 42) -> DataFrame:
    """Daily test panel unique_id, ds, y (normal) and category (uniform of five)."""
    from pyspark.sql import functions as F

    rows = spark.range(ids * periods).select((F.col("id") % ids).cast("int").alias("unique_id"), F.timestamp_seconds((F.col("id") / ids).cast("long") * 86400).cast("timestamp_ntz").alias("ds"))
    return rows.withColumn("y", F.randn(seed)).withColumn("category", F.concat(F.lit("c"), (F.rand(seed + 1) * 5).cast("int")))
