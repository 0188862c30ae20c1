"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, NULL where b is 0 or NULL."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as NULL, no negative zero: what results are compared by."""
    fix = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), digits) + F.lit(0.0)
    return df.select(*[fix(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and its grouping columns; a constant one where there is none."""
    return (df, by) if by else (df.withColumn("_all", F.lit(1)), ["_all"])
