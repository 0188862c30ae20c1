"""Association measures of items in transactions, from one count per item and one per pair of the items asked for."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import ratio
from ..functions.ship import ship
from ..functions.special import hypergeom_sf
from ..sources import validate


class TransactionEncoder:
    """Long, distinct (tx, item) rows are the sparse form of the one-hot matrix; the dense one is pivoted."""

    def __init__(self):
        self.items: list | None = None

    def fit(self, df: DataFrame, tx_col: str = "tx", items_col: str = "item") -> TransactionEncoder:
        rows = validate.transactions(df, tx_col, items_col)
        self.items = [r["item"] for r in rows.select("item").distinct().orderBy("item").collect()]  # the one-hot matrix's column names
        return self

    def transform(self, df: DataFrame, tx_col: str = "tx", items_col: str = "item", sparse: bool = False) -> DataFrame:
        if self.items is None:
            raise ValueError("fit before transforming")
        rows = validate.transactions(df, tx_col, items_col)
        unknown = rows.filter(~F.col("item").isin(self.items)).select("item").take(1)
        if unknown:
            raise KeyError(unknown[0]["item"])
        if sparse:
            return rows
        return rows.groupBy("tx").pivot("item", self.items).agg(F.lit(True)).na.fill(False)

    def inverse_transform(self, onehot: DataFrame) -> DataFrame:
        """tx, items: sorted lists again."""
        cells = F.array(*[F.when(F.col(f"`{i}`"), F.lit(i)) for i in self.items])
        return onehot.select("tx", F.filter(cells, lambda x: x.isNotNull()).alias("items"))

    def fit_transform(self, df: DataFrame, **options) -> DataFrame:
        return self.fit(df, **options).transform(df, **options)


def _hypergeom():
    return F.udf(lambda k, n, a, c: None if k is None else hypergeom_sf(k - 1, n, a, c), "double")  # one call a pair of items


def metrics(n: Column, a: Column, c: Column, ac: Column) -> dict[str, Column]:
    """Measures of antecedent count a, consequent count c and joint count ac among n transactions."""
    sa, sc, s = (ratio(x, n) for x in (a, c, ac))
    ca, cc = ratio(ac, a), ratio(ac, c)
    odds = ratio(ac * (n - a - c + ac), (a - ac) * (c - ac))
    gain = s - sa * sc
    return {
        "lift": F.coalesce(ratio(s, sa * sc), F.lit(0.0)),
        "confidence": ca,
        "kulczynski": (ca + cc) / 2,
        "sorensen_dice": F.when((ca > 0) & (cc > 0), 2 * ca * cc / (ca + cc)).otherwise(0.0),
        "zhang": F.coalesce(ratio(gain, F.greatest(s * (1 - sa), sa * (sc - s))), F.lit(0.0)),
        "yules_q": ratio(odds - 1, odds + 1),  # NULL (not a number) where nothing is left off the diagonal
    }


class TransactionAnalyzer:
    METRICS = ("lift", "confidence", "kulczynski", "sorensen_dice", "zhang", "yules_q", "hypergeom")

    def __init__(self):
        self.pairs: DataFrame | None = None

    def fit(self, df: DataFrame, tx_col: str = "tx", items_col: str = "item") -> TransactionAnalyzer:
        rows = validate.transactions(df, tx_col, items_col)
        self.rows, self.items = rows, rows.groupBy("item").agg(F.count("*").alias("n"))
        self.size = rows.select("tx").distinct().count()
        self.pairs = rows
        return self

    def _need(self) -> None:
        if self.pairs is None:
            raise ValueError("fit first")

    def transform(self) -> DataFrame:
        """item, n, support."""
        self._need()
        return self.items.select("item", "n", (F.col("n") / F.lit(self.size)).alias("support"))

    def counts(self, rows: list, columns: list) -> DataFrame:
        """a, c, na, nc, nac, n of the cross product of two lists of items."""
        self._need()
        wanted = list(dict.fromkeys([*rows, *columns]))
        known = {r["item"]: r["n"] for r in self.items.filter(F.col("item").isin(wanted)).collect()}  # as many as were asked for
        missing = [x for x in wanted if x not in known]
        if missing:
            raise KeyError(missing[0])
        left = self.rows.filter(F.col("item").isin(list(rows))).select("tx", F.col("item").alias("a"))
        right = self.rows.filter(F.col("item").isin(list(columns))).select("tx", F.col("item").alias("c"))
        joint = left.join(right, "tx").groupBy("a", "c").agg(F.count("*").alias("nac"))
        spark = self.rows.sparkSession
        grid = spark.createDataFrame([(a, c, known[a], known[c]) for a in rows for c in columns], ["a", "c", "na", "nc"])
        return grid.join(F.broadcast(joint), ["a", "c"], "left").na.fill(0, ["nac"]).withColumn("n", F.lit(self.size).cast("long"))  # at most rows x columns

    def association(self, rows: list, columns: list) -> DataFrame:
        """a, c and all measures."""
        found = self.counts(rows, columns)
        made = metrics(*[F.col(x) for x in ("n", "na", "nc", "nac")])
        return ship(found).select("a", "c", *[v.alias(k) for k, v in made.items()], _hypergeom()("nac", "n", "na", "nc").alias("hypergeom"))

    def correlation_matrix(self, row_items: list, column_items: list, metric: str = "lift", wide: bool = False) -> DataFrame:
        """a, c, value in item order, or a row per ``a`` and a column per ``c``."""
        if metric not in self.METRICS:
            raise ValueError(f"metric is one of {', '.join(self.METRICS)}")
        long = self.association(row_items, column_items).select("a", "c", F.col(metric).alias("value"))
        if not wide:
            return long
        return long.groupBy("a").pivot("c", sorted(column_items)).agg(F.first("value")).orderBy("a")

    def __getattr__(self, name: str):
        if name in ("lift", "confidence", "kulczynski", "sorensen_dice", "zhang", "yules_q", "hypergeom", "zhang_metric"):
            metric = "zhang" if name == "zhang_metric" else name
            return lambda a, c: self.association([a], [c]).first()[metric]
        raise AttributeError(name)

    def save(self, path: str) -> None:
        """Write transactions as Parquet and the size as JSON; nothing is pickled."""
        self._need()
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.rows.sparkSession.createDataFrame([(json.dumps({"size": self.size}),)], ["value"]).coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TransactionAnalyzer:
        out = cls()
        out.rows = out.pairs = spark.read.parquet(f"{path}/rows")
        out.items = out.rows.groupBy("item").agg(F.count("*").alias("n"))
        out.size = json.loads(spark.read.text(f"{path}/params").first()["value"])["size"]
        return out
