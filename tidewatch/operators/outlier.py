"""Outlier scores from histograms (HBOS), interval bins (SPAD, SPAD+) and principal components.

fit() runs a few aggregates over all features at once and keeps a small model: edges and densities per feature. Scores
are row-wise expressions over literal arrays, so scoring is a single narrow stage.

``compat=True`` follows the widely used definition to the letter: all features take the bin count of the first feature, of any kind, and
SPAD's probabilities are those of non-empty bins only, looked up by bin number. ``compat=False`` counts bins for each
feature and keeps empty ones in place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources import validate
from .intervals import count_below, exact_quantiles, whole_bounds, whole_order_statistic

STRATEGIES = ("auto", "fd", "doane", "scott", "stone", "rice", "sturges", "sqrt")
_TINY = 1e-9
#: So many values of a categorical feature, the most frequent ones, are sent to all executors; rows of others are joined by a
#: shuffle, where none of them is frequent.
HELD = 10_000
_SALTS = 1024
#: Up to so many combinations of bins are counted as such.
COMBINATIONS = 100_000


def bin_counts(df: DataFrame, columns: list[str], nbins: int | str) -> dict[str, int]:
    """Number of equal bins for each column: given, or by one of numpy's rules from one aggregate."""
    if isinstance(nbins, bool) or not isinstance(nbins, (int, str)):
        raise ValueError("nbins is a positive integer or a rule's name")
    if isinstance(nbins, int):
        if nbins <= 0:
            raise ValueError("nbins is positive")
        return {c: nbins for c in columns}
    if nbins not in STRATEGIES:
        raise ValueError(f"nbins is an integer or one of {', '.join(STRATEGIES)}")
    v = [F.col(c).cast("double") for c in columns]
    aggs = [a.alias(f"{n}{k}") for k, x in enumerate(v) for n, a in (("n", F.count(x)), ("lo", F.min(x)), ("hi", F.max(x)), ("s", F.stddev_pop(x)), ("g", F.skewness(x)))]
    row = df.agg(*aggs).first()
    kinds = dict(df.dtypes)
    out = {}
    for k, c in enumerate(columns):
        n, span = row[f"n{k}"], (row[f"hi{k}"] or 0.0) - (row[f"lo{k}"] or 0.0)
        if not n or span == 0:
            out[c] = 1
            continue
        q = exact_quantiles(df, c, [0.25, 0.75]) if nbins in ("auto", "fd") else (0.0, 0.0)
        fd, sturges = 2 * (q[1] - q[0]) * n ** (-1 / 3), span / (math.log2(n) + 1)
        if nbins == "stone":
            out[c] = _stone(df, c, n, row[f"lo{k}"], span)
            continue
        if nbins == "doane":
            sg = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else 0.0
            width = span / (1 + math.log2(n) + math.log2(1 + abs(row[f"g{k}"] or 0.0) / sg)) if sg > 0 and row[f"s{k}"] > 0 else 0.0
        else:
            width = {"auto": min(fd, sturges) if fd else sturges, "fd": fd, "sturges": sturges, "rice": span / (2 * n ** (1 / 3)), "sqrt": span / math.sqrt(n), "scott": (24 * math.sqrt(math.pi) / n) ** (1 / 3) * row[f"s{k}"]}[nbins]
        if kinds[c] in ("tinyint", "smallint", "int", "bigint") and width < 1:
            width = 1
        out[c] = max(1, math.ceil(span / width)) if width else 1
    return out


def _stone(df: DataFrame, column: str, n: int, lo: float, span: float) -> int:
    """The count with the least estimated squared error. A task counts all candidates over its own values and returns the
    cells that are not empty, at most ``top`` squared over 2, so no row is multiplied in the engine."""
    top = max(100, int(math.sqrt(n)))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = {k: np.zeros(k, np.int64) for k in range(1, top + 1)}
        for batch in batches:
            x = (batch.column("x").to_numpy(zero_copy_only=False) - lo) / span
            for k, own in held.items():
                own += np.bincount(np.minimum(k - 1, np.floor(x * k)).astype(np.int64), minlength=k)
        for k, own in held.items():
            b = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(b), k, np.int64)), "b": pa.array(b), "n": pa.array(own[b])})

    rows = ship(df).select(F.col(column).cast("double").alias("x")).filter("x is not null").mapInArrow(count, "k long, b long, n long")
    sums = rows.groupBy("k", "b").agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum((F.col("n") / n) ** 2).alias("p")).collect()  # ``top`` rows
    return min((r["k"] / span * (2 - (n + 1) * r["p"]), r["k"]) for r in sums)[1] if n > 1 else 1


def _literal(values) -> Column:
    return F.lit([float(v) for v in values])


def histogram_bin(x: Column, edges) -> Column:
    """0-based bin by half-open bins, the last one closed."""
    return F.least(count_below(x, edges, True) - 1, F.lit(len(edges) - 2))


def edges_below(x: Column, edges) -> Column:
    """Number of edges strictly below x."""
    return count_below(x, edges)


def _score_limit(scores: DataFrame, quantile: float) -> float | None:
    """The quantile (higher rank) of a column ``score``, which is worked out once for all rounds of the selection."""
    scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return whole_order_statistic(scores, "score", quantile, "higher")
    finally:
        scores.unpersist()


def _over(score: Column, limit: float | None, digits: int | None) -> Column:
    at = F.lit(limit).cast("double")
    return score > at if digits is None else F.round(score, digits) > F.round(at, digits)


class _Binned:
    def __init__(self):
        self.fitted = None

    def _check(self, df: DataFrame, features: list[str] | None, categorical: list[str]) -> list[str]:
        names = validate.features(df, features)
        unknown = [c for c in categorical if c not in names]
        if unknown:
            raise ValueError(f"categorical columns are no features: {', '.join(unknown)}")
        validate.finite(df, names)
        return names

    @staticmethod
    def _bin_counts(df: DataFrame, names: list[str], numeric: list[str], nbins: int | str, compat: bool) -> dict[str, int]:
        """Bins of the numeric features; with ``compat`` all take the count of the first feature of any kind, unless that
        one is no number."""
        if not numeric:
            return {}
        first = names[0] if df.schema[names[0]].dataType.typeName() not in ("string", "boolean") else numeric[0]
        found = bin_counts(df, [first] if compat else numeric, nbins)
        return {c: found[first] if compat else found[c] for c in numeric}

    def _categories(self, df: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, DataFrame | None]]:
        """Laplace-smoothed frequency of each value: of the HELD most frequent ones, and of the rest, if there is any."""
        out = {}
        for c in columns:
            counts = df.select(F.col(c).alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("n"))
            top = counts.orderBy(F.desc("n"), "_v").limit(HELD + 1).toArrow()  # keeps types as they are
            whole = top.num_rows <= HELD
            held = df.sparkSession.createDataFrame(top.slice(0, HELD), counts.schema)
            t, k = (sum(top["n"].to_pylist()), top.num_rows) if whole else counts.agg(F.sum("n"), F.count("*")).first()
            smooth = lambda rows: rows.select("_v", ((F.col("n") + 1) / F.lit(t + k)).alias("_p"))  # noqa: B023, E731
            out[c] = smooth(held), None if whole else smooth(counts.join(F.broadcast(held.select("_v")), "_v", "left_anti"))
        return out

    def _with_probability(self, df: DataFrame, c: str, name: str) -> DataFrame:
        """``df`` with the frequency of its value of ``c``, NULL where that is unknown. All rows of a frequent value would
        meet in one task of a shuffled join, so these take theirs from a broadcast of at most HELD rows, and keys that
        need no join are spread."""
        held, rest = self.fitted["categories"][c]
        out = df.join(F.broadcast(held.withColumnsRenamed({"_v": f"{name}v", "_p": name})), F.col(c) == F.col(f"{name}v"), "left")
        if rest is None:
            return out.drop(f"{name}v")
        cold = F.col(name).isNull() & F.col(c).isNotNull()
        out = out.withColumns({f"{name}c": F.when(cold, F.col(c)), f"{name}s": F.when(cold, F.lit(-1).cast("long")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)))})
        rest = rest.select(F.col("_v").alias(f"{name}w"), F.col("_p").alias(f"{name}q"), F.lit(-1).cast("long").alias(f"{name}t"))
        out = out.join(rest, (F.col(f"{name}c") == F.col(f"{name}w")) & (F.col(f"{name}s") == F.col(f"{name}t")), "left")
        return out.withColumn(name, F.coalesce(name, f"{name}q")).drop(*[name + x for x in "vcswqt"])

    def _bin_totals(self, df: DataFrame, cells: dict[str, Column], edges: dict[str, list]) -> dict[str, dict[int, int]]:
        """Rows per bin of every numeric feature, features x bins rows at most. Where there are few combinations of bins,
        these are counted first, so that no row is multiplied."""
        if not cells:
            return {}
        few = math.prod(len(edges[c]) + 1 for c in cells) <= COMBINATIONS
        rows = df.select(*[b.alias(f"b{i}") for i, b in enumerate(cells.values())])
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")) if few else rows.withColumn("n", F.lit(1))
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"b{i}").alias("b")) for i, c in enumerate(cells)])).alias("z"), "n")
        out: dict[str, dict[int, int]] = {c: {} for c in cells}
        for r in long.groupBy("z.f", "z.b").agg(F.sum("n").alias("n")).collect():
            out[r["f"]][r["b"]] = r["n"]
        return out

    def _numeric_score(self, c: str) -> Column:
        values, edges = self.fitted["bins"][c]
        x = F.col(c).cast("double")
        at = F.greatest(F.lit(0), F.least(edges_below(x, edges) - 1, F.lit(len(values) - 1)))
        return -F.log(F.get(_literal(values), at) + _TINY)

    def decision_function(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with its outlier score: the sum over features of the self-information; higher is more anomalous."""
        if not self.fitted:
            raise ValueError("fit before scoring")
        validate.same_columns(df, self.fitted["features"])
        out, parts, extra = df, [], []
        for k, c in enumerate(self.fitted["features"]):
            if c in self.fitted["categories"]:
                out = self._with_probability(out, c, f"_p{k}")
                parts.append(-F.log(F.coalesce(F.col(f"_p{k}"), F.lit(_TINY)) + _TINY))
                extra.append(f"_p{k}")
            else:
                parts.append(self._numeric_score(c))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return out.withColumn(name, total).drop(*extra)

    def _training(self) -> DataFrame:
        return self.decision_function(self.fitted["training"]).select("score")

    def predict(self, df: DataFrame, quantile: float = 0.99, digits: int | None = None) -> DataFrame:
        """decision_function() and outlier: whether the score is over the quantile (higher rank) of training scores.
        ``digits``: scores that are equal so far count as equal."""
        if not self.fitted:
            raise ValueError("fit before predicting")
        limit = _score_limit(self._training(), quantile)
        return self.decision_function(df).withColumn("outlier", _over(F.col("score"), limit, digits))


class HBOS(_Binned):
    """Histogram-based outlier score. ``dynamic_bins``: edges are percentiles."""

    def __init__(self, dynamic_bins: bool = False, compat: bool = True):
        super().__init__()
        self.dynamic_bins, self.compat = dynamic_bins, compat

    def fit(self, df: DataFrame, features: list[str] | None = None, categorical: list[str] = (), nbins: int | str = "auto") -> HBOS:
        names = self._check(df, features, categorical)
        numeric = [c for c in names if c not in categorical]
        n = self._bin_counts(df, names, numeric, nbins, self.compat)
        v = {c: F.col(c).cast("double") for c in numeric}
        if self.dynamic_bins:
            edges = {c: sorted(set(exact_quantiles(df, c, np.linspace(0, 1, n[c] + 1).tolist()))) for c in numeric}
        else:
            row = df.agg(*[a.alias(f"{k}{i}") for i, x in enumerate(v.values()) for k, a in (("lo", F.min(x)), ("hi", F.max(x)))]).first() if v else {}
            edges = {}
            for i, c in enumerate(numeric):
                lo, hi = row[f"lo{i}"], row[f"hi{i}"]
                lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
                edges[c] = [lo + k * ((hi - lo) / n[c]) for k in range(n[c])] + [hi]
        edges = {c: e if len(e) > 1 else [e[0] - 0.5, e[0] + 0.5] for c, e in edges.items()}
        totals = self._bin_totals(df, {c: histogram_bin(v[c], edges[c]) for c in numeric}, edges)
        bins = {}
        for c in numeric:
            size = sum(totals[c].values())
            bins[c] = ([totals[c].get(k, 0) / (size * (b - a)) for k, (a, b) in enumerate(zip(edges[c], edges[c][1:]))], edges[c])
        self.fitted = {"features": names, "bins": bins, "categories": self._categories(df, list(categorical)), "training": df}
        return self


class SPAD(_Binned):
    """Probabilities of bins over a statistical interval. ``plus``: principal components are features as well."""

    def __init__(self, plus: bool = False, compat: bool = True):
        super().__init__()
        self.plus, self.compat, self.components = plus, compat, None

    def fit(self, df: DataFrame, features: list[str] | None = None, categorical: list[str] = (), nbins: int | str = "auto", method="auto") -> SPAD:
        names = self._check(df, features, categorical)
        source = names
        if self.plus:
            self.components = Components().fit(df, names)
            df = self.components.transform(df)
            names = names + self.components.names
        numeric = [c for c in names if c not in categorical]
        counts = self._bin_counts(df, names, numeric, nbins, self.compat)
        edges = {}
        for c, (lo, hi) in whole_bounds(df, numeric, method).items():
            edges[c] = [lo + k * ((hi - lo) / counts[c]) for k in range(counts[c])] + [hi]
        totals = self._bin_totals(df, {c: edges_below(F.col(c).cast("double"), edges[c]) for c in numeric}, edges)
        bins = {}
        for c in numeric:
            got = totals[c]
            size = sum(got.values())
            if self.compat:
                bins[c] = ([(got[k] + 1) / (size + len(got)) for k in sorted(got)], edges[c])
            else:
                n = len(edges[c]) - 1
                inside = [got.get(k, 0) + (got.get(0, 0) if k == 1 else 0) + (got.get(n + 1, 0) if k == n else 0) for k in range(1, n + 1)]
                bins[c] = ([(x + 1) / (size + n) for x in inside], edges[c])
        self.fitted = {"features": names, "source": source, "bins": bins, "categories": self._categories(df, list(categorical)), "training": df}
        return self

    def decision_function(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.fitted and self.plus and self.components.names[0] not in df.columns:
            validate.same_columns(df, self.fitted["source"])
            return super().decision_function(self.components.transform(df), name).drop(*self.components.names)
        return super().decision_function(df, name)


class Components:
    """Centred principal components: one covariance aggregate, eigenvectors of a features x features matrix."""

    def fit(self, df: DataFrame, features: list[str]) -> Components:
        self.features, d = features, len(features)
        x = [F.col(c).cast("double") for c in features]
        row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
        self.mean = [row[f"m{i}"] for i in range(d)]
        cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1]
        self.values, self.vectors = values[order], vectors[:, order]
        for k in range(d):  # the largest loading is positive
            if self.vectors[np.argmax(np.abs(self.vectors[:, k])), k] < 0:
                self.vectors[:, k] *= -1
        self.names = [f"pc_{k}" for k in range(d)]
        return self

    def expression(self, k: int) -> Column:
        out = F.lit(0.0)
        for c, m, w in zip(self.features, self.mean, self.vectors[:, k]):
            out = out + (F.col(c).cast("double") - float(m)) * float(w)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[self.expression(k).alias(n) for k, n in enumerate(self.names)])


class PCAReconstructionError:
    """Squared distance to the plane of the first components (all but one, unless given)."""

    def __init__(self):
        self.model = None

    def fit(self, df: DataFrame, features: list[str] | None = None, n_components: int | None = None) -> PCAReconstructionError:
        names = validate.features(df, features)
        validate.finite(df, names)
        self.kept = len(names) - 1 if n_components is None else n_components
        self.model, self.training = Components().fit(df, names), df
        return self

    def decision_function(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.model is None:
            raise ValueError("fit before scoring")
        validate.same_columns(df, self.model.features)
        error = F.lit(0.0)
        for k in range(self.kept, len(self.model.features)):
            error = error + self.model.expression(k) ** 2
        return df.withColumn(name, error)

    def predict(self, df: DataFrame, quantile: float = 0.99) -> DataFrame:
        if self.model is None:
            raise ValueError("fit before predicting")
        limit = _score_limit(self.decision_function(self.training).select("score"), quantile)
        return self.decision_function(df).withColumn("outlier", F.col("score") > F.lit(limit))
