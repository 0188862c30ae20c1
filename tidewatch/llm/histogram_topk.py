"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. Rounds of global score histograms then close in on each
query's kth value: a task counts the scores in ``BINS`` bins of the query's present range and reports its highest bins
down to its own kth score (lower ones cannot hold the global kth), the counts are added up, and the bin that holds the
kth becomes the next range. When few rows lie above its lower edge, or it is one score wide, rows at or above that edge
are kept, at most k per query and batch by (score, smaller id), and ranked.

Queries lie in block files in the shared folder, written by the executors and mapped by tasks, so neither queries nor
thresholds are broadcast or collected. A round reads the ranges of its own number and writes those of the next, so a task
that is lost and run again, before or after its file was written, leaves the same ranges. Scores are exact integers:
products run in double precision where 64-bit sums stay below 2**53, else in 64-bit integers.

Defined cases: vectors that are null, or hold a null or a value that is not finite, take no part, nor do null ids; rows
that share an id are rows of their own and no candidates of one another, their candidates are ranked together; of rows
equal in id and vector no more than k can be in a result, so no more are carried; vectors of another length than the
first query's raise; fewer candidates than k give all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import shared

BLOCK, BINS, ENOUGH = 1024, 512, 64


def quantised(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, q: floor(256 x) of every component, valid vectors only; equal rows ``k`` times at most."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v * 256).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, q).alias("q")).filter("q is not null").groupBy("vec_id", "q").agg(F.count("*").alias("n")).select("vec_id", "q", F.explode(F.array_repeat(F.lit(1), F.least("n", F.lit(k)).cast("int")))).drop("col")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    most = (np.abs(q).max(initial=0).astype(float)) * (np.abs(v).max(initial=0).astype(float)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _save(path: str, data: np.ndarray) -> None:
    own = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    with open(own, "wb") as f:
        np.save(f, data)
    os.replace(own, path)


class Blocks:
    """Mapped files of the query blocks as one round sees them: vectors, and per query its id, lower edge, width of a bin
    and whether its range is found."""

    def __init__(self, at: str, turn: int):
        self.at, self.turn = at, turn
        self.names = sorted(f[:-8] for f in os.listdir(at) if f.endswith(".vec.npy"))

    def state(self, name: str) -> np.ndarray:
        return np.load(f"{self.at}/{name}.{self.turn}.npy", mmap_mode="r")

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for name in self.names:
            yield np.load(f"{self.at}/{name}.vec.npy", mmap_mode="r"), self.state(name)


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    base = shared.table(quantised(ship(vectors), k), "topk-vectors")
    chosen = base.filter(F.col("vec_id") % every == 0)
    n_queries = chosen.count()
    blocks = max(1, -(-n_queries // BLOCK))
    norm = base.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("x")).first()["x"] or 0.0
    bound = int(np.ceil(np.sqrt(norm))) + 1
    at = shared.local_folder(spark, "topk-queries")

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        ids, q = pdf["vec_id"].to_numpy(), np.stack(pdf["q"].to_list()).astype(np.int64)
        reach = np.ceil(np.sqrt((q.astype(float) ** 2).sum(axis=1))).astype(np.int64) * bound + 1
        reach = pd.Series(reach).groupby(ids).transform("max").to_numpy()  # rows of one id share a range
        _save(f"{at}/{int(key[0]):06d}.0.npy", np.stack([ids, -reach, np.maximum(1, -(-2 * reach // BINS)), np.zeros_like(ids)]))
        _save(f"{at}/{int(key[0]):06d}.vec.npy", q)
        return pd.DataFrame({"n": [len(q)]})

    chosen.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(begin, "n long").agg(F.sum("n")).first()

    def count(turn: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Blocks(at, turn)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, ids = _matrix(batch.column("q")), batch.column("vec_id").to_numpy()
                for vec, (own, lo, width, done) in held:
                    if done.all():
                        continue
                    slot = (_product(vec, v) - lo[:, None]) // width[:, None]
                    slot[own[:, None] == ids[None, :]] = -1  # after the subtraction, which a lowest score would make wrap
                    out: list[tuple[int, int, int]] = []
                    for i, row in enumerate(slot):
                        if done[i]:
                            continue
                        row = np.minimum(row[row >= 0], BINS)
                        n = np.bincount(row, minlength=BINS + 1)
                        above = np.cumsum(n[::-1])[::-1] - n
                        for j in np.flatnonzero((n > 0) & (above < k)):
                            out.append((int(own[i]), int(j), int(n[j])))
                    q, j, n = (list(x) for x in zip(*out)) if out else ([], [], [])
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "bin": pa.array(j, pa.int32()), "n": pa.array(n, pa.int64())})

        return shared.trimmed(task)

    def refine(turn: int):
        def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            name = f"{int(key[0]):06d}"
            if not os.path.exists(f"{at}/{name}.vec.npy"):  # no query falls in this block
                return pd.DataFrame({"left": [0]})
            pdf = pdf[pdf["query_id"].notna()].astype("int64")
            state = np.array(Blocks(at, turn).state(name))
            ids, lo, width, done = state
            left = 0
            for query, b, above, n in zip(pdf["query_id"], pdf["bin"], pdf["above"], pdf["n"]):
                i = slice(*np.searchsorted(ids, [query, query + 1]))
                if 0 <= b < BINS:
                    lo[i] += b * width[i]
                    done[i] = (width[i] == 1) | (above + n <= ENOUGH * k)
                    width[i] = np.maximum(1, -(-width[i] // BINS))
                else:  # fewer candidates than k (all are kept), or the kth lies above the range that held it
                    done[i] = 1
                left += not done[i].all()
            _save(f"{at}/{name}.{turn + 1}.npy", state)
            return pd.DataFrame({"left": [left]})

        return task

    # A block of which no query reported (all are done, or have no candidates) keeps its ranges.
    names = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("above"), F.lit(None).cast("long").alias("n"))
    turn = 0
    while True:
        counts = base.select("vec_id", "q").mapInArrow(count(turn), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        upto = counts.withColumn("upto", F.sum("n").over(down))
        kth = upto.groupBy("query_id").agg(F.max(F.when(F.col("upto") >= k, F.struct("bin", (F.col("upto") - F.col("n")).alias("above"), "n"))).alias("x"))
        kth = kth.select("query_id", F.coalesce("x.bin", F.lit(-1)).alias("bin"), F.coalesce("x.above", F.lit(0)).alias("above"), F.coalesce("x.n", F.lit(0)).alias("n"))
        kth = kth.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).unionByName(names)
        left = kth.groupBy("block").applyInPandas(refine(turn), "left long").agg(F.sum("left")).first()[0]
        turn += 1
        if not left:
            break

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(at, turn)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _matrix(batch.column("q")), batch.column("vec_id").to_numpy()
            for vec, (own, lo, _, _) in held:
                scores = _product(vec, v)
                fit = (scores >= lo[:, None]) & (own[:, None] != ids[None, :])
                i, j = np.nonzero(fit)
                s = scores[i, j]
                order = np.lexsort((ids[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(own[i[best]]), pa.array(ids[j[best]]), pa.array(s[best])], ["query_id", "vec_id", "score"])

    found = base.select("vec_id", "q").mapInArrow(shared.trimmed(keep), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
