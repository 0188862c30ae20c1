"""Toxicity scores by weak supervision.

Voters are lexicon terms (whole words), patterns (word beginnings of 4 to 8 letters) and surface patterns. A generative
label model has a latent class per document, each voter's rate in either class, and correlations: given the class, the
voters form the tree of the strongest conditional mutual information, and a voter's rate depends on its parent, so that a
word and its own beginnings count about once. Rates, correlations and the tree are estimated by expectation maximisation
over the votes of all documents, started from and anchored by labelled rows. The posterior labels of a sample of
documents, labelled or not, then train a linear (logistic) classifier over the votes, which scores every document.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1, and from at most ``bound`` of them
(20,000, those with the smallest hash of their id); terms are counted on these, the 4 * VOTERS clearest of them are
looked at and VOTERS (512) at most become voters. The classifier is trained on at most ``bound`` documents, none with
remainder 1, those with the smallest hash of their id. The label model's statistics cover all documents: votes are grouped
into patterns with counts, and each round adds up one matrix of voters x voters per task, tasks by the dozen at a time.
lang, source, doc_id and labels are no inputs of a score.

Defined cases: null text is empty and gets the score of a document without votes; no labelled toxic row leaves the
surface patterns only, with the prior of 1/2 a row as score; a null id has crc32 of the empty text; repeated rows score
alike; of an id's different texts the one with the smallest list of votes is its labelled one; an empty table gives no
rows; columns other than doc_id and text are ignored, null labels too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import shared
from .words import text_of

BOUND, VOTERS, ROUNDS, BEGINNINGS = 20_000, 512, 6, (4, 5, 6, 7, 8)
#: Vote patterns that a task takes in, and tasks whose matrices one task adds up.
PATTERNS, FAN = 50_000, 32
_WORD = re.compile(r"[^\W\d_]+")
SURFACE = {"shouting": re.compile(r"!{2,}"), "masked": re.compile(r"\w[*#@$]{2,}\w?"), "capitals": re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{3,}\b){3}"), "address": re.compile(r"(?i)\byou(?:'re| are)? (?:a|an|so|such)\b")}


def terms(text: str) -> set[str]:
    """Whole words, and beginnings marked by a closing asterisk."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in BEGINNINGS if len(w) > k}


def votes(text: str, voters: dict[str, int]) -> list[int]:
    """Voters that speak for a text; the rest abstain."""
    on = {voters[t] for t in terms(text) & voters.keys()}
    on |= {voters[f"<{name}>"] for name, p in SURFACE.items() if f"<{name}>" in voters and p.search(text)}
    return sorted(on)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _labelled(labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, toxic of the rows to learn from; at most ``bound``."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return shared.table(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "toxic-labels")


def _term_counts(sample: DataFrame) -> DataFrame:
    """term, pos, neg: labelled documents of either class that have it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                seen[y].update(terms(text.as_py() or ""))
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(both, pa.string()), "pos": pa.array([seen[1][t] for t in both], pa.int64()), "neg": pa.array([seen[0][t] for t in both], pa.int64())})

    return sample.mapInArrow(shared.trimmed(task), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _choose(counts: DataFrame, n_pos: int, n_neg: int) -> list[tuple[str, int, int]]:
    """The terms that speak most clearly for label 1, by log likelihood ratio."""
    least = max(3, math.ceil(0.01 * n_pos))
    share = n_pos / max(1, n_pos + n_neg)
    p = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.col("pos") * F.log(p / share) + F.col("neg") * F.log((1 - p + 1e-12) / (1 - share + 1e-12))
    rows = counts.filter((F.col("pos") >= least) & (p >= 0.5)).withColumn("gain", gain).orderBy(F.desc("gain"), "term").limit(4 * VOTERS)
    best: dict[tuple, tuple[str, int, int]] = {}
    for r in rows.collect():  # 4 * VOTERS rows at most
        key = (r["term"][: min(BEGINNINGS)], r["pos"], r["neg"])
        stem = best[key][0].rstrip("*") if key in best else ""
        if not (r["term"].rstrip("*").startswith(stem) or stem.startswith(r["term"].rstrip("*"))):
            key = (r["term"], r["pos"], r["neg"])
            stem = ""
        if len(r["term"].rstrip("*")) >= len(stem):  # of a word and its beginnings with equal counts, the longest
            best[key] = (r["term"], r["pos"], r["neg"])
    return list(best.values())[:VOTERS]


def dependency_tree(s: list[np.ndarray], n: list[float]) -> np.ndarray:
    """Parent of each voter, -1 at a root: the maximal spanning forest by mutual information given the class. ``s``: sums of
    votes times votes in either class, ``n``: documents of either; links that an information criterion rejects are left out."""
    width, total = len(s[0]), sum(n)
    info = np.zeros((width, width))
    for own, m in zip(s, n):
        p = own / max(m, 1e-9)
        one = np.diag(p)
        for both, a, b in ((p, one[:, None], one[None, :]), (one[:, None] - p, one[:, None], 1 - one[None, :]), (one[None, :] - p, 1 - one[:, None], one[None, :]), (1 - one[:, None] - one[None, :] + p, 1 - one[:, None], 1 - one[None, :])):
            both = np.clip(both, 0, None)
            info += m / total * both * np.log(np.clip(both, 1e-15, None) / np.clip(a * b, 1e-15, None))
    np.fill_diagonal(info, -1)
    least = math.log(max(total, 2)) / max(total, 1)
    parent, best, left = np.full(width, -1), np.full(width, -1.0), np.ones(width, bool)
    for _ in range(width):
        k = int(np.argmax(np.where(left, best, -2)))
        left[k] = False
        if best[k] <= least:
            parent[k] = -1
        nearer = left & (info[k] > best)
        best[nearer], parent[nearer] = info[k][nearer], k
    return parent


class LabelModel:
    """Latent class with voters' rates given the class and their parent in a tree of correlations."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """``x``, ``y``: votes and labels of the labelled rows."""
        x = x.astype(float)
        self.anchor = [float((y == k).sum()) for k in (0, 1)], [x[y == k].T @ x[y == k] for k in (0, 1)]
        self.update(np.zeros(2), np.zeros((2, x.shape[1], x.shape[1])))

    def update(self, n: np.ndarray, s: np.ndarray) -> None:
        """n: weight of either class over all documents; s: weighted sums of votes times votes, class 0 and 1."""
        n = [a + b for a, b in zip(self.anchor[0], n)]
        s = [a + b for a, b in zip(self.anchor[1], s)]
        self.parent = dependency_tree(s, n)
        child, up = self.parent >= 0, np.maximum(self.parent, 0)
        prior = min(0.5, max(1e-6, (n[1] + 1) / (n[0] + n[1] + 2)))
        rates = []
        for own, m, more in zip(s, n, (1.0, 0.1)):
            count = np.diag(own)
            rate = (count + more) / (m + 10 * more if more < 1 else m + 2)
            joint = own[np.arange(len(own)), up]
            on, off = (joint + rate) / (count[up] + 1), (count - joint + rate) / (m - count[up] + 1)
            rates.append([np.clip(np.where(child, v, rate), 1e-7, 1 - 1e-7) for v in (on, off)])
        (on0, off0), (on1, off1) = rates
        none, alone = np.log((1 - off1) / (1 - off0)), np.log(off1 / off0)
        above, both = np.log((1 - on1) / (1 - on0)), np.log(on1 / on0)
        self.base = math.log(prior / (1 - prior)) + none.sum()
        self.own, self.up, self.both = alone - none, np.where(child, above - none, 0), np.where(child, both - alone - above + none, 0)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of a 0/1 matrix of votes."""
        over = x[:, np.maximum(self.parent, 0)]
        z = self.base + x @ self.own + over @ self.up + (x * over) @ self.both
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(lists), width), np.float32)
    for k, on in enumerate(lists):
        x[k, on] = 1
    return x


def _moments(patterns: DataFrame, parts: int, model: LabelModel, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One expectation step over all vote patterns; a task returns one row of fixed size, and rows are added up in a tree."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2)
        s = np.zeros((2, width, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.slice(lo, 4096)
                x, w = _matrix(own.column("votes").to_pylist(), width), own.column("n").to_numpy().astype(float)
                p = model.posterior(x)
                for k, weight in enumerate((w * (1 - p), w * p)):
                    n[k] += weight.sum()
                    s[k] += (x * weight[:, None].astype(np.float32)).T @ x
        yield pa.RecordBatch.from_pydict({"one": pa.array([1]), "data": pa.array([np.concatenate([n, s.ravel()]).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * width * width)
        for batch in batches:
            for data in batch.column("data"):
                total += np.frombuffer(data.as_buffer())
        yield pa.RecordBatch.from_pydict({"one": pa.array([1]), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "one long, data binary"
    summed = patterns.coalesce(parts).mapInArrow(shared.trimmed(task), schema)
    while parts > 1:
        parts = -(-parts // FAN)
        summed = summed.repartition(parts).mapInArrow(shared.trimmed(add), schema)
    flat = np.zeros(2 + 2 * width * width)
    for row in summed.collect():  # one row, of voters x voters
        flat += np.frombuffer(bytes(row["data"]))
    return flat[:2], flat[2:].reshape(2, width, width)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """Weights, bias last, by Newton steps on soft labels; ``weight``: times that a row counts."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * (p * (1 - p) + 1e-6))[:, None].astype(x.dtype)).T @ x
        step = np.clip(np.linalg.solve(curve + np.diag(keep), x.T @ (weight * (p - y)) + keep * w), -4, 4)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, bound: int = BOUND, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.7), votes (number of voters that spoke)."""
    known = _labelled(labels, bound)
    small = F.broadcast(known)  # at most ``bound`` pairs of numbers
    rows = ship(docs).select("doc_id", text_of("text").alias("text"))
    n_pos, n_neg = (known.agg(F.count(F.when(F.col("toxic") == y, 1))).first()[0] for y in (1, 0))
    chosen = _choose(shared.table(_term_counts(rows.join(small, "doc_id").select("text", "toxic")), "toxic-terms"), n_pos, n_neg) if n_pos else []
    voters = {t: k for k, (t, _, _) in enumerate(chosen)} | {f"<{name}>": len(chosen) + k for k, name in enumerate(SURFACE)}
    width = len(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(t.as_py() or "", voters) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int16()))], ["doc_id", "votes"])

    cast = shared.table(rows.mapInArrow(shared.trimmed(vote), f"doc_id {dict(docs.dtypes)['doc_id']}, votes array<short>"), "toxic-votes")
    patterns = shared.table(cast.groupBy("votes").agg(F.count("*").alias("n")), "toxic-patterns")
    n_patterns = patterns.count()
    fit = cast.join(small, "doc_id").groupBy("doc_id").agg(F.min("votes").alias("votes"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()  # at most ``bound`` rows
    w = np.zeros(width + 1)
    if chosen and fit:
        model = LabelModel(_matrix([list(r["votes"]) for r in fit], width), np.asarray([r["toxic"] for r in fit]))
        for _ in range(rounds):
            model.update(*_moments(patterns, min(4096, -(-n_patterns // PATTERNS)), model, width))
        sample = cast.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "votes").limit(bound).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
        x = _matrix([list(r["votes"]) for r in sample], width)
        w = logistic(x, model.posterior(x), np.asarray([r["n"] for r in sample], float))

    weights = F.lit([float(v) for v in w[:-1]])
    z = F.aggregate("votes", F.lit(float(w[-1])), lambda acc, k: acc + F.get(weights, k.cast("int")))
    p = 1 / (1 + F.exp(-z))
    return cast.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"), F.size("votes").alias("votes")).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "votes")
