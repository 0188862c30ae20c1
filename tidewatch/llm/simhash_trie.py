"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its 4-word shingles have it.
Different fingerprints link when 4 bits or fewer differ. The join walks a binary trie over the sorted fingerprints in
pairs of nodes, adds up differing bits and drops a pair of nodes as soon as its error budget is spent. Of p parts of
the fingerprint one must hold budget // p errors at most, so p tries are walked, each over the fingerprint rotated to
begin with another part and with that smaller budget inside it: the number of live node pairs stays near linear.

Distribution: the first levels of each trie are the keys of tasks. A fingerprint goes to its own prefix and, as a
visitor, to the lower prefixes within the part's budget; depth grows with the number of fingerprints, so a task stays
small. Copies collapse to one fingerprint before that (map-side), however many there are. Tasks return a spanning
forest of the links they find, which loses no connection; components then come from alternating large and small stars,
each round written to the shared folder. Nothing about single documents reaches the driver.

Defined cases: null, empty or blank text has fingerprint zero, linked like any other; fewer than four words are one
shingle; repeated rows and ids share a component; null ids never name one (a component of null ids only has null); an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import shared
from .words import text_of

BITS, SHINGLE, SEED = 64, 4, 42
#: Fingerprints that one task's prefix holds on average, node pairs walked at once, and pairs compared directly.
PER_TASK, FRONTIER, DIRECT = 8192, 1 << 17, 64


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z, and ASCII white space, only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = np.fromiter(map(xxh64_intdigest, [line[a:b] for a, b in zip(starts.tolist(), ends.tolist())], repeat(SEED)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(h))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (the fingerprint as a signed long)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([fingerprint(t.as_py() or "") for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found)], ["doc_id", "h", "fp"])

    rows = ship(docs).select("doc_id", F.xxhash64(text_of("text")).alias("h"), text_of("text").alias("text"))
    return rows.mapInArrow(shared.trimmed(task), f"doc_id {dict(docs.dtypes)['doc_id']}, h long, fp long")


def _errors(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _expand(alo, ahi, blo, bhi):
    """Index pairs of many small rectangles."""
    wide = bhi - blo
    n = (ahi - alo) * wide
    own = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return alo[own] + k // wide[own], blo[own] + k % wide[own]


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int, part: int, part_budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted unsigned values within ``budget`` bits, with at most ``part_budget`` of them in the
    first ``part`` bits: i < j within ``a``, or i in ``a`` and j in ``b``."""
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return

    def counts(x):
        bit = (x[None, :] >> np.arange(BITS - 1, -1, -1, dtype=np.uint64)[:, None]) & np.uint64(1)
        return np.concatenate([np.zeros((BITS, 1), np.int32), np.cumsum(bit, axis=1, dtype=np.int32)], axis=1)

    ca, cb = counts(a), None
    cb = ca if alone else counts(b)
    one = lambda v: np.asarray([v], np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), one(0))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((depth, *(x[half:] for x in (alo, ahi, blo, bhi, err))))
            alo, ahi, blo, bhi, err = (x[:half] for x in (alo, ahi, blo, bhi, err))
        small = ((ahi - alo) * (bhi - blo) <= DIRECT) | (depth == BITS)
        if small.any():
            i, j = _expand(alo[small], ahi[small], blo[small], bhi[small])
            if alone:
                i, j = i[i < j], j[i < j]
            x = a[i] ^ b[j]
            near = _errors(x) <= budget
            if part < BITS:
                near &= _errors(x >> np.uint64(BITS - part)) <= part_budget
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am = ahi - (ca[depth][ahi] - ca[depth][alo])
        bm = bhi - (cb[depth][bhi] - cb[depth][blo])
        twin = (alo == blo) & (ahi == bhi) if alone else np.zeros(len(alo), bool)
        limit = part_budget if depth < part else budget
        kids = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        mirrored = tuple(x[~twin] for x in (am, ahi, blo, bm, err + 1))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids, mirrored))
        live = (ahi > alo) & (bhi > blo) & (err <= limit)
        stack.append((depth + 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for _ in range(2):  # most links join what is joined already
            self.up = self.up[self.up]
        new = self.up[i] != self.up[j]
        for x, y in zip(i[new].tolist(), j[new].tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def links(distinct: DataFrame, n: int, budget: int = 4) -> DataFrame:
    """u, v: a spanning forest, by task, of all pairs of different ``fp`` within ``budget`` bits."""
    parts = 3 if n <= 1 << 26 else 2
    widths = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    offsets, part_budget = [sum(widths[:k]) for k in range(parts)], budget // parts
    depth = max(0, min(16, (max(n, 1) // PER_TASK).bit_length()))
    masks = [sum(1 << j for j in pick) for size in range(part_budget + 1) for pick in combinations(range(depth), size)]
    turned = F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftleft("fp", off).bitwiseOR(F.shiftrightunsigned("fp", BITS - off)) if off else F.col("fp")).alias("t")) for k, off in enumerate(offsets)])
    rows = distinct.select(F.explode(turned).alias("x")).select("x.k", "x.t", (F.shiftrightunsigned("x.t", BITS - depth) if depth else F.lit(0).cast("long")).alias("own"))
    rows = rows.select("k", "t", "own", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    rows = rows.select("k", "t", F.col("own").bitwiseXOR(F.col("mask")).alias("bucket"), (F.col("mask") == 0).alias("home"), "own").filter(F.col("bucket") <= F.col("own"))

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        t, home = pdf["t"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        a, b = np.sort(t[home]), np.sort(t[~home])
        both = np.concatenate([a, b])
        trees = Forest(len(both))
        for i, j in trie_links(a, None, budget, widths[k], part_budget):
            trees.add(i, j)
        for i, j in trie_links(a, b, budget, widths[k], part_budget):
            trees.add(i, j + len(a))
        back = _turn(both, (BITS - offsets[k]) % BITS).view(np.int64)
        pairs = np.asarray(trees.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": back[pairs[:, 0]], "v": back[pairs[:, 1]]})

    return rows.groupBy("k", "bucket").applyInPandas(task, "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """u, root: the smallest node that each node of ``edges`` (u, v) is connected to; nodes are longs."""
    edges = shared.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = shared.table(small.filter("u <> v").distinct(), "star-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select("u", F.col("v").alias("root"))
        mark = now


def components(docs: DataFrame, budget: int = 4) -> DataFrame:
    """doc_id, h, fp, component_id (smallest doc_id reachable over links), first (whether the row is the component's
    first by id, nulls last, and hash of the text)."""
    rows = shared.table(fingerprints(docs), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("gone"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    distinct = shared.table(rows.groupBy("fp").agg(F.min(place).alias("first")), "simhash-distinct")
    roots = stars(links(distinct, distinct.count(), budget))
    named = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lead = named.select("fp", "root").join(named.groupBy("root").agg(F.min("first").alias("lead")), "root").select("fp", "lead")
    found = rows.join(lead, "fp")
    return found.select("doc_id", "h", "fp", F.col("lead.doc_id").alias("component_id"), (place == F.col("lead")).alias("first"))


def keep_first(docs: DataFrame, budget: int = 4) -> DataFrame:
    """One document of each component stays: the first by id (one row, if that is repeated)."""
    kept = components(docs, budget).filter("first").select(F.col("doc_id").alias("tidewatch_id"), F.col("h").alias("tidewatch_g")).distinct()
    own = docs.withColumn("tidewatch_h", F.xxhash64(text_of("text")))
    rows = own.join(kept, F.col("doc_id").eqNullSafe(F.col("tidewatch_id")) & (F.col("tidewatch_h") == F.col("tidewatch_g")), "left_semi")
    return rows.dropDuplicates(["doc_id", "tidewatch_h"]).drop("tidewatch_h")
