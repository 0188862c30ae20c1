"""Sharding by Hilbert-curve order (native DataFrame functions only).

Several metadata dimensions are quantised to equal-depth cells, the cells are ordered along a Hilbert curve, and the
order is cut into runs of equal length, so that a file covers a small box of every dimension and min/max statistics
prune on any of them.

Law ``rows``: shard counts differ by one at most. The text is read once and never shuffled; the only shuffle carries
(cell, bucket, doc_id, size, crc) per row. A hot cell (one source with a third of all rows) is split by hash over 64
buckets, or one per ``SPLIT_ROWS`` rows of the table, so no task ranks a whole cell. Offsets of (cell, bucket) come from
a prefix sum over a count of each. Strings are quantised whole: by the share of rows with a lower string.

Defined cases: null or empty text has size 8 and crc 0; a null dimension falls in cell 0; repeated rows take slots of
their own; an empty table gives no rows; columns of ``docs`` that are not named as inputs are ignored.
"""

from __future__ import annotations

import operator
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .words import text_of

#: Buckets of a cell at least, and rows for which there is one more.
SPLIT, SPLIT_ROWS = 64, 1 << 20


def hilbert_index(point: list[int], bits: int) -> int:
    """Position on the Hilbert curve of a cell with one ``bits``-bit coordinate per dimension (Skilling's transform)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    at = 0
    for b in reversed(range(bits)):
        for i in range(n):
            at = (at << 1) | (((x[i] ^ flip) >> b) & 1)
    return at


def curve_table(dims: int, bits: int) -> list[int]:
    """Curve index of every cell, by the coordinates packed with the first dimension highest."""
    mask = (1 << bits) - 1
    return [hilbert_index([(code >> (bits * (dims - 1 - d))) & mask for d in range(dims)], bits) for code in range(1 << (dims * bits))]


def _string_cuts(values: DataFrame, bits: int) -> list[str]:
    """First string of each equal-depth cell but the lowest, of whole strings in byte order. Distinct values are ranged over
    tasks and their counts added up from one range to the next, so no task sees them all."""
    counts = values.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = shared.table(counts.repartitionByRange(parts, "v").select("v", "n", F.spark_partition_id().alias("part")), "hilbert-values")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("all"))  # a row per task
    whole = W.partitionBy()
    sums = sums.select("part", (F.sum("all").over(whole.orderBy("part")) - F.col("all")).alias("base"), F.sum("all").over(whole).alias("total"))
    before = F.col("base") + F.sum("n").over(W.partitionBy("part").orderBy("v")) - F.col("n")
    cell = F.expr(f"before * {1 << bits} div total")
    found = ranged.join(sums, "part").withColumn("before", before).groupBy(cell.alias("cell")).agg(F.min("v").alias("v"))
    return sorted((r["v"] for r in found.filter("cell > 0").collect()), key=str.encode)  # 2**bits - 1 rows at most


def assign(docs: DataFrame, n_shards: int = 24, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = 4) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, curve): see the module's text."""
    if len(dims) * bits > 15 or bits < 1:
        raise ValueError("the curve's table is a literal: dims * bits may be 15 at most")
    kinds = dict(docs.dtypes) | {"size": "bigint"}
    text = text_of("text")
    size = (F.octet_length(text) + 8).cast("long")
    own = lambda d: size if d == "size" else F.col(d) if kinds[d] == "string" else F.col(d).cast("double")
    meta = shared.table(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), *[own(d).alias(f"c{k}") for k, d in enumerate(dims)]), "hilbert-meta")
    split = max(SPLIT, meta.count() // SPLIT_ROWS)
    numbers = [k for k, d in enumerate(dims) if kinds[d] != "string"]
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = meta.agg(F.lit(0), *[F.percentile_approx(f"c{k}", parts, 10_000).alias(f"c{k}") for k in numbers]).first().asDict()
    cell = F.lit(0)
    for k in range(len(dims)):
        value = F.col(f"c{k}")
        edges = sorted(set(cuts[f"c{k}"] or [])) if k in numbers else _string_cuts(meta.select(value.alias("v")), bits)
        over = partial(operator.gt if k in numbers else operator.ge, value)
        at = F.size(F.filter(F.lit(edges), over)) if edges else F.lit(0)
        cell = cell * (1 << bits) + F.when(value.isNull(), 0).otherwise(at)
    placed = meta.select("doc_id", "size", "crc", F.get(F.lit(curve_table(len(dims), bits)), cell).alias("curve"), F.pmod(F.xxhash64("doc_id", "crc"), F.lit(split)).alias("bucket"))
    counts = placed.groupBy("curve", "bucket").agg(F.count("*").alias("n"))
    order = W.orderBy("curve", "bucket")  # one task, but of a count per cell and bucket
    bases = counts.select("curve", "bucket", (F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"), F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("curve", "bucket").orderBy("doc_id", "crc", "size")))
    pos = F.col("base") + F.col("rank") - 1
    return (
        ranked.join(bases, ["curve", "bucket"])
        .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.expr(f"cast((base + rank - 1) * {n_shards} div total as int)").alias("shard"), pos.alias("pos"), "total", F.col("curve").cast("int").alias("curve"))
        .select("doc_id", "size", "text_crc32", "law", "shard", F.expr(f"pos - ((cast(shard as bigint) * total + {n_shards - 1}) div {n_shards})").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )


def write(docs: DataFrame, placed: DataFrame, path: str, n_shards: int = 24) -> None:
    """Write ``docs`` as one folder per shard (``shard=k``), rows in slot order. Each row takes a slot of its own: rows equal
    in id and text are numbered on both sides. Columns ``shard`` and ``slot`` of ``docs`` give way to those of the placement."""
    text, key = text_of("text"), ["tidewatch_id", "tidewatch_crc", "tidewatch_size"]
    number = F.row_number().over(W.partitionBy(*key).orderBy("tidewatch_order")).alias("tidewatch_n")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    own = docs.withColumns({"tidewatch_id": F.col("doc_id"), "tidewatch_crc": F.crc32(text.cast("binary")), "tidewatch_size": (F.octet_length(text) + 8).cast("long"), "tidewatch_order": F.xxhash64(*[F.col(c) for c in kept])})
    own = own.select(*kept, *key, number)
    slots = placed.select(F.col("doc_id").alias("tidewatch_id"), F.col("text_crc32").alias("tidewatch_crc"), F.col("size").alias("tidewatch_size"), "shard", "slot").withColumn("tidewatch_order", F.struct("shard", "slot")).select(*key, "shard", "slot", number)
    slots = slots.withColumnsRenamed({c: f"{c}_2" for c in [*key, "tidewatch_n"]})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in [*key, "tidewatch_n"]]
    rows = own.join(slots, reduce(operator.and_, same)).select(*kept, "shard", "slot")
    rows.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
