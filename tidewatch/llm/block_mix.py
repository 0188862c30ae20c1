"""Mixing sources to target weights by Sainte-Lague apportionment (native DataFrame functions only).

Sources in code-point order weigh 5, 2, 1, repeating (null last) and share the words of the whole corpus; a target stops
at ``max_epochs`` times its source's words and the excess is reshared by weight (water filling, solved in closed form
over the table of sources). The corpus is then ``blocks`` equal-token blocks, and every shard receives an integer quota
of blocks per source: seats go to the highest quotients target / (2 seats + 1). Sainte-Lague is house monotone, so a
shard's quota is the difference between the seats of two house sizes. Within a source documents stand in seeded order (md5 of seed
and id), so that blocks are seeded draws; a source gives whole epochs plus a run of blocks from a seeded start, wrapping
round, and its blocks go to the shards in that order, to each as many as its quota (``apply`` with ``shard``).

Scale: one text scan; every shuffle carries (source, bucket, id, size). A hot source is split over ``SPLIT`` md5
buckets, so prefix sums over its documents never run in one task. Only tables of one row per source, per (source,
bucket) or per candidate seat are global.

Defined cases: null text has no words; null source is a source of its own, last; documents of no words are taken 0
times; repeated rows share an id and hence a place in the order, each with a range of its own; ``apply`` takes the other
columns of rows equal in id and text from one of them; a corpus without words or rows gives zero targets or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .words import n_words, text_of, words

SPLIT = 256
BLOCKS = 65_536


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) with one row per source -> source, source_size, weight, target."""
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.select("source", "source_size", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("double").alias("weight"))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    filled = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The water level is that of the first source, by cap / weight, that stays under its cap.
    rows = rows.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everything)["level"])
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def seats(goal: DataFrame, shards: int = 8, blocks: int = BLOCKS) -> DataFrame:
    """Seats of each source up to the end of each shard: source, shard, seats (cumulative over shards).

    With a house of h blocks for n sources, the divisor that fills it is within a factor of 1 -+ n / 2h of the plain one, so
    a source's seats lie that near its share q. Only seats between are ranked, about four a source in all.
    """
    span = W.partitionBy()
    base = goal.withColumn("all_target", F.sum("target").over(span)).withColumn("n", F.count("*").over(span)).filter(F.col("target") > 0)
    base = base.select("source", "target", "all_target", "n", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")).withColumn("house", F.expr(f"{blocks} * shard div {shards}"))
    share, slack = F.col("target") * F.col("house") / F.col("all_target"), F.col("n") / (2 * F.greatest(F.col("house"), F.lit(1)))
    base = base.withColumn("first", F.greatest(F.lit(0), F.floor(share * (1 - slack) - 1.5)).cast("long")).withColumn("last", F.ceil(share * (1 + slack) + 1.5).cast("long"))
    ranked = base.select("source", "shard", "house", "first", "target", F.explode(F.sequence("first", "last")).alias("seat"))
    best = W.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("seat") + 1)), F.col("source").asc_nulls_last(), "seat")
    sure = base.groupBy("shard").agg(F.sum("first").alias("sure"))
    ranked = ranked.withColumn("place", F.row_number().over(best)).join(F.broadcast(sure), "shard")  # one row per shard
    return ranked.groupBy("source", "shard").agg((F.max("first") + F.count(F.when(F.col("place") <= F.col("house") - F.col("sure"), 1))).alias("seats"))


def plan(docs: DataFrame, shards: int = 8, blocks: int = BLOCKS, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, remainder: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, sources). Documents: doc_id, h (hash of the text), source, size, place (first word's place in its source), source_size,
    target, quota (words), start and end (words of the partial epoch, from a seeded block; beyond the source's end it
    wraps), epochs (whole ones), late and early (words of the partial epoch before and after it wraps), ends (taken words of the source up to the end of each
    shard), taken.
    Sources: source, shard, blocks. ``remainder``: words are added to or taken off a source's blocks until its target is
    met, so that one below half a block is not dropped; without, quotas are whole blocks."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    named = F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), "source"))  # never null, in the same order
    meta = docs.select("doc_id", F.xxhash64(text_of("text")).alias("h"), named.alias("source"), n_words(text_of("text")).alias("size"), key.alias("key"))
    meta = shared.table(meta.withColumn("bucket", F.conv(F.substring("key", 1, 2), 16, 10).cast("int")), "mix-meta")
    goal = shared.table(targets(meta.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    dealt = shared.table(seats(goal, shards, blocks), "mix-seats")
    quota = dealt.groupBy("source").agg(F.max("seats").alias("seats"), F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"]).alias("upto"))
    goal = goal.join(quota, "source", "left").withColumn("unit", F.greatest(F.lit(1e-9), F.sum("source_size").over(W.partitionBy()) / blocks))  # words in a block
    met = F.when(F.col("target") > 0, F.greatest(F.lit(1.0), F.round("target"))).otherwise(0.0)
    words_due = met if remainder else F.round(F.coalesce("seats", F.lit(0)) * F.col("unit"))
    goal = goal.withColumn("quota", F.least(F.col("source_size") * max_epochs, words_due.cast("long")))
    # Words of a source up to the end of each shard; one without a block goes to a seeded shard whole.
    own = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(shards)) + 1
    even = F.transform("upto", lambda x: F.floor(F.col("quota").cast("double") * x / F.greatest(F.col("seats"), F.lit(1))).cast("long"))
    whole = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda x: F.when(x >= own, F.col("quota")).otherwise(F.lit(0).cast("long")))
    goal = goal.withColumn("ends", F.when(F.coalesce("seats", F.lit(0)) > 0, even).otherwise(whole))
    drawn = F.expr(f"cast(conv(substring(md5(concat('{seed}/', source)), 1, 13), 16, 10) as bigint)")
    goal = goal.select("source", "source_size", "target", "quota", F.floor(F.col("unit") * F.pmod(drawn, F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / F.col("unit"))))).cast("long").alias("start"), "ends")
    sums = meta.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "h").rowsBetween(W.unboundedPreceding, 0)
    placed = meta.withColumn("upto", F.sum("size").over(inside)).join(sums, ["source", "bucket"])
    placed = placed.select("doc_id", "h", "source", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("place")).join(goal, "source")
    overlap = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least(F.col("place") + F.col("size"), hi) - F.greatest(F.col("place"), lo))
    placed = placed.withColumn("epochs", F.expr("quota div greatest(source_size, 1L)")).withColumn("end", F.expr("start + quota - source_size * epochs"))
    placed = placed.withColumn("late", overlap(F.col("start"), F.least("end", "source_size"))).withColumn("early", overlap(F.lit(0).cast("long"), F.col("end") - F.col("source_size")))
    original = F.when(F.col("source") != "t", F.expr("substring(source, 2)"))
    deal = dealt.select(original.alias("source"), "shard", (F.col("seats") - F.coalesce(F.lag("seats").over(W.partitionBy("source").orderBy("shard")), F.lit(0))).alias("blocks"))
    return placed.select("doc_id", "h", original.alias("source"), "size", "place", "source_size", "target", "quota", "start", "end", "epochs", "late", "early", "ends", (F.col("size") * F.col("epochs") + F.col("late") + F.col("early")).alias("taken")), deal


def mix(docs: DataFrame, shards: int = 8, blocks: int = BLOCKS, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken per document."""
    rows, _ = plan(docs, shards, blocks, weights, max_epochs, seed)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "place")


def apply(docs: DataFrame, shard: str | None = None, **options) -> DataFrame:
    """The mix itself: ``docs`` with a row per whole epoch of a document and one per part of it, where a block begins or
    ends inside it; a part's text is its words joined by a space. Documents of no words are not in a mix. ``shard`` names a
    column to add: the shard (from 1) that the row's block is dealt to; a row that two shards share is cut between them."""
    rows, _ = plan(docs, **options)
    zero, kind = F.lit(0).cast("long"), "array<struct<lo:int,n:int,u:bigint,shard:int>>"
    part = lambda lo, n, u: F.struct(lo.cast("int").alias("lo"), n.cast("int").alias("n"), u.cast("long").alias("u"), F.lit(None).cast("int").alias("shard"))
    whole = F.when(F.col("epochs") > 0, F.transform(F.sequence(zero, F.greatest(zero, F.col("epochs") - 1)), lambda e: part(zero, F.col("size"), e * F.col("source_size") + F.col("place")))).otherwise(F.array().cast(kind))
    first = F.greatest(zero, F.col("start") - F.col("place"))
    done = F.col("epochs") * F.col("source_size")
    late = part(first, F.col("late"), done + F.col("place") + first - F.col("start"))
    early = part(zero, F.col("early"), done + F.col("source_size") - F.col("start") + F.col("place"))
    pieces = F.concat(whole, F.array(late, early))
    if shard:

        def dealt(x: Column) -> Column:
            """The pieces of one that lie in either shard."""
            lo = lambda k: F.greatest(x["u"], F.when(k == 0, zero).otherwise(F.get("ends", k - 1)))
            hi = lambda k: F.least(x["u"] + x["n"], F.get("ends", k))
            return F.transform(F.sequence(F.lit(0), F.size("ends") - 1), lambda k: F.struct((x["lo"] + lo(k) - x["u"]).cast("int").alias("lo"), (hi(k) - lo(k)).cast("int").alias("n"), lo(k).alias("u"), (k + 1).alias("shard")))

        pieces = F.flatten(F.transform(pieces, dealt))
    pieces = F.filter(pieces, lambda x: x["n"] > 0)
    rows = rows.select(F.col("doc_id").alias("tidewatch_id"), F.col("h").alias("tidewatch_h"), F.col("size").alias("tidewatch_size"), F.explode(pieces).alias("tidewatch_x"))
    own = docs.withColumn("tidewatch_g", F.xxhash64(text_of("text"))).dropDuplicates(["doc_id", "tidewatch_g"])
    rows = own.join(rows, F.col("doc_id").eqNullSafe(F.col("tidewatch_id")) & (F.col("tidewatch_g") == F.col("tidewatch_h")))
    cut = F.col("tidewatch_x.n") < F.col("tidewatch_size")
    text = F.array_join(F.slice(words(text_of("text")), F.col("tidewatch_x.lo") + 1, F.col("tidewatch_x.n")), " ")
    out = {c: F.col(c) for c in docs.columns} | {"text": F.when(cut, text).otherwise(F.col("text"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.char_length(text).cast("long")).otherwise(F.col("n_chars").cast("long"))
    return rows.select(*[v.alias(c) for c, v in out.items() if c != shard], *([F.col("tidewatch_x.shard").alias(shard)] if shard else []))
