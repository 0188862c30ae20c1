"""Column expressions that several operators share. A word is a run of bytes other than space and \\t to \\r."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them one by one: pieces between gaps, less the empty ones at either end."""
    edge = lambda at: F.when(text.rlike(at), 1).otherwise(0)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, GAP, -1)) - edge(r"\A[\x20\x09-\x0D]") - edge(r"[\x20\x09-\x0D]\z")).cast("long")


def before(values: Column, op: Callable[[Column, Column], Column], block: int = 64, depth: int = 2) -> Column:
    """For each of an array of longs, ``op`` (sum or maximum, from 0) over those before it. An ``aggregate`` that gathered
    an array would copy it at every step; here whole blocks are added up first, and blocks of blocks."""
    zero, at = F.lit(0).cast("long"), lambda i: (i - i % block + 1).cast("int")
    some = lambda v, lo, n: F.aggregate(F.slice(v, lo, n), zero, op)
    if not depth:
        return let(values, lambda v: F.transform(v, lambda _, i: some(v, F.lit(1), i)))

    def each(v: Column) -> Column:
        whole = F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: some(v, k * block + 1, F.lit(block))))
        return let(before(whole, op, block, depth - 1), lambda b: F.transform(v, lambda _, i: op(F.get(b, F.floor(i / block).cast("int")), some(v, at(i), i % block))))

    return let(values, each)


def find_all(text: Column, pattern: str) -> Column:
    """All matches as array<struct<s, e, v>>, s and e in code points: the pieces between matches tell where each begins."""
    both = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda v, gap: F.struct(v.alias("v"), F.char_length(gap).cast("long").alias("gap"), F.char_length(v).cast("long").alias("n"))),
    )
    one = lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["v"].alias("v"))
    placed = lambda m: F.zip_with(m, before(F.transform(m, lambda x: x["gap"] + x["n"]), lambda a, b: a + b), one)
    return let(both, placed)


def replaced(text: Column, spans: Column, filler: Callable[[Column, Column, Column], Column], page: int = 1024) -> Column:
    """``text`` with ``filler(span, n, whole)`` in the place of each of ``spans`` (struct with s and e, in order of s); n are
    the code points that no span before has taken, whole tells whether those are all of its own. Pieces are cut out of
    pages of the text, so that none is reached by counting from its beginning."""

    def build(pages: Column) -> Column:
        def piece(lo: Column, hi: Column) -> Column:
            a, b = F.floor(lo / page), F.floor(hi / page)
            return F.substring(F.array_join(F.slice(pages, (a + 1).cast("int"), (b - a + 1).cast("int")), ""), (lo - a * page + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))

        made = lambda x, at: F.when(x["e"] > at, F.array(piece(at, F.greatest(at, x["s"])), filler(x, x["e"] - F.greatest(at, x["s"]), x["s"] >= at))).otherwise(F.array().cast("array<string>"))
        upto = before(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
        pieces = F.array_join(F.flatten(F.zip_with(spans, upto, made)), "")
        return F.concat(pieces, piece(F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0).cast("long")), F.char_length(text).cast("long")))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{page}}}"), F.lit(0)), build)
