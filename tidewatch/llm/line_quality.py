"""Line-first quality rules (native DataFrame functions only).

Every line is judged by itself, failing lines go, and a document that loses too much of its text with them is
rejected. A line fails if it

* has no sentence mark (``.!?`` and the like before a gap or the line's end), or as many ``!!`` as half its words;
* is navigation: bars or angle quotes between at least every sixth word;
* is boilerplate: at most ``BOILERPLATE_WORDS`` words with a licence, cookie, rights or script notice;
* is symbols: at least three in ten words carry one of ``#*$%&|<>``.

Base rules on the whole text: at least 50 words, and at most half the words in repeated 3-word windows. Everything is
one pass over a row, without a shuffle; repeated windows are found by sorting (hash, position), n log n in the words of
one text.

Defined cases: null text counts as empty; a text without words fails the base rules; lines without words are neither
judged nor counted; repeated rows are judged alike; other columns pass through ``clean`` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACES, let, n_words, text_of, words

BOILERPLATE_WORDS = 40
NOTICES = r"(?i)licensed under|all rights reserved|terms of (?:use|service)|privacy policy|accept (?:all )?cookies|enable javascript|creative commons|copyright \d|subscribe to our"
MARK = r"""[.!?…。！？]["'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"""


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``w``."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        repeats = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ((k > 0) & same(s, k, k - 1)) | ((k < F.size(s) - 1) & same(s, k, k + 1)))
        places = let(ordered, lambda s: F.sort_array(F.transform(repeats(s), lambda k: F.get(s, k)["i"])))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(found)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule."""
    n = n_words(line)
    marked = lambda pattern: F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))
    symbols = F.when(line.rlike(r"[#*$%&|<>]"), marked(r"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*") * 10 >= 3 * n).otherwise(False)
    navigation = F.when(line.rlike(r"[|»›>]"), marked(r"[|»›>]") * 6 >= n).otherwise(False)
    shouting = F.when(line.contains("!!"), marked("!!") * 2 >= n).otherwise(False)
    notice = F.when(n <= BOILERPLATE_WORDS, line.rlike(NOTICES)).otherwise(False)
    return ~line.rlike(MARK) | shouting | symbols | navigation | notice


def _solid(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACES, "")).cast("long")


def judged(text: Column) -> Column:
    """Struct of the base counts and the lines' verdicts for one text."""
    lines = F.filter(F.split(text, "\n", -1), has_word)
    kept = F.filter(lines, lambda x: ~line_fails(x))
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(F.translate(text, SPACES, ""), lambda t: F.struct(F.char_length(t).cast("long").alias("word_chars"), (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))).alias("c"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(k).alias("n"))).alias("clean"),
        F.size(lines).alias("n_lines"),
    )


def score(docs: DataFrame, max_loss: float = 0.5, pass_through: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed, loss
    (share of word characters lost with them), clean_text, and the columns named in ``pass_through``."""
    # Through an explode, so that a filter on the verdict is not pushed below and judges every text twice.
    rows = docs.select("doc_id", *[F.col(c).alias(f"own_{c}") for c in pass_through], F.explode(F.array(judged(text_of("text")))).alias("j"))
    failed = (F.col("j.w.n_words") < 50) | (100 * F.col("j.w.n_repeat_words") > 50 * F.col("j.w.n_words"))
    loss = F.when(F.col("j.c.word_chars") == 0, F.lit(0.0)).otherwise(1 - _solid(F.col("j.clean.text")) / F.greatest(F.lit(1), F.col("j.c.word_chars")))
    rows = rows.withColumn("base_failed", failed).withColumn("loss", loss)
    return rows.select(
        "doc_id", *[F.col(f"j.{c}") for c in ("w.n_words", "c.word_chars", "c.n_symbols", "n_dup_lines", "w.n_repeat_words")], "base_failed",
        (~F.col("base_failed") & (F.col("loss") <= max_loss)).alias("kept"), (F.col("j.n_lines") - F.col("j.clean.n")).cast("long").alias("lines_removed"), "loss", F.col("j.clean.text").alias("clean_text"), *[F.col(f"own_{c}") for c in pass_through],
    )


def clean(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """The documents that pass, with failing lines taken out of ``text``; ``n_chars``, if there, follows."""
    rows = score(docs, max_loss, tuple(docs.columns)).filter("kept")
    changed = F.when(F.col("lines_removed") > 0, F.col("clean_text")).otherwise(F.col("own_text"))
    out = {c: F.col(f"own_{c}") for c in docs.columns} | {"text": changed}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("lines_removed") > 0, F.char_length("clean_text").cast("long")).otherwise(F.col("own_n_chars").cast("long"))
    return rows.select(*[v.alias(c) for c, v in out.items()])
