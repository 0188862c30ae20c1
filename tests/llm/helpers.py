"""Small tables with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; they must not matter.
CLASH = {"h": 1, "shard": 2, "size": 3, "line": 4, "fp": 5, "votes": 6, "start": 7, "key": 8, "bucket": 9}


def awkward() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiourst") for _ in range(rng.randint(2, 7)))
    vocab = [word() for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    texts = ["\n".join(line(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    near = [" ".join("zzz" if rng.random() < 0.02 else w for w in t.split(" ")) for t in texts[:12]]
    texts += near + texts[:5]
    texts += [None, "", " ", "\n\n", "\t \x0b\n", "a", "a b", "a b c d", "ÀÉ ß Σς İ  x y", "<|endoftext|> and <|startoftext|>", "x" * 5000, " ".join(["w"] * 30000), line(9000), "a  b   c\n\n d \n e"]
    texts += ["mail Bob.X+1@ex-ample.co.uk, call +1 (582) 555-6684 or 1.2.3.4 and 300.1.1.1", "card 4111 1111 1111 1111 and 4111111111111112", "a@b.c@d.e 1.2.3.4.5.6.7.8 +123 +12345678901"]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(t) if t is not None else None) for k, t in enumerate(texts)]
    return rows + [(None, texts[3], "en", "s1", 5), (7, texts[8], None, None, None), rows[9], rows[9]]


def frame(spark, rows=None, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()}) if clash else df
