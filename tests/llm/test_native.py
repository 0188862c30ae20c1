"""Hilbert shards, line quality, block mix and disclosure against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import frame
from pyspark.sql import functions as F

from tidewatch.llm import block_mix, disclosure, hilbert_shards, line_quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_curve_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        table = hilbert_shards.curve_table(dims, bits)
        cells = sorted(range(len(table)), key=table.__getitem__)
        assert sorted(table) == list(range(len(table)))
        split = lambda c: [(c >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)]
        assert all(sum(abs(p - q) for p, q in zip(split(a), split(b))) == 1 for a, b in zip(cells, cells[1:]))


def test_hilbert_shards(spark):
    rows = frame(spark, clash=True)
    got = hilbert_shards.assign(rows).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(24)]
    assert sum(sizes) == rows.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert hilbert_shards.assign(frame(spark, [])).count() == 0


def test_shards_as_files(spark, tmp_path):
    rows = frame(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert_shards.write(rows, hilbert_shards.assign(rows, 5), str(tmp_path / "s"), 5)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 5


def quality(text):
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    solid = sum(map(len, w))
    return len(w), solid, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rows = frame(spark, clash=True)
    got = Counter(tuple(r[:5]) for r in line_quality.score(rows).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter(quality(r.text or "") for r in rows.collect())
    assert line_quality.score(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("line", "fails"), [
    ("A plain line that ends well.", False), ("He said: 'so be it!' and left", False), ("no mark at all here", True), ("Home | News | About | Contact.", True),
    ("Licensed under CC BY 4.0.", True), ("All rights reserved.", True), ("one### two*** three$$$ four.", True), ("STOP!! IT!! NOW!!", True), ("Price $5 for one of many things here.", False),
])
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(line_quality.line_fails(F.col("x"))).first()[0] is fails


def test_clean_takes_lines_out(spark):
    good = "\n".join(" ".join(f"w{k}n{n}" for n in range(9)) + "." for k in range(8))
    out = line_quality.clean(frame(spark, [(1, good + "\nAll rights reserved.", "en", "s", 1), (2, "Home | News | About.\n" * 30, "en", "s", 2), (3, good, "en", None, 3)], clash=True)).collect()
    assert {r.doc_id: r.text for r in out} == {1: good, 3: good}
    assert {r.n_chars for r in out} == {len(good), 3} and out[0].shard == 2


def test_block_mix(spark):
    rows = frame(spark, clash=True)
    got = block_mix.mix(rows).collect()
    sizes = defaultdict(int)
    for r in rows.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, goal, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
        over = {s for s in order if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    assert all(abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s]) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, block_mix.mix(rows).collect()))
    assert block_mix.mix(frame(spark, [])).count() == 0
    assert block_mix.mix(frame(spark, [(1, None, "en", "s", 0)])).first()["taken"] == 0


def test_seats_are_sainte_lague(spark):
    goal = spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0)], "source string, target double")
    got = {(r.source, r.shard): r.seats for r in block_mix.seats(goal, 3, 30).collect()}
    for shard in (1, 2, 3):
        won = Counter()
        for _ in range(10 * shard):
            best = max("abc", key=lambda s: ({"a": 53, "b": 24, "c": 23}[s] / (2 * won[s] + 1), -ord(s)))
            won[best] += 1
        assert {s: got[s, shard] for s in "abc"} == dict(won)


def test_mix_as_rows(spark):
    rows = frame(spark, clash=True)
    want = sum(r.taken for r in block_mix.mix(rows).collect())
    out = block_mix.apply(rows)
    assert out.columns == rows.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == want


def test_mix_stage_keeps_small_sources(spark):
    """A source of 3 words, target 9, beside blocks of over 20 words."""
    import corpus_pipeline

    rows = [(k, "word " * 1000, "en", "big", 1) for k in range(1500)] + [(5000, "three small words", "en", "tiny", 1)]
    out = corpus_pipeline.mix(spark, frame(spark, rows), "").filter("source = 'tiny'").collect()
    assert [r.text for r in out] == ["three small words"] * 3


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        s = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def spans(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


TRICKY = ["a@b.co_x@c.com", "1.2.3.4.5.6.7.8", "00001.002.3.255 256.1.1.1", "+1 (582) 555-6684+44 20 7946 0958", "4111-1111-1111-1111 4111  1111", "x" * 3000 + "@", "9" * 4000, "1 " * 3000, "é" * 50 + " q@r.st é 10.0.0.1", "+" * 500, "a.b" * 1000 + "@c"]


def test_base_spans(spark, tmp_path):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(TRICKY)]
    df = frame(spark, clash=True).union(frame(spark, rows, clash=True))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.base_sha256) for r in queries.op9_disclosure(spark, str(tmp_path)).collect())
    assert got == Counter((r.doc_id, hashlib.sha256(spans(r.text or "").encode()).hexdigest()) for r in df.collect())
    assert disclosure.find(frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    texts = [f"Text {chr(97 + k) * 4} about nothing. The kingfisher codename belongs to agent@secret.org as of {k}." for k in range(6)]
    texts += [f"Some other text of the {chr(97 + k) * 5} kind belongs here." for k in range(30)]
    df = frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in disclosure.find(df).collect()}
    added = {texts[k][x.s : x.e] for k in range(6) for x in got[k].added}
    assert {"kingfisher", "codename"} <= added and "belongs" not in added and "Text" not in added
    assert all(not got[k].added for k in range(6, 36))
    clean = {r.doc_id: r.text for r in disclosure.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "kingfisher" not in clean[0] and clean[10] == texts[10]


def test_terms_of_an_entity_in_one_text(spark):
    texts = ["The kingfisher codename belongs to agent@secret.org now."] + [f"The other codename belongs to nobody {chr(97 + k % 26) * 4} now." for k in range(400)]
    got = {r.doc_id: r.added for r in disclosure.find(frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()}
    assert {texts[0][x.s : x.e] for x in got[0]} == {"kingfisher"}
    assert not any(got[k] for k in range(1, 401))


def test_disclosing_terms_far_away_and_alone(spark):
    far = "plain words stand here and there " * 6
    texts = [f"Kingfisher. {far} Mail agent@secret.org, {chr(97 + k) * 4}." for k in range(6)] + ["A kingfisher alone, that Kingfisher."] + [far] * 600
    got = {r.doc_id: r.added for r in disclosure.find(frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()}
    assert all((0, 10) in {(x.s, x.e) for x in got[k]} for k in range(6))
    assert [(x.s, x.e) for x in got[6]] == [(2, 12), (25, 35)]
    assert not any(got[k] for k in range(7, 607))


def test_terms_against_brute_force(spark):
    """Random texts with shared and single entities: the added spans are those of the definition, counted by hand."""
    import random
    from math import log

    rng = random.Random(8)
    vocab = [f"term{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)] + ["x9y8z7", "日本語"]
    people = [f"p{k}@mail{k % 3}.org" for k in range(6)] + [f"10.0.{k % 2}.{k}" for k in range(4)] + ["+44 20 7946 0958"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 12)) + (rng.choices(people, k=rng.randint(1, 3)) if rng.random() < 0.4 else [])) for _ in range(300)]
    texts += ["codeword q@secret.org termaa"] * 3 + ["Codeword, alone."]

    def keys(text):
        found = set(re.findall(r"\S+@(?:\S+)", text)) | set(re.findall(r"10\.0\.\d\.\d", text)) | set(re.findall(r"\+44 20 7946 0958", text))
        part = lambda e: e.split("@")[1] if "@" in e else e.rsplit(".", 1)[0] if e[0] == "1" else e[:9]
        return found | {"group " + part(e) for e in found}

    words = lambda t: {w.lower() for w in re.findall(r"[^\W_]{3,}", t)}
    n, n_t, n_e, both = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        n_t.update(words(t))
        n_e.update(keys(t))
        both.update((w, e) for w in words(t) for e in keys(t))
    bad = {w for (w, e), k in both.items() if k < n and k - 0.5 >= n_t[w] / 2 and log((k - 0.5) * n / (n_t[w] * n_e[e])) / -log(k / n) >= 0.8}
    assert {"codeword"} <= bad and len(bad) < 100
    got = {r.doc_id: r for r in disclosure.find(frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        apart = lambda m, own=got[k].base: not any(m.start() < y.e and y.s < m.end() for y in own)
        assert [(x.s, x.e) for x in got[k].added] == [m.span() for m in re.finditer(r"[^\W_]{3,}", t) if m.group().lower() in bad and apart(m)], t


def test_a_log_of_many_addresses(spark):
    """100,000 addresses in one text; the cost of its spans is near linear."""
    import time

    text = " ".join(f"{i % 250}.{i // 250 % 250}.{i // 62500}.4" for i in range(100_000))
    rows = frame(spark, [(1, text, "en", "s", 0)])
    began = time.time()
    got = disclosure.entities(rows).selectExpr("size(spans) n", "spans[99999].s s", "spans[99999].e e").first()
    assert tuple(got) == (100_000, text.rindex(" ") + 1, len(text)) and time.time() - began < 60


def test_sanitise_overlapping_spans(spark):
    rows = [(1, "é +1.2.3.4 and a@b.cd end", "en", "s", 0), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, "mail x@y.zz", "en", "s", 0)] + [(k, "plain", "en", "s", 0) for k in range(10, 40)]
    df = frame(spark, rows, clash=True).selectExpr("*", "1 AS spans", "2 AS base", "3 AS d", "4 AS g")
    out = disclosure.sanitise(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns and len(got) == len(rows)
    assert got[1] == "é +[IP] [...] [EMAIL] [...]" and got[2] is None and got[3] == "" and got[None] == "[...] [EMAIL]"


def test_shards_tell_long_sources_apart(spark):
    """Sources that share their first 40 bytes fall in cells of their own, in byte order; a hot one keeps to one cell."""
    source = lambda k: f"https://example.org/a/very/long/common/path/{'aé日𝄞'[k % 4]}{k:02d}"
    rows = [(k, f"text {k}", "en", source(k % 12), 0) for k in range(240)] + [(1000 + k, "hot", "en", source(3), 0) for k in range(120)] + [(5000, "none", "en", None, 0)]
    df = frame(spark, rows, clash=True)
    meta = hilbert_shards.assign(df, dims=("source",), bits=4).collect()
    by = defaultdict(set)
    for r in meta:
        by[rows[[x[0] for x in rows].index(r.doc_id)][3]].add(r.curve)
    cells = [next(iter(by[s])) for s in sorted((x for x in by if x), key=str.encode)]
    assert all(len(v) == 1 for v in by.values()) and cells == sorted(cells) and len(set(cells)) >= 8


def test_shards_as_files_of_awkward_rows(spark, tmp_path):
    rows = frame(spark, clash=True).withColumn("slot", F.lit(5))
    placed = hilbert_shards.assign(rows, 5)
    hilbert_shards.write(rows, placed, str(tmp_path / "s"), 5)
    out = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text, r.lang) for r in out.collect()) == Counter((r.doc_id, r.text, r.lang) for r in rows.collect())
    assert Counter((r.shard, r.slot) for r in out.collect()) == Counter((r.shard, r.slot) for r in placed.collect())


def test_seats_of_many_sources(spark):
    """2,000 sources of very unequal targets, in houses smaller and larger than their number."""
    import heapq
    import random

    rng = random.Random(4)
    goal = [(f"s{k:04d}", rng.paretovariate(0.7)) for k in range(2000)]
    df = spark.createDataFrame(goal, "source string, target double")
    for blocks in (900, 65_536):
        got = {(r.source, r.shard): r.seats for r in block_mix.seats(df, 4, blocks).collect()}
        heap, won = [(-t, s) for s, t in goal], Counter()
        heapq.heapify(heap)
        target = dict(goal)
        for house in range(1, blocks + 1):
            _, s = heapq.heappop(heap)
            won[s] += 1
            heapq.heappush(heap, (-target[s] / (2 * won[s] + 1), s))
            if house * 4 % blocks == 0:
                shard = house * 4 // blocks
                assert all(got.get((s, shard), 0) == won[s] for s in target), (blocks, shard)


def test_line_rules_count_words_beside_tabs(spark):
    line = "\ta b c d e f g h #i #j k\t"  # 11 words, 2 with symbols: fewer than three in ten, whatever tabs stand beside
    assert spark.createDataFrame([(line + "l. ",)], "x string").select(line_quality.line_fails(F.col("x"))).first()[0] is False
    assert spark.createDataFrame([("\t#a b c.\t",)], "x string").select(line_quality.line_fails(F.col("x"))).first()[0] is True


def test_blocks_are_dealt_to_shards_by_quota(spark):
    """Each shard gets its Sainte-Lague quota of a source's blocks; together the shards are the mix."""
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(20 + k % 30)), "en", ["a", "b", "c", None][min(3, k % 7)], 0) for k in range(300)] + [(900, "tiny source", "en", "z", 0)]
    df = frame(spark, rows, clash=True)
    for options in ({}, {"remainder": True}):
        out = block_mix.apply(df, shard="part", shards=4, blocks=64, **options).collect()
        plain = block_mix.apply(df, shards=4, blocks=64, **options).collect()
        words = lambda found: Counter((r.source, w) for r in found for w in r.text.split())
        assert words(out) == words(plain) and {r.part for r in out} == {1, 2, 3, 4}
        docs, deal = block_mix.plan(df, shards=4, blocks=64, **options)
        quota = {r.source: r.quota for r in docs.select("source", "quota").distinct().collect()}
        blocks = {(r.source, r.shard): r.blocks for r in deal.collect()}
        held = Counter()
        for r in out:
            held[r.source, r.part] += len(r.text.split())
        for s in quota:
            total = sum(blocks.get((s, k), 0) for k in range(1, 5))
            for k in range(1, 5):
                assert not total or abs(held[s, k] - quota[s] * blocks[s, k] / total) <= 1
            assert sum(held[s, k] for k in range(1, 5)) == quota[s]
