"""Token files, toxicity, line join, top-k, SimHash and BPE against brute force or the library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import frame

from tidewatch.llm import histogram_topk, line_join, pair_bpe, queries, shared, simhash_trie, token_files, toxicity

BYTES, WORDS = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def fuzz(n: int):
    rng = random.Random(1)
    letters = list("abcXYZ'sé中 \n\t 　\x1c\x0bΣσİñ12½,.!<|́e😀ﬁ") + ["<|endoftext|>", "<|startoftext|>", "  ", "'ll", "'S", " the", "tion"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_piece_encoder_is_the_library():
    enc, lib = token_files.PieceEncoder(BYTES), library(BYTES)
    for text in fuzz(2500):
        assert np.frombuffer(enc.encode(text), enc.kind).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark):
    rows = frame(spark, clash=True)
    at = shared.local_folder(spark, "test")
    got = token_files.read(token_files.write(rows, at, BYTES, 2), at).orderBy("start").collect()
    lib, start, want = library(BYTES), 0, []
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    empty = shared.local_folder(spark, "test")
    assert token_files.read(token_files.write(frame(spark, []), empty, BYTES, 2), empty).count() == 0


def test_pair_index_is_the_library():
    enc, lib = pair_bpe.Encoder(WORDS), library(WORDS)
    texts = fuzz(2500) + ["lower lowest " * 5, "aaaa aaaaaaa", "x" * 3000]
    for text, (ids, back) in zip(texts, enc.many(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        ids, back = ids.decode(), back.decode()
        assert ids == " ".join(map(str, want)), text
        assert back == lib.decode(want, skip_special_tokens=False) == enc.decode(want)


def test_pair_bpe_rows(spark):
    rows, lib = frame(spark, clash=True), library(WORDS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in pair_bpe.digest(rows, WORDS).collect()) == want
    arrays = pair_bpe.encode(rows, WORDS).collect()
    assert Counter((r.doc_id, len(r.ids)) for r in arrays) == Counter((k[0], k[1]) for k in want.elements())
    assert pair_bpe.digest(frame(spark, []), WORDS).count() == 0


def lower(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def removed(rows):
    lines = sorted({(-(1 << 63) if r.doc_id is None else r.doc_id, n, r.text or "", frozenset(lower(x))) for r in rows for n, x in enumerate((r.text or "").split("\n"))}, key=lambda x: x[:3])
    first = {}
    for d, n, _, s in lines:
        if s:
            first.setdefault(s, (d, n))
    near = {s: min((first[q] for q in first if q != s and 9 * len(s & q) >= 4 * (len(s) + len(q))), default=None) for s in first}
    out = {}
    for d, n, t, s in lines:
        out.setdefault((d, t), [])
        if s and (first[s] < (d, n) or (near[s] and near[s] < (d, n))):
            out[d, t].append(n)
    return out


def test_line_join(spark):
    rows = frame(spark, clash=True)
    texts = {(r.doc_id, r.text or "") for r in rows.collect()}
    want = removed(rows.collect())
    got = line_join.removed_lines(rows).collect()
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in got) == Counter((i, t.count("\n") + 1, tuple(want[-(1 << 63) if i is None else i, t])) for i, t in texts)
    assert sum(map(len, want.values())) > 20
    out = {(r.doc_id, r.text) for r in line_join.dedup_lines(rows).collect()}
    for i, t in texts:
        gone = want[-(1 << 63) if i is None else i, t]
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        assert not gone or ((i, left) in out) == bool(WORD.search(left))
    assert line_join.removed_lines(frame(spark, [])).count() == 0


def test_bucket_pairs_lose_nothing():
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(40, rng.integers(4, 14), replace=False).tolist()) for _ in range(150)]
    rank = {t: k for k, t in enumerate(rng.permutation(40).tolist())}
    entries = []
    for c, s in enumerate(sets):
        order = sorted(s, key=rank.get)
        sig = 0
        for t in s:
            sig ^= 1 << (t % 64)
        for pos, t in enumerate(order[: len(s) - (4 * len(s) + 4) // 5 + 1]):
            entries.append((t, c, sig, len(s), pos))
    cols = [np.asarray(c, k) for c, k in zip(zip(*entries), ("u4", "u8", "u8", "u4", "u4"))]
    found = {(int(a), int(b)) for x, y in line_join.bucket_pairs(*cols) for a, b in zip(x, y)}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert want and want <= found


def simhash(text: str) -> int:
    from xxhash import xxh64_intdigest

    w = lower(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    ones = Counter(b for s in shingles for h in [xxh64_intdigest(s.encode(), seed=42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def test_simhash(spark):
    rows = frame(spark, clash=True)
    docs = rows.collect()
    fp = {r.text: simhash(r.text or "") for r in docs}
    values = sorted(set(fp.values()))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for r in docs:
        if r.doc_id is not None:
            k = root(fp[r.text])
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_trie.components(rows).collect())
    assert got == Counter((r.doc_id, fp[r.text], least.get(root(fp[r.text]))) for r in docs)
    kept = simhash_trie.keep_first(rows).collect()
    assert len(kept) == len({root(v) for v in values}) and {r.doc_id for r in kept} == set(least.values())
    assert simhash_trie.components(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("part", "inner"), [(22, 1), (32, 2), (64, 4)])
def test_trie_join(part, inner):
    rng = np.random.default_rng(0)
    one = lambda: np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ one() ^ one() for _ in range(5)]))
    near = lambda a, b: (int(a) ^ int(b)).bit_count() <= 4 and ((int(a) ^ int(b)) >> (64 - part)).bit_count() <= inner
    pairs = lambda *a: {p for i, j in simhash_trie.trie_links(*a, 4, part, inner) for p in zip(i.tolist(), j.tolist())}
    assert pairs(x, None) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near(x[i], x[j])}
    a, b = x[::2], x[1::2]
    assert pairs(a, b) == {(i, j) for i in range(len(a)) for j in range(len(b)) if near(a[i], b[j])}


def test_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(1, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    up = {v: v for e in edges for v in e if e[0] != e[1]}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.u: r.root for r in simhash_trie.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: root(v) for v in up if root(v) != v}
    assert simhash_trie.stars(spark.createDataFrame([], "u long, v long")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(size=4)]) for k in range(300)]
    rows += [(300 + k, rows[50][1]) for k in range(40)] + [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("nan")] * 4), (1150, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[1][1]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = [(q, n + 1, i, -s) for q in good if q % 50 == 0 for n, (s, i) in enumerate(sorted((-int(good[q] @ good[i]), i) for i in good if i != q)[:5])]
    got = sorted(tuple(r) for r in histogram_topk.search(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)
    assert histogram_topk.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in histogram_topk.search(few).orderBy("rank").select("vec_id", "score").collect()] == [(2, 65536), (1, 0)]


def test_topk_in_a_dense_cluster(spark):
    """Over ENOUGH * k rows in the first round's kth bin, so a second round starts from a positive lower edge."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    near = [centre + 0.02 * rng.normal(size=16) for _ in range(1200)] + [rng.normal(size=16) for _ in range(300)]
    rows = [(k, [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(near)]
    q = np.floor(256 * np.asarray([v for _, v in rows], np.float32).astype(float)).astype(int)
    want = [(a, n + 1, b, -s) for a in range(0, len(q), 50) for n, (s, b) in enumerate(sorted((-int(q[a] @ q[b]), b) for b in range(len(q)) if b != a)[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in histogram_topk.search(df).select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_toxicity(spark):
    rng = random.Random(6)
    clean = ["river", "stone", "cloud", "green", "house", "paper", "table", "light", "water", "field", "music", "north"]
    bad = ["vilescum", "grubhead", "rotbrain"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(clean) for _ in range(40)]
        y = k % 5 == 0
        if y:
            words[rng.randrange(40)] = rng.choice(bad)
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((k, " ".join(words) + ".", "en", "s", 0))
        labels.append((k, None, int(y)))
    rows += [(900, None, None, None, None), (901, "", None, None, 0), (902, "ho ho " * 20000, None, None, 0), rows[3]]
    df = frame(spark, rows, clash=True)
    lab = spark.createDataFrame(labels + [(902, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, lab).collect()
    assert len(got) == len(rows)
    truth = {k: y for k, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    flipped = spark.createDataFrame([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(df, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)
    assert toxicity.score(frame(spark, []), lab).count() == 0
    assert {r.predicted for r in toxicity.score(df, lab.limit(0)).collect()} == {0}


def test_topk_with_repeated_ids(spark, tmp_path):
    """The SQL of the query keeps rows that share an id; so does the search."""
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.normal(size=4)], 0) for k in rng.integers(0, 260, 700)]
    rows += [rows[3]] * 9 + [(100, rows[5][1], 0)] * 7 + [(100, rows[6][1], 0), (None, rows[6][1], 0), (150, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op7_histogram_topk"]).select("query_id, rank, vec_id, score").fetchall()
    got = queries.op7_histogram_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 30


def test_topk_survives_tasks_that_run_again(spark, monkeypatch):
    """Every task that writes a block's file is run twice, as after a lost executor; the ranges stay the same."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=8)
    rows = [(k, [float(x) for x in centre + 0.02 * rng.normal(size=8)]) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plain = sorted(tuple(r) for r in histogram_topk.search(df).collect())

    class Twice:
        def __init__(self, grouped):
            self.grouped = grouped

        def applyInPandas(self, f, schema):
            return self.grouped.applyInPandas(lambda key, pdf: (f(key, pdf), f(key, pdf))[1], schema)

    real = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: Twice(real(self, *c)) if c == ("block",) else real(self, *c))
    assert sorted(tuple(r) for r in histogram_topk.search(df).collect()) == plain and len(plain) == 150


def test_line_join_in_cells(spark):
    """Hot tokens spread over a triangle of cells give the same links; so do long texts cut into pieces."""
    rows = frame(spark)
    survey = line_join._survey(rows)
    plain = sorted(tuple(r) for r in line_join.links(rows, survey).collect())
    hot, piece = line_join.HOT, line_join.PIECE
    text = b" ".join(b"word%d\n" % k if k % 7 == 0 else b"w%d" % k for k in range(3000))
    whole = line_join.hashed_words(text)
    try:
        line_join.HOT, line_join.PIECE = 0, 64
        assert sorted(tuple(r) for r in line_join.links(rows, survey, grid=3).collect()) == plain and plain
        assert all((a == b).all() for a, b in zip(line_join.hashed_words(text), whole))
    finally:
        line_join.HOT, line_join.PIECE = hot, piece


def test_line_classes(spark):
    rows = [(1, "one two three four five\nsix seven", "en", "s", 0), (2, "five four three two one\nother words\n", "en", "s", 0), (3, "one two three four five more", "en", "s", 0)]
    got = {r.doc_id: [tuple(x) for x in r.classes] for r in line_join.removed_lines(frame(spark, rows)).collect()}
    assert got == {1: [(0, 1, 0, 1), (1, 1, 1, 0)], 2: [(0, 1, 0, 1), (1, 2, 1, 0)], 3: [(0, 3, 0, 1)]}


def test_toxicity_learns_from_unlabelled_documents(spark):
    """Few labelled rows let chance words pass for toxic ones; the label model, which sees all documents, mends that, and
    the classifier is trained on its posteriors. Without its rounds the held-out rows get worse."""
    rng = random.Random(11)
    name = lambda k: "".join(chr(97 + (k * 7 + j * j + 3 * j) % 26) for j in range(4)) + chr(97 + k // 26) + chr(97 + k % 26)
    noise, bad = [name(k) for k in range(300)], ["vorak", "mudwit", "gnashel", "brutik", "slobor", "crudon", "fetchal", "dirgot", "krampo", "zelnak"]
    rows, labels = [], []
    for k in range(3000):
        y = k % 6 == 0
        words = [w for w in noise if rng.random() < 0.06] + (rng.sample(bad, 2) if y else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "s", 0))
        if k < 150 or zlib.crc32(str(k).encode()) % 3 == 1:
            labels.append((k, None, int(y)))
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    loss = {}
    for rounds in (0, 6):
        held = [(r.score, int(r.doc_id % 6 == 0)) for r in toxicity.score(df, lab, rounds=rounds).collect() if r.held_out]
        loss[rounds] = sum((p - y) ** 2 for p, y in held) / len(held)
    assert loss[6] < 0.8 * loss[0], loss


def test_dependency_tree():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    a = (rng.random(4000) < np.where(y, 0.5, 0.1)).astype(float)
    b = np.where(rng.random(4000) < 0.05, 1 - a, a)  # nearly a
    c = (rng.random(4000) < np.where(y, 0.4, 0.2)).astype(float)  # independent given the class
    x = np.stack([a, b, c], axis=1)
    model = toxicity.LabelModel(x, y.astype(int))
    assert sorted(model.parent.tolist()).count(-1) == 2 and model.parent[2] == -1 and {int(model.parent[0]), int(model.parent[1])} <= {-1, 0, 1}
    p = model.posterior(np.asarray([[1.0, 1, 0], [1, 0, 0], [0, 0, 0], [1, 1, 1]]))
    alone = toxicity.LabelModel(x[:, [0, 2]], y.astype(int)).posterior(np.asarray([[1.0, 0]]))[0]
    assert abs(p[0] - alone) < 0.03, "a second voter that says the same adds nothing"
    assert p[3] > p[0] > p[2]


def test_only_links_leave_the_buckets(spark, monkeypatch):
    """Long lines over few words have thousands of candidates, which a 64-bit signature does not tell apart; none but the
    links is written, and the files of sets are gone then."""
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(400)]
    lines = [rng.sample(vocab, 150) for _ in range(300)]
    lines += [[w for w in x if rng.random() > 0.1] + ["v1", f"own{k}"] for k, x in enumerate(lines[:60])]
    df = frame(spark, [(k, " ".join(x), "en", "s", 0) for k, x in enumerate(lines)])
    sets = [set(x) for x in lines]
    want = sum(9 * len(a & b) >= 4 * (len(a) + len(b)) for k, a in enumerate(sets) for b in sets[:k])
    survey, rows, real = line_join._survey(df), {}, shared.table

    def table(df, name):
        out = real(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(shared, "table", table)
    made = shared.made()
    assert line_join.links(df, survey).count() == want > 30
    assert rows and max(rows.values()) == want
    assert not any(Path(uri.removeprefix("file://"), f).exists() for uri in shared._MADE[made:] for f in ("level-000", "bits-000"))


def test_marked_words_share_ids():
    """A word with a mark behind is made of the word's ids and the mark's, kept once each."""
    enc, lib = token_files.PieceEncoder(BYTES), library(BYTES)
    for text in ("an oddwordx, oddwordx; oddwordx. oddwordx", "Strangüß; no", "oneword,", " oneword, two.\nthree; \n four,"):
        assert enc.encode(text) == enc.pack(lib.encode(text, add_special_tokens=False).ids)
    assert {"oddwordx", "oddwordx,", "two"} <= enc.keys() and "Strangüß" in enc.bare
