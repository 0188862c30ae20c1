"""Queries with SQL beside DuckDB, and the pipeline beside the stages' own brute force."""

from __future__ import annotations

import random
import re
from pathlib import Path

import duckdb
import pytest
from compare import rows_of
from helpers import frame

import corpus_pipeline
from tidewatch.llm import line_join, line_quality, queries, shared

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_stages(spark, tmp_path):
    """Every stage keeps the columns, takes what the one before kept, and its decisions show."""
    sentence = lambda k: " ".join(f"word{k * 12 + n}" for n in range(12)) + "."
    text = lambda a: "\n".join(sentence(k) for k in range(a, a + 6))
    shared_line = "This very passage stands in several of the documents and is kept in one."
    rows = [(k, text(100 * k) + ("\n" + shared_line if k % 2 else ""), "en", ["x", "y", None][k % 3], 10) for k in range(8)]
    rows += [(50, rows[0][1], "en", "x", 1), (51, rows[1][1].replace("word1201", "wordX"), "en", "x", 1), (60, "Home | News | About.\n" * 40, "en", "x", 1), (61, None, None, None, None), (62, "short text.", "en", "x", 1)]
    frame(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        assert name == "encode" or new.columns == docs.columns
        docs = new
        kept[name] = {r.doc_id: r for r in new.collect()}
    assert set(kept["quality"]) == set(range(8)) | {50, 51}
    assert set(kept["lines"]) == set(range(8)), "copies lose all their lines"
    assert sum(shared_line in r.text for r in kept["lines"].values()) == 1
    assert len(kept["near_duplicates"]) == 8
    assert set(kept["encode"]) == set(kept["mix"]) <= set(range(8))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_duplicates_stage_alone(spark, tmp_path):
    base = " ".join(f"tok{n}" for n in range(4000))
    rows = [(k, base if k == 0 else re.sub(rf"\btok{k * 20}\b", "zz", base), "en", "x", 1) for k in range(4)] + [(9, "entirely other words " * 9, "en", "x", 1)]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 9]


def test_quality_stage_keeps_clean_documents(spark):
    rows = [(k, "\n".join(" ".join(f"w{k}n{n}i{i}" for i in range(9)) + ", of it." for n in range(9)), "en", "x", 1) for k in range(20)]
    assert line_quality.clean(frame(spark, rows)).count() == 20


def test_near_duplicates_at_the_threshold(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        base = [f"b{k}w{n}" for n in range(rng.choice([4, 60, 300]))]
        rows += [(10 * k + c, " ".join(f"x{c}" if c and rng.random() < 0.01 * c else w for w in base), "en", "x", 1) for c in range(4)]
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows for w in [r[1].split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("rows", ["awkward", "empty", "nulls"])
def test_stages_on_awkward_tables(spark, tmp_path, rows):
    """Every stage by itself on nulls, empty and long texts, ties, repeated rows, no rows, and clashing extra columns."""
    table = {"awkward": None, "empty": [], "nulls": [(None, None, None, None, None)] * 3}[rows]
    docs = frame(spark, table, clash=True).selectExpr("*", "'x' AS source_size", "1 AS root", "2 AS cls", "3 AS tidewatch", "4 AS g", "5 AS d", "6 AS quota", "7 AS unit")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "encode":
            assert len(got) == n
        else:
            assert out.columns == docs.columns and all(r["quota"] == 6 for r in got)
            assert name == "mix" or len(got) <= n
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 3 * n


def test_near_duplicates_of_documents_without_words(spark, tmp_path):
    rows = [(5, None, "en", "x", 1), (3, "", "en", "x", 1), (4, " \n", "en", "x", 1), (None, "", "en", "x", 1), (7, "a word", "en", "x", 1), (7, "a word", "en", "x", 1), (8, "A  WORD", "en", "x", 1)]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [3, 7]


@pytest.mark.parametrize("step", ["trie", "join", "both"])
def test_near_duplicates_by_trie_and_join(spark, tmp_path, monkeypatch, step):
    """The SimHash trie alone finds copies with a word or two changed, the join alone finds all, both give what the join
    gives; what is alike in its fingerprint only is kept."""
    base = [[f"b{k}w{n}" for n in range(400)] for k in range(3)]
    near, far = [*base[0][:200], "zz", *base[0][201:]], [("zz" if n % 50 == 7 else w) for n, w in enumerate(base[1])]
    rows = [(k, " ".join(w), "en", "x", 1) for k, w in enumerate([*base, near, far])]
    empty = lambda *a: spark.createDataFrame([], "a long, b long")
    if step == "trie":
        monkeypatch.setattr(line_join, "_pairs", empty)
    if step == "join":
        monkeypatch.setattr(line_join, "_trie_pairs", empty)
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == ([0, 1, 2, 4] if step == "trie" else [0, 1, 2])


def test_lines_stage_writes_links_only(spark, tmp_path, monkeypatch):
    """What `lines` writes for itself follows the lines and their links, not the pairs that share a rare word."""
    rng = random.Random(8)
    lines = [rng.sample([f"v{k}" for k in range(400)], 150) for _ in range(300)]
    df = frame(spark, [(k, " ".join(x), "en", "x", 0) for k, x in enumerate([*lines, [*lines[0], "more"]])])
    most, real = [], shared.table

    def table(df, name):
        out = real(df, name)
        most.append(out.filter("block is null").count() if name == "line-survey" else out.count())
        return out

    monkeypatch.setattr(shared, "table", table)
    assert sorted(r.doc_id for r in corpus_pipeline.lines(spark, df, str(tmp_path)).collect()) == list(range(300))
    assert max(most) == 301 and min(most) == 1


def test_lines_stage_of_a_family(spark, tmp_path, monkeypatch):
    """Near copies of one line cost `lines` a row each and not one for each pair of them, whatever the order of the rows."""
    rng = random.Random(5)
    base = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(base if k == 3 else [w if rng.random() > 0.02 else f"own{k}" for w in base]), "en", "x", 0) for k in range(3, 123)]
    df, most, real = frame(spark, rows[::-1]), [], shared.table

    def table(df, name):
        out = real(df, name)
        most.append(out.filter("block is null").count() if name == "line-survey" else out.count())
        return out

    monkeypatch.setattr(shared, "table", table)
    assert [r.doc_id for r in corpus_pipeline.lines(spark, df, str(tmp_path)).collect()] == [3]
    assert max(most) == 120


@pytest.mark.parametrize("grid", [1, 3])
def test_late_classes_are_those_of_the_links(spark, monkeypatch, grid):
    """A class is late if one of its links is to a class that begins earlier: random families, ids out of order, nulls and
    copies, rows of one id, with hot tokens in cells and without."""
    rng = random.Random(grid)
    rows = []
    for f in range(12):
        base = [f"f{f % 4}w{n}" for n in range(rng.choice([5, 12, 40]))] + [f"own{f}"]
        for _ in range(9):
            line = lambda: " ".join(w for w in base if rng.random() > 0.07)  # noqa: B023, E731
            rows.append((rng.choice([None, *range(-40, 40)]), "\n".join([line(), "w of it", line()]), "en", "x", 0))
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    df = frame(spark, rows).repartition(3)
    survey = line_join._survey(df)
    first = {r.cls: (r.d, r.l) for r in survey.filter("cls is not null").selectExpr("cls", f"struct(coalesce(doc_id, {-(1 << 63)}) d, line l) p").groupBy("cls").agg({"p": "min"}).selectExpr("cls", "`min(p)`.d d", "`min(p)`.l l").collect()}
    both = [(r.a, r.b) for r in line_join.links(df, survey).collect()]
    if grid > 1:
        monkeypatch.setattr(line_join, "HOT", 0)
    want = {x for a, b in both for x, y in ((a, b), (b, a)) if first[y] < first[x]}
    assert {r.cls for r in line_join.late_classes(df, survey, grid=grid).collect()} == want and 20 < len(want) < len(first)


def test_document_candidates_stay_in_their_buckets(spark, tmp_path, monkeypatch):
    """Documents that share passages only are no candidates beyond the bucket that finds them; a near copy is found."""
    rng = random.Random(6)
    pool = [" ".join(f"p{k}w{n}" for n in range(40)) for k in range(30)]
    texts = [" ".join(rng.sample(pool, 10)) for _ in range(60)]
    rows = [(k, t, "en", "x", 0) for k, t in enumerate([*texts, texts[0].replace("w20", "zz", 3)])]
    counts, real = {}, shared.table

    def table(df, name):
        out = real(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(shared, "table", table)
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))
    assert counts["line-pairs"] == 1
