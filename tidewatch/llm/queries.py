"""The queries opN_<name> and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_mix, disclosure, hilbert_shards, histogram_topk, line_join, line_quality, pair_bpe, shared, simhash_trie, token_files, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared.local_folder(spark, "token-files")
    parts = token_files.write(_read(spark, sf_dir, "documents"), at, tokenizer("byte_bpe_50k.json"), 2)
    return token_files.read(parts, at)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.assign(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_quality.score(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed")


def op5_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_mix.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.removed_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_links", "removed", "classes")


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_topk.search(_read(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_trie.components(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = disclosure.find(_read(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", *[number(k).alias(f"n_{kind}") for k, kind in enumerate(disclosure.KINDS[:4])], F.sha2(disclosure.joined(F.col("base")), 256).alias("base_sha256"), disclosure.joined(F.sort_array(F.concat("base", "added"))).alias("spans"))


def op10_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.digest(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_hilbert_shards, op3_toxicity, op4_line_quality, op5_block_mix, op6_line_join, op7_histogram_topk, op8_simhash_trie, op9_disclosure, op10_pair_bpe)}

_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k FROM g),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM h) WHERE n > 1),
cover AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT r, x, len(string_split_regex(trim(x), '[\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (SELECT r, x, (NOT regexp_matches(x, '[.!?…。！？]["''”’»)\]]*(?:[\x20\x09-\x0D]|\z)'))
    OR (contains(x, '!!') AND len(regexp_extract_all(x, '!!')) * 2 >= n)
    OR (regexp_matches(x, '[#*$%&|<>]') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*')) * 10 >= 3 * n)
    OR (regexp_matches(x, '[|»›>]') AND len(regexp_extract_all(x, '[|»›>]')) * 6 >= n)
    OR (n <= {line_quality.BOILERPLATE_WORDS} AND regexp_matches(x, '{line_quality.NOTICES}')) AS bad FROM m),
s AS (SELECT r, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (bad) AS gone, coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) FILTER (NOT bad), 0) AS solid FROM f GROUP BY r),
a AS (SELECT d.r, d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS lines_removed, coalesce(solid, 0) AS solid
    FROM d JOIN w USING (r) LEFT JOIN cover USING (r) LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (word_chars = 0 OR 1 - solid / word_chars <= 0.5) AS kept, lines_removed FROM b
"""

_MIX_SQL = rf"""
WITH m AS (SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source) - 1) % 3]::DOUBLE AS weight FROM m GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM z),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM c WINDOW o AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, cap / weight) AS water FROM v WHERE level * weight <= cap),
goal AS (SELECT source, source_size, coalesce(least(cap, water * weight), cap)::DOUBLE AS target FROM v, water),
base AS (SELECT source, target, count(*) OVER () AS n, floor(target * {block_mix.BLOCKS} / sum(target) OVER () + 0.5)::BIGINT AS rounded FROM goal WHERE target > 0),
cand AS (SELECT source, target, greatest(0, rounded - n) AS first, unnest(range(greatest(0, rounded - n), rounded + n + 1)) AS seat FROM base),
place AS (SELECT *, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, source, seat) AS place FROM cand),
seats AS (SELECT source, max(first) + count(*) FILTER (place <= {block_mix.BLOCKS} - (SELECT sum(greatest(0, rounded - n)) FROM base)) AS seats FROM place GROUP BY source),
unit AS (SELECT greatest(1e-9::DOUBLE, sum(source_size) / {block_mix.BLOCKS}::DOUBLE) AS unit FROM goal),
q AS (SELECT source, source_size, target, least(source_size * 3, round(coalesce(seats, 0) * unit)::BIGINT) AS quota,
    floor(unit * (('0x' || substr(md5('7/' || source), 1, 13))::BIGINT % greatest(1, floor(source_size / unit)::BIGINT)))::BIGINT AS start FROM goal LEFT JOIN seats USING (source), unit),
p AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS place FROM m),
e AS (SELECT *, quota // greatest(source_size, 1) AS epochs, start + quota - source_size * (quota // greatest(source_size, 1)) AS stop FROM p JOIN q USING (source))
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(place + size, stop, source_size) - greatest(place, start)) + greatest(0, least(place + size, stop - source_size) - greatest(place, 0)))::BIGINT AS taken FROM e
"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

ORACLES = {"op7_histogram_topk": _TOPK_SQL, "op4_line_quality": _QUALITY_SQL, "op5_block_mix": _MIX_SQL}
