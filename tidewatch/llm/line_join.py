"""Line deduplication by an exact set-similarity join.

A line is the set of its words, A-Z lower-cased. Lines are compared by Jaccard similarity over those sets; a line goes
if an earlier one (smaller doc_id, then line number) has a similarity of ``4/5`` or more. Tokens of a line are ordered
by rarity over the whole corpus, and two lines can only match if the first n - ceil(0.8 n) + 1 of each share a token
(prefix filter), their sizes are within the threshold (length filter), enough tokens may follow the shared one
(positional filter) and a 64-bit parity signature does not already show too many differing tokens. What is left is
verified on the whole sets.

Equal sets form a class, by a 64-bit hash of the set; only classes enter the join, so thousands of copies of a line
cost what one does. Sets below four tokens can only match equal sets. Words are vectorised 64-bit hashes, 58 bits of
which identify a token: sets are exact up to a collision of those.

Rarity needs no token table. Every document adds to a sketch of ``CELLS`` counters, whose size is fixed and which tasks
map from the shared folder; any order gives the same matches, a rough one only a few more candidates. Postings travel as
packed columns, a row per task and bucket, so the engine moves few rows. The task that sends a line's postings writes its
set, once a class, to a file of the shared folder; buckets map these files and verify pairs where they find them, by a
256-bit parity signature and then on the sets, so that only links leave a bucket. In a vocabulary that grows less than
the corpus candidates grow with its square, links as the copies do: those of a family of near copies with its square.
``dedup_lines`` needs no links, only which lines have one to an earlier line; there buckets stop at a class's first such
link, and one number a class leaves them. The sets of documents are long; their files have a 1,024-bit signature only, by
which a bucket drops nearly all candidates that are none. The rest travel as two numbers, and the sets of the documents
named are fetched by one more scan through a mapped bitmap of their texts. The number of buckets and blocks follows the
prefix entries, and entries of the most frequent tokens are spread over a triangle of cells, so no token fills one task.
Files go as soon as the links are written. No text is shuffled, nothing per line reaches the driver. With ``keep_first``
a document is one line and its tokens are runs of five words; pairs that a SimHash trie finds are verified beside those
of the join.

Defined cases: null text is one empty line; lines without words are never removed; a null id counts as the lowest; rows
that repeat an id and text are one document; rows that share an id but not a text are told apart by a hash of the text,
and lines at the same place do not remove one another; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import shutil
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import shared
from .words import text_of

CELLS, BLOCKS = 1 << 22, 16
#: Bytes of text hashed at once, entries held before they are sent, pairs compared at once.
CHUNK, HELD, PAIRS = 1 << 16, 1 << 17, 1 << 18
#: Bytes of a long text hashed at once; prefix entries of a bucket, on average; the level from which a token is hot (the
#: sketch's counters end there).
PIECE, BUCKET, HOT = 1 << 19, 1 << 20, 63
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)  # A-Z count as a-z
_WORD = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64) for base in (_P, _PINV)]
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(buf: bytes) -> Iterator[bytes]:
    """``buf`` cut into pieces of about PIECE bytes; each but the last ends with a space or line end."""
    lo = 0
    while len(buf) - lo > PIECE:
        gap = _GAP.search(buf, lo + PIECE)
        if not gap:
            break
        yield buf[lo : gap.end()]
        lo = gap.end()
    yield buf[lo:]


def hashed_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """58-bit token and line number of every word of ``buf``."""
    if len(buf) <= PIECE:
        return _hashed(buf)
    tokens, lines, at = [], [], 0
    for piece in _pieces(buf):
        token, line = _hashed(piece)
        tokens.append(token)
        lines.append(line + at)
        at += piece.count(b"\n")
    return np.concatenate(tokens), np.concatenate(lines)


def _hashed(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(buf, np.uint8)
    n = len(raw)
    word = np.zeros(n + 2, bool)
    np.take(_WORD, raw, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.take(_VALUE, raw, out=sums[1:])
    sums[1:] *= up[:n]
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * down[starts]
    breaks = np.searchsorted(starts, np.flatnonzero(raw == 10))
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate([[0], breaks, [len(starts)]])))
    return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(6), line


def shingled(token: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every run of ``size`` words of a line, or of all its words where there are fewer."""
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    counts = np.diff(np.append(begins, len(line)))
    tokens, lines = [], []
    for k in range(1, size + 1):
        if k < size:
            at = begins[counts == k]
        else:
            at = np.flatnonzero(line[: max(0, len(line) - size + 1)] == line[size - 1 :])
        h = np.full(len(at), k, np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(_P) + token[at + i])
        tokens.append(h >> np.uint64(6))
        lines.append(line[at])
    return np.concatenate(tokens), np.concatenate(lines)


def line_sets(buf: bytes, level: np.ndarray | None = None, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, line, place): the set of every line, tokens in order of ``level`` (by cell) and then of their hash. ``size``:
    of the runs of words that are tokens, or 0 for words."""
    token, line = hashed_words(buf)
    if size:
        token, line = shingled(token, line, size)
    if level is not None:
        token = token | (level[(token & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58))
    by = np.argsort(token)
    own = line[by]
    by = by[np.argsort(own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own, kind="stable")]
    token, line = token[by], line[by]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    token, line = token[new], line[new]
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    place = np.arange(len(line)) - np.repeat(begins, np.diff(np.append(begins, len(line))))
    return token, line, place


def classes_of(token: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, line, size, class) of each line with words; a class is a hash of the set, whatever the order."""
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    sizes = np.diff(np.append(begins, len(line)))
    if not len(begins):
        return begins, line, sizes, token
    total = np.add.reduceat(_mix((token & np.uint64((1 << 58) - 1)) + np.uint64(_P)), begins)
    return begins, line[begins], sizes, _mix(total + sizes.astype(np.uint64))


def _chunks(batch: pa.RecordBatch, size: int = 0) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, their texts joined by newlines, first line of each row); with a ``size``, a text is one line."""
    texts, lo, held, own = batch.column("text"), 0, 0, []
    for k, t in enumerate(texts):
        own.append((t.as_py() or "").encode())
        if size:
            own[-1] = own[-1].replace(b"\n", b" ")
        held += len(own[-1]) + 1
        if held >= CHUNK or k == len(texts) - 1:
            first = np.cumsum([0] + [b.count(b"\n") + 1 for b in own])
            yield lo, k + 1, b"\n".join(own), first
            lo, held, own = k + 1, 0, []


def _scan(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _simhash(token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each set, as a signed long: a bit is set where over half of the tokens' hashes have it."""
    ones, row = np.zeros((len(sizes), 64), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(token), HELD // 4):
        own = row[lo : lo + HELD // 4]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(_mix(token[lo : lo + HELD // 4] + np.uint64(_P)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _planes(column: np.ndarray) -> bytes:
    """A column's first bytes, then its second ones and so on: those that hardly differ then compress to nothing."""
    return column.view(np.uint8).reshape(len(column), -1).T.tobytes()


def _column(raw, kind: str, n: int, at: int = 0) -> np.ndarray:
    """The column that ``_planes`` put into ``raw``."""
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind)[:, 0]


def _survey(docs: DataFrame, size: int = 0) -> DataFrame:
    """Lines (doc_id, h, line, cls, n, fp; cls null without words; fp, the SimHash of its set, of documents only) and sketch
    blocks (block, salt, data) in one table."""
    names = ["doc_id", "h", "line", "cls", "n", "fp", "block", "salt", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n_held = np.zeros(CELLS, np.uint32), [], 0
        for batch in batches:
            made = []
            for lo, hi, buf, first in _chunks(batch, size):
                token, line, _ = line_sets(buf, size=size)
                held.append((token & np.uint64(CELLS - 1)).astype(np.int32))
                n_held += len(token)
                if n_held > CELLS // 4:
                    np.add.at(counts, np.concatenate(held), np.uint32(1))
                    held, n_held = [], 0
                _, own, sizes, cls = classes_of(token, line)
                n = first[-1]
                c, words, has, fp = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, np.int64)
                c[own], words[own], has[own] = cls.view(np.int64), sizes, True
                if size:
                    fp[own] = _simhash(token, sizes)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                made.append((row + lo, (np.arange(n) - first[row]).astype(np.int32), c, has, words, fp))
            if made:
                row, place, c, has, words, fp = (np.concatenate(x) for x in zip(*made))
                none = [pa.nulls(len(row), k) for k in kinds[6:]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("h").take(pa.array(row)), pa.array(place), pa.array(c, mask=~has), pa.array(words), pa.array(fp, mask=~has | (not size)), *none], names)
        if held:
            np.add.at(counts, np.concatenate(held), np.uint32(1))
        if counts.any():
            salt = TaskContext.get().partitionId()
            wide = CELLS // BLOCKS
            data = [_planes(np.minimum(counts[k * wide : (k + 1) * wide], 0xFFFF).astype("<u2")) for k in range(BLOCKS)]
            cols = [pa.nulls(BLOCKS, k) for k in kinds[:6]] + [pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return shared.table(_scan(docs).mapInArrow(shared.trimmed(task), "doc_id long, h long, line int, cls long, n int, fp long, block int, salt int, data binary"), "line-survey")


def _write_levels(survey: DataFrame, at: str) -> None:
    """Add up the sketch, block by block, and write a 6-bit rarity level per cell; rows are merged as they stream."""

    def merge(last: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                    own = _column(data.as_buffer(), "<u2", CELLS // BLOCKS).astype(np.uint32)
                    total[block] = np.minimum(total[block] + own, 0xFFFF) if block in total else own
            for block, n in total.items():
                if last:
                    _save(f"{at}/level-{block:03d}", np.minimum(63, np.floor(4 * np.log2(1 + n))).astype("u1").tobytes())
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([b"" if last else _planes(n.astype("<u2"))], pa.binary())})

        return task

    parts = int(survey.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = survey.filter("block is not null").select("block", F.pmod("salt", F.lit(max(1, parts // BLOCKS))).alias("salt"), "data")
    rows = rows.repartition(parts, "block", "salt").select("block", "data").mapInArrow(merge(False), "block int, data binary")
    rows.repartition(BLOCKS, "block").mapInArrow(merge(True), "block int, data binary").agg(F.count("*")).first()


def _save(path: str, data: bytes) -> None:
    own = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, path)


def _levels(at: str) -> np.ndarray:
    return np.concatenate([np.fromfile(f"{at}/level-{k:03d}", "u1") for k in range(BLOCKS)])


#: Entries of a bucket. The place is that of the class's record in the files: the attempt that wrote it, and from bit 0 the
#: offset in words.
_ENTRY = [("tok", "<u4"), ("cls", "<u8"), ("place", "<u8"), ("size", "<u4"), ("pos", "<u4")]
#: Words of a record's signature, of lines and of documents.
_OFFSET, _WIDE, _WIDER = 38, 4, 16


def _records(token: np.ndarray, begins: np.ndarray, sizes: np.ndarray, wide: int, whole: bool, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The records of a set file, in one array, and where each begins: a parity signature of ``wide`` words, then, if
    ``whole``, the tokens; the words ``before`` stand in front of that."""
    kept = sizes if whole else np.zeros_like(sizes)
    starts, n = np.cumsum(kept + wide + len(before)) - kept - wide, int(sizes.sum())
    out = np.empty(int(kept.sum()) + (wide + len(before)) * len(sizes), np.uint64)
    for k, x in enumerate(before):
        out[starts - len(before) + k] = x
    within = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = token[np.repeat(begins, sizes) + within]
    if whole:
        out[np.repeat(starts + wide, sizes) + within] = own
    spot = np.repeat(np.arange(len(sizes)) * 64 * wide, sizes) + (own & np.uint64(64 * wide - 1)).astype(np.int64)
    odd = (np.bincount(spot, minlength=64 * wide * len(sizes)) & 1).astype(bool)
    out[starts[:, None] + np.arange(wide)] = np.packbits(odd, bitorder="little").view("<u8").reshape(-1, wide)
    return out, starts


def _postings(docs: DataFrame, at: str, buckets: int, size: int, grid: int, ordered: bool = False) -> DataFrame:
    """(bucket, n, data): prefix entries of all lines of four tokens or more, packed column by column. Tokens of one line
    only, as the sketch tells, are none. Entries of the most frequent tokens go to ``grid`` of the cells (r, s) of a
    triangle, r or s being a hash of the class: each pair of classes meets in one at least, and no cell holds more than two
    in ``grid`` of them. Lines' sets, and signatures of documents' sets, go to a file of the task beside, once a class; if
    ``ordered``, with its place in the corpus before it, and again where the class stands at an earlier one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, held, n, known, end = None, [], 0, {}, 0
        attempt = TaskContext.get().taskAttemptId()
        file = open(f"{at}/sets-{attempt}", "wb")

        def send() -> pa.RecordBatch:
            bucket, *cols = (np.concatenate(c) for c in zip(*held))
            by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            bucket, cols = bucket[by], [c[by] for c in cols]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(bucket))
            cols = [c.astype(k) for c, (_, k) in zip(cols, _ENTRY)]
            data = [b"".join(_planes(c[a:b]) for c in cols) for a, b in zip(cuts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array((ends - cuts).astype(np.int64)), pa.array(data, pa.binary())], ["bucket", "n", "data"])

        for batch in batches:
            if level is None:
                level = _levels(at)
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            for lo, _, buf, first in _chunks(batch, size):
                token, line, place = line_sets(buf, level, size)
                begins, own, sizes, cls = classes_of(token, line)
                if not len(begins):
                    continue
                wide = np.repeat(sizes, sizes)
                use = np.flatnonzero((wide >= 4) & (place < wide - (4 * wide + 4) // 5 + 1) & (token >> np.uint64(58) > 4))
                row = np.repeat(np.arange(len(begins)), sizes)[use]
                fresh = np.zeros(len(begins), bool)  # copies of a line within a task are sent once
                fresh[row] = True
                at_row = np.searchsorted(first, own, side="right") - 1
                stands = [ids[lo + at_row].view(np.uint64), (own - first[at_row]).astype(np.uint64)] if ordered else []
                for k in np.flatnonzero(fresh).tolist():
                    when = (int(ids[lo + at_row[k]]) << 32) + int(stands[1][k]) if ordered else 0
                    if known.get(c := int(cls[k]), when + 1) <= when:
                        fresh[k] = False
                    else:
                        known[c] = when
                if len(known) > 8 * HELD:
                    known.clear()
                use, row = use[fresh[row]], row[fresh[row]]
                if not len(use):
                    continue
                made, starts = _records(token, begins[fresh], sizes[fresh], _WIDER if size else _WIDE, not size, [x[fresh] for x in stands])
                file.write(made)
                tag = np.zeros(len(begins), np.uint64)
                tag[fresh] = (starts + end).astype(np.uint64) | np.uint64(attempt << _OFFSET)
                end += len(made)
                mixed = _mix(token[use])
                if grid > 1:
                    hot = np.flatnonzero((token[use] >> np.uint64(58)) >= HOT)
                    r = np.repeat((_mix(cls[row[hot]]) % np.uint64(grid)).astype(np.int64), grid)
                    s = np.tile(np.arange(grid), len(hot))
                    cell = (np.minimum(r, s) * grid + np.maximum(r, s) + 1).astype(np.uint64)
                    spread = _mix(np.repeat(mixed[hot], grid) + cell * np.uint64(_P))
                    plain = np.setdiff1d(np.arange(len(use)), hot, assume_unique=True)
                    pick = np.concatenate([plain, np.repeat(hot, grid)])
                    use, row, mixed = use[pick], row[pick], np.concatenate([mixed[plain], spread])
                held.append(((mixed >> np.uint64(32)).astype(np.int64) % buckets, (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32), cls[row], tag[row], sizes[row], place[use]))
                n += len(use)
                if n >= HELD:
                    yield send()
                    held, n = [], 0
        file.close()
        if held:
            yield send()

    return _scan(docs).mapInArrow(shared.trimmed(task), "bucket int, n long, data binary")


def _partners(tok, cls, size, pos, lost: Callable[[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The order by token and size, and in that order i < j of entries of different classes that share a token and pass the
    length and positional filters, with the most tokens that may differ. If the token is the first that two sets share, all
    before it differ, so an entry at place p of n reaches sizes up to (5 n - 9 p) / 4 only. ``lost`` tells, of a range in that
    order, which entries are; pairs of two such are left out."""
    short = np.minimum(size, 0xFFFF).astype(np.uint64)
    key = (tok.astype(np.uint64) << np.uint64(32)) | (short << np.uint64(16)) | (cls & np.uint64(0xFFFF))
    by = np.argsort(key)
    key, cls, size, pos = key[by], cls[by], size[by].astype(np.int64), pos[by].astype(np.int64)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        most = np.clip((5 * size - 9 * pos) // 4, 0, 0xFFFF).astype(np.uint64)
        ends = np.searchsorted(key, (key & np.uint64(0xFFFFFFFF00000000)) | (most << np.uint64(16)) | np.uint64(0xFFFF), side="right")
        wide = np.maximum(ends - np.arange(len(key)) - 1, 0)  # partners of each entry: later in its group
        upto = np.concatenate([[0], np.cumsum(wide)])
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, side="right")) - 1)
            n, live, skip = wide[lo:hi], None, None
            if lost:
                dead = lost(lo, max(hi, int(ends[lo:hi].max())))
                live, dead, near = lo + np.flatnonzero(~dead), dead[: hi - lo], np.arange(lo, hi)
                skip = np.searchsorted(live, near + 1)
                n = np.where(dead, np.maximum(np.searchsorted(live, ends[lo:hi]) - skip, 0), n)
            past = np.concatenate([[0], np.cumsum(n)])
            for a in range(0, int(past[-1]), 4 * PAIRS):  # an entry with many partners takes several steps
                k = np.repeat(np.arange(hi - lo), n)[a : a + 4 * PAIRS]
                off = np.arange(a, a + len(k)) - past[k]
                i, j = k + lo, k + lo + 1 + off
                if lost:
                    few = np.flatnonzero(dead[k])
                    j[few] = live[skip[k[few]] + off[few]]
                both = size[i] + size[j]
                least = (4 * both + 8) // 9
                fit = (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= least) & (pos[i] + pos[j] <= both - 2 * least) & (cls[i] != cls[j])
                if fit.any():
                    yield i[fit], j[fit], (both - 2 * least)[fit]
            lo = hi

    return by, pairs()


class _SetFiles:
    """The mapped set files of a folder."""

    def __init__(self, at: str):
        self.at, self.maps = at, {}

    def take(self, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n`` words from each place on, one after another."""
        out = np.empty(int(n.sum()), np.uint64)
        first, file = np.cumsum(n) - n, place >> np.uint64(_OFFSET)
        offset = (place & np.uint64((1 << _OFFSET) - 1)).astype(np.int64)
        by = np.argsort(file, kind="stable")
        cuts = np.flatnonzero(np.diff(file[by], prepend=~file[by[:1]]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(by))):
            k, own = int(file[by[lo]]), by[lo:hi]
            if k not in self.maps:
                self.maps[k] = np.memmap(f"{self.at}/sets-{k}", "<u8", "r")
            within = np.arange(int(n[own].sum())) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
            out[np.repeat(first[own], n[own]) + within] = self.maps[k][np.repeat(offset[own], n[own]) + within]
        return out


def _alike(files: _SetFiles, place, wide: int, i, j, most) -> np.ndarray:
    """Which pairs' signatures do not already differ in more than ``most`` bits."""
    on = np.zeros(len(place), bool)
    on[i] = on[j] = True
    used, at = np.flatnonzero(on), np.cumsum(on) - 1
    sig = files.take(place[used], np.full(len(used), wide)).reshape(-1, wide)
    return np.bitwise_count(sig[at[i]] ^ sig[at[j]]).sum(axis=1) <= most


def _opens(files: _SetFiles, place, pos, i, j) -> np.ndarray:
    """Which pairs meet at the first token that they share, as far as the tokens before tell."""
    word = lambda k, back: files.take(place[k] + (_WIDE + pos[k] - back).astype(np.uint64), np.ones(len(k), np.int64))
    new = word(i, 0) == word(j, 0)
    later = np.flatnonzero(new & (pos[i] > 0) & (pos[j] > 0))
    new[later] = word(i[later], 1) != word(j[later], 1)
    return new


def _reach(files: _SetFiles, place, size, i, j) -> np.ndarray:
    """Which pairs reach the threshold, by their sets; those of one i should follow one another."""
    keep, upto, lo = np.zeros(len(i), bool), np.concatenate([[0], np.cumsum(size[j])]), 0
    while lo < len(i):  # sets of so many words at once
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE, side="right")) - 1)
        theirs, own = files.take(place[j[lo:hi]] + np.uint64(_WIDE), size[j[lo:hi]]), upto[lo:hi] - upto[lo]
        heads = np.flatnonzero(np.diff(i[lo:hi], prepend=-1))
        mine = files.take(place[i[lo + heads]] + np.uint64(_WIDE), size[i[lo + heads]])
        hit, a, ends = np.zeros(len(theirs), bool), 0, np.append(own[heads[1:]], len(theirs))
        for s, e, n in zip(own[heads].tolist(), ends.tolist(), size[i[lo + heads]].tolist()):
            x, y = mine[a : a + n], theirs[s:e]
            hit[s:e] = x.take(x.searchsorted(y), mode="clip") == y
            a += n
        keep[lo:hi] = 9 * np.add.reduceat(hit, own, dtype=np.int64) >= 4 * (size[i[lo:hi]] + size[j[lo:hi]])
        lo = hi
    return keep


def bucket_pairs(tok, cls, sig, size, pos, files: _SetFiles | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a prefix token and pass the length, positional and signature filters. ``sig``: of 64 bits,
    or with ``files`` its place there."""
    by, found = _partners(tok, cls, size, pos)
    cls, sig = cls[by], sig[by]
    for i, j, most in found:
        if files:
            fit = np.concatenate([_alike(files, sig, _WIDER, *(x[lo : lo + PAIRS // 4] for x in (i, j, most))) for lo in range(0, len(i), PAIRS // 4)])
        else:
            fit = np.bitwise_count(sig[i] ^ sig[j]) <= most
        if fit.any():
            yield np.minimum(cls[i[fit]], cls[j[fit]]), np.maximum(cls[i[fit]], cls[j[fit]])


def bucket_links(files: _SetFiles, tok, cls, place, size, pos) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a prefix token and reach the threshold, verified on their sets. Where the tokens before
    the shared one are the same too, the pair belongs to those."""
    by, found = _partners(tok, cls, size, pos)
    cls, place, size, pos = cls[by], place[by], size[by].astype(np.int64), pos[by].astype(np.int64)

    def verified(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = _alike(files, place, _WIDE, i, j, most)
        i, j = i[fit], j[fit]
        new = _opens(files, place, pos, i, j)
        i, j = i[new], j[new]
        keep = _reach(files, place, size, i, j)
        return cls[i[keep]], cls[j[keep]]

    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= PAIRS:
            yield verified(*(np.concatenate(c) for c in zip(*held)))
            held, n = [], 0
    if held:
        yield verified(*(np.concatenate(c) for c in zip(*held)))


def bucket_late(files: _SetFiles, tok, cls, place, size, pos) -> np.ndarray:
    """Classes that a bucket shows to be linked with one whose first line is earlier. One link is enough: a class is compared
    no more once it has one, so a family of n classes costs about n comparisons of sets and not their square."""
    kinds, own = np.unique(cls, return_inverse=True)
    one = np.ones(len(place), np.int64)
    doc, line = files.take(place - np.uint64(2), one).view(np.int64), files.take(place - np.uint64(1), one)
    order = np.lexsort((line, doc))
    when = np.empty(len(order), np.int64)
    when[order] = np.cumsum((np.diff(doc[order], prepend=doc[order[:1]]) != 0) | (np.diff(line[order].astype(np.int64), prepend=-1) != 0))
    first = np.full(len(kinds), len(order) + 1)
    np.minimum.at(first, own, when)
    once = np.unique((tok.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64), return_index=True)[1]  # of copies in several tasks
    tok, cls, place, size, pos, own = (x[once] for x in (tok, cls, place, size, pos, own))
    del one, doc, line, order, when, once
    gone = np.zeros(len(kinds), bool)
    by, found = _partners(tok, cls, size, pos, lambda lo, hi: gone[own[lo:hi]])
    place, size, pos, own = place[by], size[by].astype(np.int64), pos[by].astype(np.int64), own[by]
    for i, j, most in found:
        swap = first[own[i]] > first[own[j]]
        early, late = np.where(swap, j, i), np.where(swap, i, j)
        fit = np.flatnonzero((first[own[i]] != first[own[j]]) & ~gone[own[late]])
        fit = fit[_alike(files, place, _WIDE, early[fit], late[fit], most[fit])]
        fit = fit[_opens(files, place, pos, early[fit], late[fit])]
        early, late = early[fit], late[fit]
        by = np.lexsort((first[own[early]], own[late]))
        early, late = early[by], late[by]
        heads = np.flatnonzero(np.diff(own[late], prepend=-1))
        turn, lo, n = np.arange(len(late)) - np.repeat(heads, np.diff(np.append(heads, len(late)))), 0, 1
        while len(pick := np.flatnonzero((turn >= lo) & ~gone[own[late]])):  # each class with its first, its next few, and so on
            pick = pick[turn[pick] < lo + n]
            pick = pick[np.argsort(early[pick], kind="stable")]
            gone[own[late[pick[_reach(files, place, size, early[pick], late[pick])]]]] = True
            lo, n = lo + n, 4 * n
    return kinds[gone]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket after another."""
    held = defaultdict(list)
    for batch in batches:
        for bucket, n, data in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("data")):
            raw, lo, cols = data.as_buffer(), 0, []
            for _, kind in _ENTRY:
                cols.append(_column(raw, kind, n, lo))
                lo += n * np.dtype(kind).itemsize
            held[bucket].append(cols)
    for bucket in list(held):
        yield [np.concatenate(c) for c in zip(*held.pop(bucket))]


def _pairs(postings: DataFrame, at: str, buckets: int, size: int) -> DataFrame:
    """a, b: different pairs of classes; those of documents are to be verified."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _SetFiles(at)
        for cols in _unpacked(batches):
            for a, b in bucket_pairs(*cols, files) if size else bucket_links(files, *cols):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return postings.repartition(buckets, "bucket").mapInArrow(shared.trimmed(task), "a long, b long").distinct()


def _late(postings: DataFrame, at: str, buckets: int) -> DataFrame:
    """cls: the classes of lines that are linked with one whose first line is earlier."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _SetFiles(at)
        for cols in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(bucket_late(files, *cols).view(np.int64))], ["cls"])

    return postings.repartition(buckets, "bucket").mapInArrow(shared.trimmed(task), "cls long").distinct()


def _write_bitmap(wanted: DataFrame, at: str, bits: int) -> None:
    """Set a bit per ``h`` in files of the shared folder; each of BLOCKS tasks writes the part that it alone has."""
    wide = (1 << bits) // BLOCKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            spot = _mix(batch.column("h").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            for block in np.unique(batch.column("block").to_numpy()):
                own = held.setdefault(int(block), np.zeros(wide, bool))
                mine = spot[batch.column("block").to_numpy() == block].astype(np.int64)
                own[mine - int(block) * wide] = True
        for block, on in held.items():
            _save(f"{at}/bits-{block:03d}", np.packbits(on).tobytes())
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(held)], pa.int64())})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _mix(batch.column("h").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array((spot // np.uint64(wide)).astype(np.int32))], ["h", "block"])

    wanted.mapInArrow(place, "h long, block int").repartition(BLOCKS, "block").mapInArrow(shared.trimmed(task), "n long").agg(F.sum("n")).first()


def _sets(docs: DataFrame, at: str, bits: int, size: int) -> DataFrame:
    """cls, data: the sorted set of every document whose bit is on; other texts are not cut into words."""
    wide = (1 << bits) // BLOCKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [f"{at}/bits-{k:03d}" for k in range(BLOCKS)]
        maps = [np.memmap(p, "u1", "r") if os.path.exists(p) else None for p in parts]
        for batch in batches:
            spot = (_mix(batch.column("h").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            on, part = np.zeros(len(spot), bool), spot // wide
            for k, bitmap in enumerate(maps):
                own = np.flatnonzero(part == k)
                if bitmap is not None and len(own):
                    at_bit = spot[own] - k * wide
                    on[own] = (bitmap[at_bit >> 3] >> (7 - (at_bit & 7)).astype(np.uint8)) & 1
            keys, data = [], []
            for _, _, buf, _ in _chunks(batch.filter(pa.array(on)), size):
                token, line, _ = line_sets(buf, size=size)
                begins, _, sizes, cls = classes_of(token, line)
                keys += cls.view(np.int64).tolist()
                data += [token[a : a + n].tobytes() for a, n in zip(begins.tolist(), sizes.tolist())]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["cls", "data"])

    return _scan(docs).mapInArrow(shared.trimmed(task), "cls long, data binary")


def _block(cls: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(cls.view(np.uint64) ^ np.uint64(_P)) % np.uint64(blocks)).astype(np.int32)


def _write_sets(sets: DataFrame, at: str, blocks: int) -> None:
    """Files of the candidates' sets, by a hash of the class: sorted classes, offsets, tokens."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_block(batch.column("cls").to_numpy(), blocks))], ["cls", "data", "block"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, bytes]] = defaultdict(dict)
        for batch in batches:
            for block, c, data in zip(batch.column("block").to_pylist(), batch.column("cls").to_pylist(), batch.column("data")):
                if c not in held[block]:
                    held[block][c] = data.as_py()
        for block in list(held):
            own = sorted(held.pop(block).items())
            _save(f"{at}/{block:06d}.off", np.cumsum([0] + [len(d) // 8 for _, d in own]).astype("<i8").tobytes())
            _save(f"{at}/{block:06d}.tok", b"".join(d for _, d in own))
            _save(f"{at}/{block:06d}.cls", np.asarray([c for c, _ in own], "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    sets.mapInArrow(place, "cls long, data binary, block int").repartition(blocks, "block").mapInArrow(shared.trimmed(task), "n long").agg(F.sum("n")).first()


def _verified(pairs: DataFrame, at: str, blocks: int) -> DataFrame:
    """The pairs whose sets reach the threshold. Pairs meet by their two blocks of sets, which a task maps."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [pa.array(_block(batch.column(c).to_numpy(), blocks)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], ["a", "b", "x", "y"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}

        def sets(block: int):
            if block not in opened:
                if len(opened) >= 4:
                    opened.clear()
                opened[block] = tuple(np.memmap(f"{at}/{block:06d}.{k}", kind, "r") for k, kind in (("cls", "<i8"), ("off", "<i8"), ("tok", "<u8")))
            return opened[block]

        for batch in batches:
            a, b, x, y = (batch.column(c).to_numpy() for c in "abxy")
            keep = np.zeros(len(a), bool)
            cuts = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(a))):
                (ca, oa, ta), (cb, ob, tb) = sets(int(x[lo])), sets(int(y[lo]))
                ia, ib = np.searchsorted(ca, a[lo:hi]), np.searchsorted(cb, b[lo:hi])
                for k, i, j in zip(range(lo, hi), ia, ib):
                    p, q = ta[oa[i] : oa[i + 1]], tb[ob[j] : ob[j + 1]]
                    both = np.sort(np.concatenate([p, q]))
                    keep[k] = 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * len(both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    rows = pairs.mapInArrow(place, "a long, b long, x int, y int").repartition(blocks, "x", "y").sortWithinPartitions("x", "y", "a")
    return rows.mapInArrow(shared.trimmed(task), "a long, b long")


def _trie_pairs(survey: DataFrame, budget: int = 4) -> DataFrame:
    """a, b: pairs of classes of documents to verify that the SimHash trie links, as a forest; those of one fingerprint are
    paired with one of them."""
    from . import simhash_trie

    rows = survey.filter("cls is not null").select("cls", "fp")
    lead = shared.table(rows.groupBy("fp").agg(F.min("cls").alias("lead")), "simhash")
    near = simhash_trie.links(lead.select("fp"), lead.count(), budget)
    near = near.join(lead.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u").join(lead.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v").select("a", "b")
    return near.unionByName(rows.join(lead, "fp").filter("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))).distinct()


def _grid(survey: DataFrame, grid: int | None = None) -> tuple[int, int]:
    """The buckets and cells of the join; they follow the number of prefix entries, which the survey tells. No buckets
    without entries."""
    prefix = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    entries = survey.filter("n >= 4").agg(F.sum(prefix)).first()[0] or 0
    buckets = max(int(survey.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET))
    return buckets if entries else 0, grid or -(-entries // (64 * BUCKET))


def links(docs: DataFrame, survey: DataFrame, size: int = 0, grid: int | None = None) -> DataFrame:
    """a, b: all pairs of different classes of lines with a Jaccard similarity of 4/5 or more."""
    spark = docs.sparkSession
    buckets, grid = _grid(survey, grid)
    if not buckets:
        return spark.createDataFrame([], "a long, b long")
    at = shared.local_folder(spark, "line-levels")
    _write_levels(survey, at)
    pairs = shared.table(_pairs(_postings(docs, at, buckets, size, grid), at, buckets, size), "line-pairs")
    if size:
        pairs = shared.table(pairs.unionByName(_trie_pairs(survey)).distinct(), "document-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        wanted = shared.table(survey.select("cls", "h").join(wanted, "cls").groupBy("cls").agg(F.min("h").alias("h")).select("h").distinct(), "line-wanted")
        bits = min(32, max(16, (16 * wanted.count()).bit_length()))
        _write_bitmap(wanted, at, bits)
        _write_sets(_sets(docs, at, bits, size), at, buckets)
        pairs = shared.table(_verified(pairs, at, buckets), "line-links")
    shutil.rmtree(at)  # all that is needed on is in the table
    return pairs


def late_classes(docs: DataFrame, survey: DataFrame, grid: int | None = None) -> DataFrame:
    """cls: each class of lines with a link to one whose first line is earlier, without the links themselves."""
    spark = docs.sparkSession
    buckets, grid = _grid(survey, grid)
    if not buckets:
        return spark.createDataFrame([], "cls long")
    at = shared.local_folder(spark, "line-levels")
    _write_levels(survey, at)
    found = shared.table(_late(_postings(docs, at, buckets, 0, grid, True), at, buckets), "line-late")
    shutil.rmtree(at)
    return found


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_lines, n_links (matches of its lines, equal ones apart), removed (line numbers
    from 0, ascending), classes of each different document. ``classes``: for each line with words its number, the place
    (class_doc, class_line) of the first line with the same set, which names the class, and the links of that class."""
    survey = _survey(docs)
    found = links(docs, survey)
    lines = survey.filter("block is null")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("line").alias("l"))
    first = lines.filter("cls is not null").groupBy("cls").agg(F.min(place).alias("first"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.join(first.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("first").alias("near"), F.count("*").alias("links"))
    known = first.join(seen, "cls", "left")
    rows = lines.join(known, "cls", "left").select("doc_id", "h", "line", F.coalesce((F.col("first") < place) | F.coalesce(F.col("near") < place, F.lit(False)), F.lit(False)).alias("gone"), F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("cls").isNotNull(), F.struct("line", F.nullif("first.d", F.lit(-(1 << 63))).alias("class_doc"), F.col("first.l").alias("class_line"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))).alias("own"))
    n_lines = (F.max("line") + 1).cast("long")
    times = F.count("*") / n_lines  # rows that repeat a document
    return rows.groupBy("doc_id", "h").agg(n_lines.alias("n_lines"), (F.sum("links") / times).cast("long").alias("n_links"), F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("line")))).alias("removed"), F.sort_array(F.collect_set("own")).alias("classes"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that an earlier line matches; a document left without a word goes."""
    survey = _survey(docs)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("line").alias("l"))
    lines = survey.filter("cls is not null").select("doc_id", "h", "line", "cls", place.alias("place"))
    known = lines.groupBy("cls").agg(F.min("place").alias("first")).join(late_classes(docs, survey).withColumn("late", F.lit(True)), "cls", "left")
    gone = lines.join(known, "cls").filter((F.col("first") < F.col("place")) | F.col("late")).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    gone = gone.withColumnsRenamed({"doc_id": "tidewatch_id", "h": "tidewatch_g", "removed": "tidewatch_gone"})
    rows = docs.withColumn("tidewatch_h", F.xxhash64(text_of("text")))
    rows = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("tidewatch_id")) & (F.col("tidewatch_h") == F.col("tidewatch_g")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("tidewatch_gone", i)), "\n")
    cut = F.col("tidewatch_gone").isNotNull()
    out = {c: F.col(c) for c in docs.columns} | {"text": F.when(cut, left).otherwise(F.col("text"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.char_length(left).cast("long")).otherwise(F.col("n_chars").cast("long"))
    return rows.select(*[v.alias(c) for c, v in out.items()], cut.alias("tidewatch_cut")).filter(~F.col("tidewatch_cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("tidewatch_cut")


def keep_first(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each component of documents whose sets of shingles have a Jaccard similarity of 4/5 or more stays:
    the first by id, nulls last (one row, if that is repeated). The SimHash trie pairs documents whose fingerprints, over
    the same shingles, differ in 4 bits or fewer; the join of lines adds all others; both are verified, hence exact."""
    from .simhash_trie import stars

    survey = _survey(docs, size)
    roots = stars(links(docs, survey, size).select(F.col("a").alias("u"), F.col("b").alias("v")))
    place = F.struct(F.col("doc_id").isNull().alias("gone"), F.col("doc_id").alias("doc_id"), F.col("h").alias("g"))
    rows = survey.filter("block is null").select(place.alias("place"), "cls").join(roots.withColumnRenamed("u", "cls"), "cls", "left")
    kept = rows.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("place").alias("x")).select(F.col("x.doc_id").alias("tidewatch_id"), F.col("x.g").alias("tidewatch_g"))
    own = docs.withColumn("tidewatch_h", F.xxhash64(text_of("text")))
    rows = own.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("tidewatch_id")) & (F.col("tidewatch_h") == F.col("tidewatch_g")), "left_semi")
    return rows.dropDuplicates(["doc_id", "tidewatch_h"]).drop("tidewatch_h")
