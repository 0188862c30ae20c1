"""Token-id output as flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

Documents are range-partitioned and sorted by doc_id, encoded, and written as one set of files per partition:
``part-K.bin`` (all ids, unsigned 16-bit where the vocabulary fits, else 32-bit, little-endian), ``part-K.len`` (ids
per document), ``part-K.doc`` (doc ids and a null flag). Partition bases come from a prefix sum over one count per
partition; ``part-K.off`` then holds the global start of every document and the end of the last, and ``layout.json`` the
kind of the ids. Files are written under another name and renamed, so a task that is lost and run again leaves the same
result. The shared folder must be mounted on every node. Ranges are of id and the text's beginning, so rows without an id
are not one task's.

Encoding is the tokenizers library's. To spare it repeated words, a text is cut before every space where the
pre-tokenizer's pattern would cut as well, and each different piece is encoded once per worker while it stays in a
bounded cache; texts with other runs of spaces, or with a special token's string, go to the library whole.

Defined cases: null or empty text has the end id only; null doc ids come first; repeated rows are written each, in
text order; an empty table gives no files and no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import shared

#: Pieces that a worker's cache holds at most.
CACHED = 700_000
_MARKS, _ID = (",", ".", ";"), attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    return letters | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in letters)}


class _Bare(dict):
    """Maps a piece that no space precedes to its ids as bytes."""

    def __init__(self, owner: PieceEncoder):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        found = self[piece] = self.owner.pieces("", piece)
        return found


class PieceEncoder(dict):
    """Maps a piece (text after a space) to its ids as bytes; missing pieces are encoded by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.model, self.letters = self.tokenizer.model, str.maketrans(_byte_letters())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd: dict[str, tuple[bool, bool]] = {}  # pieces that are empty or have a space at an end
        self.bare = _Bare(self)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> list[int]:
        """Ids of what the pre-tokenizer leaves in one."""
        if not word.isascii():
            word = word.encode().decode("latin-1")
        return list(map(_ID, self.model.tokenize(word.translate(self.letters))))

    def pieces(self, space: str, piece: str) -> bytes:
        """Ids of a piece after ``space``; letters, and letters with a mark behind, need no pre-tokenizer."""
        if piece.isascii() or (piece and max(piece) < "ɐ"):
            if piece.isalpha():
                return self.pack(self._word(space + piece))
            if piece[-1:] in _MARKS and piece[:-1].isalpha():
                return (self if space else self.bare)[piece[:-1]] + self.bare[piece[-1]]  # the word is kept without its mark too
        return self.whole(space + piece)

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            if len(self) > CACHED:
                self.clear()
                self.odd.clear()
            found = self[piece] = self.pieces(" ", piece)
            return found
        if piece.count("\n") == 1:
            left, right = piece.split("\n")
            if left and right and not left[-1].isspace() and not right[0].isspace() and not piece[0].isspace() and not piece[-1].isspace():
                return self[left] + self.bare["\n"] + self.bare[right]  # the words either side are cached, not the pair
        if len(self) > CACHED:
            self.clear()
            self.odd.clear()
        found = self[piece] = self.pieces(" ", piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            self.odd[piece] = (not piece or piece[0].isspace(), not piece or piece[-1].isspace())
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as the library gives them."""
        if not text or any(s in text for s in self.special):
            return self.whole(text) if text else b""
        first, *pieces = text.split(" ")
        found = b"".join(map(self.__getitem__, pieces))
        if self.odd and not self.odd.keys().isdisjoint(pieces):
            ends = [(not first or first[0].isspace(), not first or first[-1].isspace()), *(self.odd.get(p, (False, False)) for p in pieces)]
            if any(a[1] and b[0] for a, b in zip(ends, ends[1:])):
                return self.whole(text)
        return self.bare[first] + found


def encoder(path: str) -> PieceEncoder:
    """One encoder, with its cache, for all tasks of a worker."""
    held = shared.cache("token_files")
    if path not in held:
        held[path] = PieceEncoder(path)
    return held[path]


def _put(path: str, data: bytes) -> None:
    own = f"{path}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, path)


def write(docs: DataFrame, directory: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write all files; return one row per partition: part, n_docs, n_tokens, kind of the ids, base. ``tokenizer``: a file's
    path."""
    spark = docs.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        base, end = f"{directory}/part-{part:06d}", enc.pack([end_id])
        own, lens, ids, gone = f"{base}.bin.{TaskContext.get().taskAttemptId()}", [], [], []
        with open(own, "wb") as f:
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    got = enc.encode(text or "") + end
                    lens.append(len(got) // len(end))
                    f.write(got)
                known = batch.column("doc_id")
                gone.append(known.is_null().to_numpy(zero_copy_only=False))
                ids.append(known.fill_null(0).to_numpy(zero_copy_only=False))
        if not lens:
            os.remove(own)
            return
        os.replace(own, f"{base}.bin")
        _put(f"{base}.len", np.asarray(lens, "<u8").tobytes())
        _put(f"{base}.doc", np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(gone).astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(lens)], pa.int64()), "n_tokens": pa.array([sum(lens)], pa.int64()), "kind": pa.array([enc.kind])})

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, kind in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "kind"))):
                at = f"{directory}/part-{part:06d}"
                _put(f"{at}.off", (np.concatenate([[0], np.cumsum(np.fromfile(f"{at}.len", "<u8"))]) + base).astype("<u8").tobytes())
                _put(f"{directory}/layout.json", json.dumps({"ids": kind, "offsets": "<u8", "end": end_id}).encode())
            yield batch

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ship(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    counts = shared.table(rows.mapInArrow(shared.trimmed(task, "token_files"), "part int, n_docs long, n_tokens long, kind string"), "token-parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    schema = "part int, n_docs long, n_tokens long, kind string, base long"
    based = counts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    return shared.table(based.repartition(parts, "part").mapInArrow(offsets, schema), "token-bases")


def read(parts: DataFrame, directory: str) -> DataFrame:
    """Map the files that ``write`` returned ``parts`` for: doc_id, start, n_tokens, ids_crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, kind in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "kind"))):
                at = f"{directory}/part-{part:06d}"
                lens = np.fromfile(f"{at}.len", "<u8")
                off, ids = np.memmap(f"{at}.off", "<u8", "r"), np.memmap(f"{at}.bin", kind, "r")
                raw = np.memmap(f"{at}.doc", "u1", "r")
                doc, gone = raw[: 8 * len(lens)].view("<i8"), raw[8 * len(lens) :].astype(bool)
                crc = [zlib.crc32(ids[int(a) - base : int(b) - base].astype("<u4").tobytes()) for a, b in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.asarray(doc), pa.int64(), mask=gone), "start": pa.array(off[:-1].astype("<i8")), "n_tokens": pa.array(lens.astype("<i8")), "ids_crc32": pa.array(crc, pa.int64())})

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "part").select("part", "base", "kind").mapInArrow(shared.trimmed(task), "doc_id long, start long, n_tokens long, ids_crc32 long")
