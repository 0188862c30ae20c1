"""BPE encoding and decoding with a pair-occurrence index.

The different words of a batch are laid out as one sequence of symbols. Every adjacent pair that has a merge is mapped
to all its positions; active ranks are applied in ascending order, each at all positions where the pair still stands,
and every merge adds the two pairs it makes to their lists. Words already met keep their result in a worker's cache of
two bounded generations: a full one replaces the older, and words of that one that are met again move on. So the cost
follows the different words and not their number. Merging never reads across words.

Normalisation and splitting follow the tokenizer file: composed form, white space dropped, lower case, contractions,
letter runs, single digits and runs of other marks, each ending in ``</w>``; strings of special tokens are ids of their
own. Decoding maps ids back to tokens and joins them by a space, as a file without a decoder asks for.

Defined cases: null, empty or blank text has no ids and decodes to nothing; repeated rows are encoded alike; empty
tables give no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import filterfalse
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from . import shared
from .token_files import _byte_letters

#: Words that a generation of a worker's cache holds before it becomes the older of two, and characters of text that one
#: index covers.
CACHED = 250_000
BATCH = 1 << 21
_EXTRA = "\x1c\x1d\x1e\x1f"  # white space for str.split, not for the tokenizer
#: The split pattern of the file, and the same spelled out for lower-case text below U+0100.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
_IDS, _BACK = itemgetter(0), itemgetter(1)


class PairIndex:
    """Merges of one vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        self.vocab, self.suffix, self.size = vocab, suffix, max(vocab.values()) + 2
        self.triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        codes = np.asarray([a * self.size + b for a, b, _ in self.triples], np.int64)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.rank = {int(c): r for r, c in reversed(list(enumerate(codes)))}
        self.inner, self.final = (np.full(512, self.size - 1, np.int64) for _ in range(2))
        for letter in _byte_letters().values():
            self.inner[ord(letter)], self.final[ord(letter)] = vocab[letter], vocab[letter + suffix]

    def start(self, words: list[str]) -> list[int]:
        """Symbols of all words before any merge, a wall before, between and after them; words are in byte letters."""
        codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), "<u4")
        sym = self.inner[codes]
        last = np.flatnonzero(codes == 10)[1:] - 1
        sym[last] = self.final[codes[last]]
        return sym

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (none empty)."""
        if not words:
            return []
        wall = self.size - 1  # stands between words and is in no merge
        flat = self.start(words)
        n, size, rank, triples = len(flat), self.size, self.rank.get, self.triples
        pairs = flat[:-1] * size + flat[1:]
        slot = np.minimum(np.searchsorted(self.codes, pairs), len(self.codes) - 1)
        at = np.flatnonzero(self.codes[slot] == pairs)
        ranks = self.order[slot[at]]
        by = np.argsort(ranks, kind="stable")
        at, ranks = at[by].tolist(), ranks[by]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        where = {int(ranks[a]): at[a:b] for a, b in zip(cuts, [*cuts[1:], len(at)])}
        sym, nxt, prv = flat.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        active = list(where)
        heapq.heapify(active)
        listed = where.get
        while active:
            r = heapq.heappop(active)
            places = where.pop(r, None)
            if places is None:
                continue
            places.sort()
            a, b, new = triples[r]
            for k, p in enumerate(places):
                if sym[p] != a:
                    continue
                q = nxt[p]
                if sym[q] != b:
                    continue
                after, before = nxt[q], prv[p]
                sym[p], sym[q] = new, -1
                nxt[p], prv[after] = after, p
                low = r
                made = rank(sym[before] * size + new)  # the pair with the symbol before
                if made is not None:
                    own = listed(made)
                    if own is None:
                        where[made] = [before]
                        heapq.heappush(active, made)
                    else:
                        own.append(before)
                    low = made if made < low else low
                made = rank(new * size + sym[after])  # and the one with the symbol after
                if made is not None:
                    own = listed(made)
                    if own is None:
                        where[made] = [p]
                        heapq.heappush(active, made)
                    else:
                        own.append(p)
                    low = made if made < low else low
                if low < r:  # a rank below this one became active: it goes first
                    where[r] = where.get(r, []) + places[k + 1 :]
                    heapq.heappush(active, r)
                    break
        left = np.asarray(sym)
        left = left[left >= 0]
        walls, left = np.flatnonzero(left == wall).tolist(), left.tolist()
        return [left[a + 1 : b] for a, b in zip(walls, walls[1:])]


class Encoder:
    """Whole texts to ids and back, by the rules of one tokenizer file."""

    def __init__(self, path: str, cached: int = CACHED, keep: bool = True):
        import regex

        self.cached, self.keep = cached, keep

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.index = PairIndex(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.number = [b"%d" % i for i in range(max(self.token) + 1)]
        self.token_bytes = {i: t.encode() for i, t in self.token.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(split).findall
        self.plain = split == _SPLIT
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.blank = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)
        self.letters = str.maketrans(_byte_letters())
        self.marks = {t: (self.number[i], t.encode()) for t, i in self.special.items()}  # no word is one: words hold no "<|" beside letters
        self.fresh: dict[str, tuple[bytes, bytes]] = {}
        self.stale: dict[str, tuple[bytes, bytes]] = {}

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Words of a normalised text, as the file's split pattern finds them."""
        odd = any(c in text for c in _EXTRA)
        if self.plain and not odd:
            try:
                text.encode("latin-1")
                return _LATIN(text)
            except UnicodeEncodeError:
                pass
        return [w for p in (self.blank.split(text) if odd else text.split()) if p for w in self.cut(p)]

    def learn(self, words: set[str]) -> None:
        """Bring words that the present generation lacks into it: from the older one, or encoded under one index."""
        fresh, stale = self.fresh, self.stale
        new = []
        for w in words:
            found = stale.get(w)
            if found is None:
                new.append(w)
            else:
                fresh[w] = found
        letters = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in new]
        number, token = self.number.__getitem__, self.token_bytes.__getitem__
        for w, ids in zip(new, self.index.encode(letters)):
            fresh[w] = (b" ".join(map(number, ids)), b" ".join(map(token, ids)))

    def many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as decimals joined by a space, decoded text in UTF-8) of each text."""
        if len(self.fresh) > self.cached:
            self.stale, self.fresh = self.fresh, {}
        cut, missing = [], set()
        for text in texts:
            if self.at_special and "<|" in text and any(s in text for s in self.special):
                runs = [[s] if s in self.special else self.words(self.normal(s)) for s in self.at_special(text)]
                cut.append([w for run in runs for w in run])
                self.fresh |= self.marks
            else:
                cut.append(self.words(self.normal(text)))
            missing.update(filterfalse(self.fresh.__contains__, cut[-1]))
        self.learn(missing)
        out = []
        for ws in cut:
            found = list(map(self.fresh.__getitem__, ws))
            out.append((b" ".join(map(_IDS, found)), b" ".join(map(_BACK, found))))
        return out

    def rest(self) -> None:
        """At a task's end the cache goes, unless it is kept for the next task of the worker."""
        if not self.keep:
            self.fresh, self.stale = {}, {}

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


def encoder(path: str, cached: int, keep: bool) -> Encoder:
    """One encoder, with its cache, for all tasks of a worker."""
    held, key = shared.cache("pair_bpe"), f"{path} {cached} {keep}"
    if key not in held:
        held[key] = Encoder(path, cached, keep)
    return held[key]


def _each(path: str, make, names: list[str], kinds: list, cached: int = CACHED, keep: bool = True):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cached, keep)
        for batch in batches:
            texts, lo, held = batch.column("text"), 0, 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for k, size in enumerate(sizes):
                held += size
                if held >= BATCH or k == len(sizes) - 1:
                    own = batch.slice(lo, k + 1 - lo)
                    made = [make(*x) for x in enc.many([t or "" for t in own.column("text").to_pylist()])]
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*made), kinds)]], ["doc_id", *names])
                    lo, held = k + 1, 0

    return shared.trimmed(task, "pair_bpe")


def _count(ids: bytes) -> int:
    return ids.count(b" ") + 1 if ids else 0


def _rows(docs: DataFrame) -> DataFrame:
    return ship(docs).select("doc_id", F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (text). ``tokenizer``: a file's path."""
    kind = dict(docs.dtypes)["doc_id"]
    make = lambda ids, back: ([int(i) for i in ids.split()], back.decode())
    return _rows(docs).mapInArrow(_each(tokenizer, make, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()]), f"doc_id {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, tokenizer: str, cached: int = CACHED, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encoding, without carrying ids through the engine.
    ``cached``: words in a generation of a worker's cache; ``keep``: whether it outlives a task. Neither changes results."""
    kind = dict(docs.dtypes)["doc_id"]
    sha = lambda s: hashlib.sha256(s).hexdigest()
    make = lambda ids, back: (_count(ids), sha(ids), sha(back))
    return _rows(docs).mapInArrow(_each(tokenizer, make, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], cached, keep), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
