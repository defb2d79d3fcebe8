"""Byte-level BPE by speculation: greedy longest match, pair checks, exact merging of the rest.

A sequence of tokens is the BPE encoding of its bytes exactly when every adjacent pair
is: no merge may cross the border of two tokens while they are built.  The parts of a
token that touch its right border form a chain, each part until the merge that takes it
up; so do the parts at a left border.  A pair of tokens fails when some part of the one
and some part of the other have a merge that comes before both are taken up (of equal
merges the left one comes first).  Those tests run over arrays of pairs, each pair once
per worker; only words with a failing pair are merged step by step.

Each worker keeps the words it has met, up to CACHE_WORDS of this turn and as many of the one before.

Defined results: null text counts as empty and has no tokens; the text of the special
token is that token, as in the tokenizers library; rows may repeat; further columns
stay untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import small_batches

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 150_000
CACHE_PAIRS = 250_000
NEVER = np.int64(1 << 40)
NO_MERGE = 1 << 62
SHORT_WORD = 48
BEGINNING = 4
SHORT_SIZES = tuple(range(BEGINNING - 1, 0, -1))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Tables of one vocabulary file, the words and the pairs met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.id_of = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in self.id_of.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge, made = {}, np.full(size, -1, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for rank, (a, b) in enumerate(pairs):
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            # One number, the smaller the earlier: the rank, then the token that it makes.
            self.merge[a, b] = rank << 20 | whole
            left[whole], right[whole], made[whole] = a, b, rank
        keys = np.array([a << 20 | b for a, b in self.merge], np.int64)
        ranks = np.array([*self.merge.values()], np.int64) >> 20
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]
        self._right, self._left = self._chain(right, made), self._chain(left, made)
        whole = np.flatnonzero(made >= 0)
        odd = self._crossed(left[whole], right[whole], skip_top=True)
        for i in whole[odd].tolist():
            self.id_of.pop(self.token[i], None)
        # Lengths of the tokens with each beginning, the longest first.
        sizes: dict[bytes, set[int]] = {}
        for t in self.id_of:
            if len(t) >= BEGINNING:
                sizes.setdefault(t[:BEGINNING], set()).add(len(t))
        self.sizes = {t: (*sorted(n, reverse=True), *SHORT_SIZES) for t, n in sizes.items()}
        self.byte = [self.id_of[bytes([b])] for b in range(256)]
        splits = "|".join(regex.escape(t) for t in self.special)
        self.split = regex.compile(f"({splits})") if splits else None
        self.words = regex.compile(PATTERN)
        # Words of the turn before are taken over when they are met again.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.fine: dict[int, bool] = {}

    @staticmethod
    def _chain(child: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts at one border of each token, and the merge that takes each up."""
        parts, until = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while (parts[-1] >= 0).any():
            last = parts[-1]
            parts.append(np.where(last >= 0, child[last], -1))
            until.append(np.where(last >= 0, made[last], -1))
        return np.stack(parts[:-1], 1), np.stack(until[:-1], 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def _crossed(self, a: np.ndarray, b: np.ndarray, skip_top: bool = False) -> np.ndarray:
        """Whether a merge crosses the border of each pair."""
        crossed = np.zeros(len(a), bool)
        (rt, ru), (lt, lu) = self._right, self._left
        for i in range(rt.shape[1]):
            open_i = np.flatnonzero((rt[a, i] >= 0) & ~crossed)
            if not len(open_i):
                break
            for j in range(lt.shape[1]):
                open_i = open_i[(lt[b[open_i], j] >= 0) & ~crossed[open_i]]
                if not len(open_i):
                    break
                if skip_top and i == j == 0:
                    continue
                x, y = a[open_i], b[open_i]
                rank = self._rank(rt[x, i], lt[y, j])
                crossed[open_i] = (rank < ru[x, i]) & (rank <= lu[y, j]) & (rank < NEVER)
        return crossed

    def _propose(self, word: bytes) -> list[int]:
        out, at, end, known, sizes = [], 0, len(word), self.id_of.get, self.sizes.get
        while at < end:
            for size in sizes(word[at : at + BEGINNING], SHORT_SIZES):
                part = word[at : at + size]
                token = known(part)
                if token is not None:
                    out.append(token)
                    at += len(part)
                    break
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE of one word: lowest rank first, leftmost of equals."""
        ids = list(map(self.byte.__getitem__, word))
        return self._merged_long(ids) if len(ids) > SHORT_WORD else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        """Each step looks for the lowest rank among all pairs: quadratic, yet quick for short words."""
        merge = self.merge.get
        found = [merge(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NO_MERGE:
                break
            at = found.index(best)
            ids[at : at + 2] = [best & 0xFFFFF]
            del found[at]
            if at:
                found[at - 1] = merge((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(found):
                found[at] = merge((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with the pairs in a heap."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []
        for i in range(len(ids) - 1):
            if found := self.merge.get((ids[i], ids[i + 1])):
                heap.append((found, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b] & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(ids):
                    pair = ids[left], ids[after[left]]
                    if found := self.merge.get(pair):
                        heapq.heappush(heap, (found, left, *pair))
        return [t for t in ids if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        if len(self.fine) > CACHE_PAIRS:
            self.fine.clear()
        known, before = self.known, self.before
        known.update([(w, before[w]) for w in words if w not in known and w in before])
        new = [w for w in words if w not in known]
        if not new:
            return
        raw = [w.encode() for w in new]
        proposed = [self._propose(w) for w in raw]
        flat = np.array([t for p in proposed for t in p], np.int64)
        word_of = np.repeat(np.arange(len(new)), [len(p) for p in proposed])
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, at = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        unseen = np.array([p for p in pairs.tolist() if p not in self.fine], np.int64)
        if len(unseen):
            crossed = self._crossed(unseen >> 20, unseen & 0xFFFFF)
            self.fine.update(zip(unseen.tolist(), (~crossed).tolist()))
        good = np.array([self.fine[p] for p in pairs.tolist()], bool)
        failing = set(word_of[inner][~good[at]].tolist()) if len(inner) else set()
        held, at = flat.astype("<u4").tobytes(), 0
        for i, word in enumerate(new):
            end = at + 4 * len(proposed[i])
            self.known[word] = np.array(self.merged(raw[i]), "<u4").tobytes() if i in failing else held[at:end]
            at = end

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        pieces = []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            pieces.append([p if p in self.special else self.words.findall(p) for p in parts])
        self.learn({w for ps in pieces for p in ps if isinstance(p, list) for w in p})
        known = self.known.__getitem__
        return [
            b"".join(
                b"".join(map(known, p)) if isinstance(p, list) else self.special[p].to_bytes(4, "little") for p in ps
            )
            for ps in pieces
        ]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode(path: str, keep: list[str]):
    def run(batches):
        model = load(path)
        for batch in batches:
            ids = model.encode_batch([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[*keep, "n_tokens", "ids"],
            )

    return run


def _decode(path: str, keep: list[str]):
    def run(batches):
        model = load(path)
        for batch in batches:
            texts = [model.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"]
            )

    return run


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids (little-endian unsigned 32-bit integers) for each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_encode(path, list(keep)), f"{kinds}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the text of its ids."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decode(path, encoded.columns), f"{kinds}, decoded string")


def _both(path: str, keep: list[str]):
    def run(batches):
        model = load(path)
        for batch in batches:
            ids = model.encode_batch([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([model.decode(i) for i in ids], pa.string()),
                ],
                names=[*keep, "n_tokens", "ids", "decoded"],
            )

    return run


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """decode(encode(docs)) in one pass: a task has one worker with one vocabulary instead of two."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_both(path, list(keep)), f"{kinds}, n_tokens long, ids binary, decoded string")
