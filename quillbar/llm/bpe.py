"""Byte-pair merging over padded integer matrices, shared by the tokenizing operators."""

from __future__ import annotations

import base64
import ctypes
import gc
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
import regex

NONE = np.int32(2**31 - 1)
#: Longest row that goes to a padded matrix; longer runs take a heap of pairs instead, because one
#: merge a round over a wide matrix would cost the square of the length.
WIDEST = 256
#: Distinct pieces a worker remembers before it starts anew.
REMEMBERED = 100_000
#: Cells of one padded matrix.
CELLS = 1 << 19
#: The split pattern of the public byte-level vocabularies, and the same pattern for
#: texts of ASCII and accented Latin-1 letters only, which the faster `re` can match.
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
NOT_PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search


class PairTable:
    """(left id, right id) -> (rank, merged id), an open-addressing hash table in numpy arrays."""

    def __init__(self, left, right, rank, merged):
        key = self._key(np.asarray(left, np.int64), np.asarray(right, np.int64))
        bits = max(4, int(4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            spots, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[spots], self.rank[spots], self.merged[spots] = key[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    @staticmethod
    def _key(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Slots of the pairs, -1 where there is no such pair (or a padding id)."""
        key = self._key(left, right)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, slot, -1)
        live = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            got = self.keys[slot[live]]
            hit = got == key[live]
            out[live[hit]] = slot[live[hit]]
            live = live[~hit & (got >= 0)]
        return np.where((left < 0) | (right < 0), -1, out)

    def ranks(self, left, right):
        shape = left.shape
        slot = self.find(left.ravel(), right.ravel())
        return np.where(slot < 0, NONE, self.rank[slot]).reshape(shape)

    def merge_rows(self, rows):
        """rows: ids, padded with -1. Each round every row that still has a pair merges its leftmost
        pair of least rank and closes the hole; finished rows leave the matrix."""
        out, alive, now = np.full_like(rows, -1), np.arange(len(rows)), rows
        rank = self.ranks(now[:, :-1], now[:, 1:])
        while len(alive):
            n, width = now.shape
            at = rank.argmin(1) if width > 1 else np.zeros(n, np.int64)
            best = rank[np.arange(n), at] if width > 1 else np.full(n, NONE)
            live = best < NONE
            if not live.all():
                out[alive[~live], :width] = now[~live]
                alive, now, rank, at = alive[live], now[live], rank[live], at[live]
                if not len(alive):
                    break
            row, n = np.arange(len(alive)), len(alive)
            now[row, at] = self.merged[self.find(now[row, at], now[row, at + 1])]
            cols = np.arange(width - 1)
            now = np.take_along_axis(now, cols + (cols > at[:, None]), 1)
            cols = np.arange(width - 2)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1) if width > 2 else np.zeros((n, 0), np.int32)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                rank[ok, side[ok]] = self.ranks(now[ok, side[ok]], now[ok, side[ok] + 1])
        return out

    def merge_long(self, ids):
        """The same merges for one long row, by a heap of (rank, place) over a linked list."""
        ids = list(map(int, ids))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        slots = self.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(self.rank[s]), i, ids[i], ids[i + 1]) for i, s in enumerate(slots.tolist()) if s >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i] = int(self.merged[self.find(np.array([a]), np.array([b]))[0]])
            ids[j], after[i] = -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    s = int(self.find(np.array([ids[left]]), np.array([ids[right]]))[0])
                    if s >= 0:
                        heapq.heappush(heap, (int(self.rank[s]), left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32)


class _Index(defaultdict):
    """piece -> number; a piece met for the first time gets the next number."""

    def __init__(self):
        super().__init__(count().__next__)

    def since(self, have: int) -> list[str]:
        """The pieces after the first `have`."""
        return list(islice(self, have, None))


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one after the other."""
    back = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[back + np.arange(len(back))]


class Encoder:
    """Pieces of text -> ids, with a bounded memory of the pieces met before."""

    def __init__(self, pairs: PairTable, first: np.ndarray, last: np.ndarray):
        """first, last: the id of each byte value, and of a byte that ends its piece."""
        self.pairs, self.first, self.last = pairs, first.astype(np.int32), last.astype(np.int32)
        self.forget()

    def forget(self):
        self.index = _Index()
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.met = np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def thin(self):
        """Forgets the pieces met once only since the last time, all if that leaves too many."""
        n = len(self.index)
        kept = self.met[:n] > 1
        if kept.sum() > REMEMBERED // 2:
            return self.forget()
        names = [x for x, k in zip(self.index, kept.tolist(), strict=True) if k]
        start, count = self.start[:n][kept], self.count[:n][kept]
        flat = gather(self.flat, start, count)
        self.forget()
        for name in names:
            self.index[name]  # numbers it
        self._store(flat, np.cumsum(count) - count, count, 0)

    def _store(self, ids, start, count, have):
        n = len(self.index)
        while len(self.start) < n:
            self.start, self.count, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.met))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[have:n], self.count[have:n] = self.used + start, count
        self.used += len(ids)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each piece in them, number of each piece's ids): pieces of like length
        (to a power of two) share a padded matrix."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, count, got, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        for i in np.flatnonzero(size > WIDEST):
            ids = self.first[np.frombuffer(pieces[i], np.uint8)]
            ids[-1] = self.last[pieces[i][-1]]
            got.append(self.pairs.merge_long(ids))
            start[i], count[i] = used, len(got[-1])
            used += len(got[-1])
        width = 2
        while width <= WIDEST:
            rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
            for lo in range(0, len(rows), CELLS // width):
                part = rows[lo : lo + CELLS // width]
                n = size[part]
                raw = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)
                row = np.repeat(np.arange(len(part)), n)
                col = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
                grid = np.full((len(part), width), -1, np.int32)
                grid[row, col] = self.first[raw]
                grid[np.arange(len(part)), n - 1] = self.last[raw[np.cumsum(n) - 1]]
                grid = self.pairs.merge_rows(grid)
                kept = (grid >= 0).sum(1)
                got.append(grid[grid >= 0])
                start[part], count[part] = used + np.cumsum(kept) - kept, kept
                used += len(got[-1])
            width *= 2
        return np.concatenate(got) if got else np.zeros(0, np.int32), start, count

    def encode(self, pieces: list[str], ids_of_new) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece). ids_of_new: list of unknown
        pieces -> what merge() returns."""
        if len(self.index) > REMEMBERED:
            self.thin()
        have = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if len(self.index) > have:
            self._store(*ids_of_new(self.index.since(have)), have)
        self.met[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        count = self.count[at]
        return gather(self.flat, self.start[at], count), count


def ranks(ranks_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}


class ByteBPE:
    """Byte-level ranks file: rank = id, a pair merges if its joined bytes have a rank."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.rank = ranks(ranks_file)
        splits = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        left, right, rank = np.array(splits, np.int64).T
        first = np.array([self.rank.get(bytes([i]), -1) for i in range(256)])
        self.encoder = Encoder(PairTable(left, right, rank, rank), first, first)
        self.find = regex.compile(pattern).findall
        self.find_plain = re.compile(PLAIN).findall if pattern == COMMON else None

    def _new(self, names: list[str]):
        raw = [x.encode() for x in names]
        whole = np.fromiter([self.rank.get(x, -1) for x in raw], np.int64, len(raw))
        todo = np.flatnonzero(whole < 0)
        ids, some_start, some_count = self.encoder.merge([raw[i] for i in todo.tolist()])
        start, count = np.arange(len(raw)) + len(ids), np.ones(len(raw), np.int64)
        start[todo], count[todo] = some_start, some_count
        return np.concatenate([ids, whole]).astype(np.int32), start, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        found = [(self.find_plain if self.find_plain and not NOT_PLAIN(t) else self.find)(t) for t in texts]
        ids, count = self.encoder.encode(list(chain.from_iterable(found)), self._new)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        total = np.concatenate([[0], np.cumsum(count)])
        upto = total[ends]
        return ids, np.diff(np.concatenate([[0], upto]))


class TokenBytes:
    """The bytes of each id of a ranks file."""

    def __init__(self, ranks_file: bytes):
        rank = ranks(ranks_file)
        table = [b""] * (max(rank.values()) + 1)
        for token, r in rank.items():
            table[r] = token
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in order, number of bytes of each id)."""
        size = self.size[ids]
        return gather(self.bytes, self.begin[ids], size), size


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class WordBPE:
    """A tokenizers JSON file of lower-cased byte-level BPE with word ends; white space is dropped.
    Gives the ids of Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, json_file: bytes):
        spec = json.loads(json_file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        letters = byte_letters()
        self.encoder = Encoder(PairTable(left, right, np.arange(len(pairs)), merged), np.array([vocab[c] for c in letters]), np.array([vocab[c + end] for c in letters]))
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.find_plain = re.compile(r"'(?:[stmd]|re|ve|ll)|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.odd = regex.compile(r"[\x1c-\x1f]").search
        self.spaces = regex.compile(r"\p{White_Space}+").split

    def _words(self, text: str) -> list[str]:
        """The words between white space, in composed lower case."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # character by character, without a final form
        text = text.lower()
        return [x for x in self.spaces(text) if x] if self.odd(text) else text.split()

    def _new(self, names: list[str]):
        whole = np.fromiter(map(str.isalpha, names), bool, len(names))
        parts = [(self.find if NOT_PLAIN(name) else self.find_plain)(name) for name in compress(names, ~whole)]
        number, words = _Index(), int(whole.sum())
        at = words + np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64)
        ids, some_start, some_count = self.encoder.merge(list(map(str.encode, chain(compress(names, whole), number))))
        each = np.concatenate([[0], np.cumsum(some_count[at])])
        ends = each[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
        begins = np.concatenate([[0], ends[:-1]])
        start, n = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        start[whole], n[whole] = some_start[:words], some_count[:words]
        start[~whole], n[~whole] = len(ids) + begins, ends - begins
        return np.concatenate([ids, gather(ids, some_start[at], some_count[at])]), start, n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        words: list[str] = []
        ends, fixed = [], []
        for i, text in enumerate(texts):
            if "<|" in text:
                for j, part in enumerate(self.at_special(text)):
                    if j % 2:
                        fixed.append((len(words), self.special[part]))
                        words.append("")
                    else:
                        words += self._words(part)
            else:
                words += self._words(text)
            ends.append(len(words))
        ids, count = self.encoder.encode(words, self._new)
        if fixed:
            at = np.array([x for x, _ in fixed])
            ids = np.insert(ids, (np.cumsum(count) - count)[at], [x for _, x in fixed]).astype(np.int32)
            count[at] = 1
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(np.concatenate([[0], total[np.array(ends, np.int64)]]) if len(ends) else np.zeros(1, np.int64))


_LOADED: dict = {}


def unload() -> None:
    """Frees what loaded() keeps and gives free memory back to the system: an idle Python worker of an
    earlier stage otherwise holds it while other work needs it. Loading anew takes a fifth of a second."""
    _LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def then_unload(run):
    """run (batches -> batches), with unload() at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            unload()

    return whole


def loaded(kind, *args):
    """kind(*args), kept by the Python worker for its later tasks."""
    key = (kind, *map(hash, args))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(*args)
    return _LOADED[key]
