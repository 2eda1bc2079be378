"""Token ids of whole texts with a byte-level BPE vocabulary, for use inside Spark tasks.

A byte-level BPE codes each pre-token by itself, and pre-tokens repeat. Texts are split with array operations over their bytes; a
pre-token of 15 bytes or fewer is two integers, which are its exact key in a table of ids that a worker keeps. Distinct pre-tokens
that the table lacks go to the library in one call for a run of texts (ids never depend on what is kept). Texts with characters past
U+024F go through the library's own splitter. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Slots (a power of two) of a worker's table, places that one pre-token may have in it, and how many pre-tokens it takes.
SLOT_BITS, PROBES, KEPT = 20, 4, 700_000
#: Bytes of the longest pre-token that two integers hold, its length being in the last byte.
SHORT = 15

# Classes of the pre-tokenizer's pattern below U+0250 (letters, numbers, white space), and its contractions.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t-\r\x85\xa0"
CONTRACTIONS = (b"'s", b"'t", b"'m", b"'d", b"'re", b"'ve", b"'ll")
OTHER, LETTER, NUMBER, SPACE, END = range(5)
_FULL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _classes() -> np.ndarray:
    out = np.full(0x250, OTHER, dtype=np.uint8)
    for kind, signs in ((LETTER, _L), (NUMBER, _N), (SPACE, _S)):
        out[[ord(m[0]) for m in re.finditer(f"[{signs}]", "".join(map(chr, range(0x250))))]] = kind
    return out


_CLASS = _classes()
_BYTE_CLASS = np.concatenate([_CLASS[:0x80], np.zeros(0x80, dtype=np.uint8)])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def split(buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each pre-token of texts that each end with one further byte at ``ends``; whether it is such a byte; and whether it is other than white space.

    Runs of one class are pre-tokens, with these exceptions of the pattern: the last space of a run goes to what follows, other
    white space before a word is a pre-token of its own, and an apostrophe that begins one may take a contraction's letters.
    """
    raw = np.frombuffer(buffer, dtype=np.uint8)
    kind = _BYTE_CLASS[raw]
    high = np.flatnonzero(raw >= 0xC0)
    if len(high):
        code = ((raw[high] & 0x1F).astype(np.int32) << 6) | (raw[high + 1] & 0x3F)
        kind[high] = kind[high + 1] = _CLASS[code]
    kind[ends] = END
    start = np.ones(len(raw), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends] = True
    after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE)) + 1
    last = after - 1 - (raw[after - 1] >= 0x80)
    start[last] = True
    start[after[raw[last] == 0x20]] = False
    quote = np.flatnonzero(raw == 0x27)
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one, two = raw[quote + 1], raw[np.minimum(quote + 2, len(raw) - 1)]
        for word in CONTRACTIONS:
            own = quote[(one == word[1]) if len(word) == 2 else (one == word[1]) & (two == word[2])]
            start[own + 1] = False
            past = own + len(word)
            start[past[kind[past] == LETTER]] = True
    at = np.flatnonzero(start)
    return at, kind[at] == END, kind[np.append(at[1:], len(raw)) - 1] != SPACE


class Encoder:
    """Ids of texts; holds the library's tokenizer and a table of what it said of short pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = (1 << SLOT_BITS) + 1  # the last slot is that of the end of a text
        self.low, self.high = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.at, self.n = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.pool, self.used, self.held = np.array([END_ID] * 4096, dtype=np.uint32), 1, 0
        self.n[-1] = 1
        self.line = self.whole(b"\n")

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _of(self, pieces: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        """Ids of pre-tokens. Those that are not white space (``plain``) stay what they are on a line of their own, so one call takes them all."""
        out: list = [None] * len(pieces)
        lined = np.flatnonzero(plain)
        if len(lined) and len(self.line) == 1:
            ids = self.whole(b"".join([pieces[i] + b"\n" for i in lined]))
            stops = np.flatnonzero(ids == self.line[0])
            if len(stops) == len(lined):
                for i, a, b in zip(lined.tolist(), [0, *(stops[:-1] + 1).tolist()], stops.tolist(), strict=True):
                    out[i] = ids[a:b]
        return [self.whole(piece) if ids is None else ids for piece, ids in zip(pieces, out, strict=True)]

    def _slots(self, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
        """The places that a key may have, best first."""
        mixed = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        first = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        yield first
        step = (mixed >> np.uint64(20)).astype(np.int64) | 1
        for k in range(1, PROBES):
            yield (first + k * step) & ((1 << SLOT_BITS) - 1)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where the table lacks one."""
        out, rest = None, None
        for slot in self._slots(low, high):
            if out is None:
                out = np.where((self.low[slot] == low) & (self.high[slot] == high), slot, -1)
                rest = np.flatnonzero(out < 0)
                continue
            if not len(rest):
                break
            slot = slot[rest]
            hit = (self.low[slot] == low[rest]) & (self.high[slot] == high[rest])
            out[rest[hit]] = slot[hit]
            rest = rest[~hit]
        return out

    def _keep(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Put distinct keys where a slot is free, and say where; who comes first stays, and who finds none (-1) is asked for again."""
        rest, where = np.arange(len(low)), np.full(len(low), -1)
        for slot in self._slots(low, high):
            free = rest[self.n[slot[rest]] == 0]
            own, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.low[own], self.high[own], self.n[own] = low[put], high[put], n[put]
            where[put] = own
            self.held += len(put)
            rest = np.setdiff1d(rest, put, assume_unique=True)
        return where

    def _narrow(self, buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, is_end, plain = split(buffer, ends)
        size = np.diff(start, append=len(buffer))
        eight = np.ndarray((len(buffer) + 8,), dtype="<u8", buffer=buffer + b"\0" * 16, strides=(1,))
        low = eight[start] & _FULL[np.minimum(size, 8)]
        high = np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        if len(longer := np.flatnonzero(size > 8)):
            high[longer] |= eight[start[longer] + 8] & _FULL[np.minimum(size[longer] - 8, 7)]
        slot = self._find(low, high)
        slot[size > SHORT] = -1
        slot[is_end] = len(self.n) - 1
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        if len(rest := np.flatnonzero(slot < 0)):
            at[rest], n[rest] = self._asked(buffer, start[rest], size[rest], low[rest], high[rest], plain[rest])
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(at - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(upto[is_end], prepend=0)

    def _asked(self, buffer: bytes, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of pre-tokens that the table lacks are put, and how many they are."""
        order = np.lexsort((high, low))
        new = np.concatenate([[True], (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0) | (size[order[1:]] > SHORT)])
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[new]
        found = self._of([buffer[a : a + k] for a, k in zip(start[one].tolist(), size[one].tolist(), strict=True)], plain[one])
        n = np.array([len(x) for x in found], dtype=np.int64)
        slot = np.full(len(one), -1)
        if self.held < KEPT:
            brief = np.flatnonzero(size[one] <= SHORT)
            slot[brief] = self._keep(low[one[brief]], high[one[brief]], n[brief])
        # ids that the table points at come first and stay in the pool; the others' room is used again by the next call
        kept = slot >= 0
        order = np.argsort(~kept, kind="stable")
        at, total = np.empty(len(one), dtype=np.int64), int(n.sum())
        at[order] = self.used + np.cumsum(n[order]) - n[order]
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(total, len(self.pool) // 2), dtype=np.uint32)])
        self.pool[self.used : self.used + total] = np.concatenate([found[i] for i in order.tolist()])
        self.at[slot[kept]] = at[kept]
        self.used += int(n[kept].sum())
        return at[group], n[group]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after another; and their number by text."""
        if not texts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        buffer = b"\0".join([*texts, b""])
        raw = np.frombuffer(buffer, dtype=np.uint8)
        high = np.flatnonzero(raw >= 0xC9)
        wide = np.unique(np.searchsorted(ends, high[(raw[high] > 0xC9) | (raw[high + 1] >= 0x90)])).tolist()  # past U+024F
        if not wide:
            return self._narrow(buffer, ends)
        there = set(wide)
        narrow = [b"" if i in there else t for i, t in enumerate(texts)]
        ids, counts = self._narrow(b"\0".join([*narrow, b""]), np.cumsum([len(t) + 1 for t in narrow]) - 1)
        parts, done, upto = [], 0, np.cumsum(counts)
        for i in wide:
            own = self.whole(texts[i])
            parts += [ids[done : upto[i] - 1], own]
            done = upto[i] - 1
            counts[i] = len(own) + 1
        return np.concatenate([*parts, ids[done:]]), counts


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def encode(text: str | bytes | None, path: str) -> bytes:
    """Ids of one text with the end id, as little-endian unsigned 32-bit integers. Null is the empty text."""
    text = text.encode() if isinstance(text, str) else text or b""
    return encoder(path)([text])[0].astype("<u4").tobytes()


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)
