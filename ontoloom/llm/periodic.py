"""Runs of words that repeat with a period: Lyndon roots from the first phase of Baier's suffix sorter, extended to both sides.

A run is a maximal stretch of words with smallest period q that is at least ``max(least, 2 q)`` words long. Each run has a Lyndon
word of length q, its root, that is the longest Lyndon word at its place under an order of the words or under the reversed order.
The first phase of Baier's sorter groups positions from the greatest word down; when a group's turn comes, the prefix that its
members share is their longest Lyndon word, so its length is the Lyndon array and no suffix is ever sorted. The phase runs once
under each order, and each root is extended as far as words a period apart agree (longest common extensions).

Before that, stretches that can hold no run are passed over: of a run's words, each lies in some ``ceil(least / 2)`` consecutive
words that occur again in the run. Only stretches covered by such repeats, sought anew within each stretch until nothing falls
away, reach the sorter; a run always lies whole in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.batches import slices
from ontoloom.session import ship_package

LEAST = 12
_OPEN = -2
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that become word objects at once; a longer text is numbered in parts.
_PART = 1 << 20


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position. Ranks are 0 to m - 1, each used; the end ranks below all of them.

    Groups are visited from the greatest down. A position's predecessor is the nearest one to its left whose group is still to
    come; predecessors met once, twice, ... from one group leave theirs for a new one just above it, longer by as many contexts.
    """
    n, m = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(m)]
    for i, c in enumerate(ranks):
        members[c].append(i)
    group, size, length = list(ranks), [len(x) for x in members], [1] * m
    below, above = list(range(-1, m - 1)), list(range(1, m + 1))
    before = [_OPEN] * (n + 1)  # the last slot stands for what is left of the first position, and stays open
    out, g = [0] * n, m - 1
    while g >= 0:
        own, hit, times = length[g], [], []
        for i in members[g]:
            if group[i] != g:
                continue  # it has moved to another group
            out[i] = own
            j = i - 1
            while (k := before[j]) != _OPEN:
                j = k
            before[i] = j
            if j >= 0:
                if hit and hit[-1] == j:
                    times[-1] += 1
                else:
                    hit.append(j)
                    times.append(1)
        moves: dict[tuple[int, int], list[int]] = {}
        for j, t in zip(hit, times, strict=True):
            moves.setdefault((-t, group[j]), []).append(j)
        for (t, old), who in sorted(moves.items()) if len(moves) > 1 else moves.items():
            if len(who) == size[old]:
                length[old] -= t * own
                continue
            new, top = len(length), above[old]
            length.append(length[old] - t * own)
            size.append(len(who))
            size[old] -= len(who)
            members.append(who)
            below.append(old)
            above.append(top)
            above[old] = new
            below[top] = new
            for j in who:
                group[j] = new
        g = below[g]
    return out


def _agree(words: np.ndarray, i: int, j: int) -> int:
    """How many words agree from i and j on, i < j."""
    n, k, step = len(words), 0, 32
    while j + k < n:
        to = min(j + k + step, n)
        differ = words[j + k : to] != words[i + k : i + k + to - (j + k)]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = to - j, 2 * step
    return k


def _agree_left(words: np.ndarray, i: int, j: int) -> int:
    """How many words agree before i and j, i < j."""
    k, step = 0, 32
    while k < i:
        d = min(step, i - k)
        differ = (words[j - k - d : j - k] != words[i - k - d : i - k])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = k + d, 2 * step
    return k


def runs_within(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. Words are numbers; equal words, equal numbers."""
    n = len(words)
    if n < 2:
        return []
    ranks = np.unique(words, return_inverse=True)[1].astype(np.int64)
    found = set()
    for order in (ranks, ranks.max() - ranks):
        roots = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)
        # a run has as many agreeing words about its root as its period, and half its least length: three of them on one side
        near, i = min(3, (least + 3) // 4), np.arange(n)
        right, left = i + roots + near <= n, i >= near
        for k in range(near):
            right &= ranks[np.minimum(i + k, n - 1)] == ranks[np.minimum(i + roots + k, n - 1)]
            left &= ranks[np.maximum(i - 1 - k, 0)] == ranks[np.maximum(i + roots - 1 - k, 0)]
        reached: dict[int, int] = {}  # period -> end of the last stretch that has it
        for at in np.flatnonzero(right | left).tolist():
            q = int(roots[at])
            if at + q <= reached.get(q, 0):
                continue  # inside that stretch
            start, end = at - _agree_left(ranks, at, at + q), at + q + _agree(ranks, at, at + q)
            reached[q] = end
            if end - start >= max(least, 2 * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(words: np.ndarray, part: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs. ``part`` numbers the texts that ``words`` holds one after another, from 0 up."""
    k, n = (least + 1) // 2, len(words)
    if n < least:
        return []
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _PRIME
    mixed ^= mixed >> np.uint64(29)
    gram = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + mixed[j : n - k + 1 + j]
    first = np.arange(n - k + 1)
    first = first[part[first] == part[first + k - 1]]
    while len(first):
        key = gram[first] + part[first].astype(np.uint64) * _PRIME
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(first), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        kept = first[again]
        # stretches of covered words, cut where a gram does not overlap or touch the one before or the text ends
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (kept[1:] > kept[:-1] + k) | (part[kept[1:]] != part[kept[:-1]])
        starts = kept[new]
        ends = np.append(kept[np.flatnonzero(new)[1:] - 1], kept[-1:]) + k
        label = np.cumsum(new) - 1
        long_ = ends - starts >= least
        left = kept[long_[label]]
        if len(left) == len(first):
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        part = part.copy()
        part[left] = label[long_[label]]
        first = left
    return []


def number_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word in turn, and how many words each text has. Words stand between space and the signs 9 to 13."""
    table: dict[bytes, int] = {}
    out, counts = [], []
    for text in texts:
        at, n = 0, 0
        while at < len(text):
            to = at + _PART
            while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
                to += 1
            words = text[at:to].split()  # white space of byte strings is these six signs
            for w in words:
                table.setdefault(w, len(table))
            out.append(np.fromiter(map(table.__getitem__, words), dtype=np.int32, count=len(words)))
            n, at = n + len(words), to
        counts.append(n)
    return list(table), np.concatenate(out) if out else np.zeros(0, dtype=np.int32), np.array(counts, dtype=np.int64)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ROW = pa.schema([("doc_id", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
_SQL = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, words, counts = number_words([x or b"" for x in batch.column("text").to_pylist()])
            ends = np.cumsum(counts)
            part = np.repeat(np.arange(len(counts)), counts)
            runs: dict[int, list] = {}
            for a, b in repeating(words, part, least):
                d = int(part[a])
                base = int(ends[d] - counts[d])
                runs.setdefault(d, []).extend((s + a - base, length, q) for s, length, q in runs_within(words[a:b], least))
            found, texts = [], []
            for d, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                own = words[end - n : end]
                mine = sorted(runs.get(d, ()), key=lambda r: (r[0], r[2]))
                if mine:
                    keep = np.ones(n, dtype=bool)
                    for s, length, q in mine:
                        keep[s + q : s + length] = False
                    own = own[keep]
                found.append([{"start": s, "length": length, "period": q} for s, length, q in mine])
                texts.append(b" ".join(map(names.__getitem__, own.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=_RUNS), pa.array(texts, type=pa.binary()).cast(pa.string())], schema=_ROW)

    return run


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array of (start, length, period), collapsed) for every row, of whole texts.

    Words are maximal stretches without space and the signs 9 to 13, numbered from 0. Runs come by start, then period. A word is
    dropped from ``collapsed`` if some run holds it after that run's first period; kept words are joined by one space. A null or empty
    text has no words, no runs and an empty ``collapsed``; a null doc_id stays null. Rows stand alone, so ties, repeated rows, empty
    tables and further columns, whatever their names, change nothing. One text is one task's work, in space linear in its words.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_find(least), _SQL)


def longest(runs: str = "runs"):
    """Column: the longest run of ``runs`` as (length, start, period); ties go to the least start, then period. Null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["s"]).alias("start"), (-best["q"]).alias("period")))
