"""Periodic runs of words, by factors: which stretches of a text repeat one group of words again and again.

A run is a stretch of consecutive words with smallest period q whose length is at least LEAST and POWER * q, and which no
neighbouring word extends. The method is that of Kolpakov and Kucherov, text by text:

1. A suffix automaton of the words gives each factor's earliest occurrence, and with it the factorisation: a factor is the longest
   stretch that also begins earlier, or one new word.
2. Runs that touch a border of factors are found by Main's extensions: for every period the words on both sides of the
   border that agree with those one period on, from four tables of common prefixes (Z). A run that ends in a factor begins
   less than one period before the factor ahead of it, so a border looks at its two factors and a third of their length more.
3. All other runs lie inside one factor, without touching its ends. Their copies lie inside the factor's earlier occurrence.

Before this, stretches that can hold no run are left out, exactly: in a run of at least LEAST words and POWER * q, every five words
in a row occur twice or more (for POWER = 4 and LEAST = 6), so words that no repeated five-word group of the text covers are in no run, and
a run never reaches over them. Group hashes only select; words are compared by their letters.

Defined results: null, empty and blank texts have no words and no runs, and nothing of them is left (an empty string); texts
of any length are taken whole, in time that grows like their length; repeated rows agree; an empty table gives an empty result;
extra columns don't matter.
"""

from __future__ import annotations

from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of
from .hashing import mixed, rolling, word_hashes

POWER, LEAST = 4, 6
GROUP = 5
_BASE = 0x9E3779B97F4A7C15 | 1


class Automaton:
    """Suffix automaton of a sequence of numbers. Most states have one way on; the others' ways lie in dictionaries."""

    def __init__(self, s: list[int]):
        size = 2 * len(s) + 2
        self.length, self.link, self.first = array("i", bytes(4 * size)), array("i", bytes(4 * size)), array("i", bytes(4 * size))
        self.letter, self.way = array("i", [-1]) * size, array("i", bytes(4 * size))
        self.ways: dict[int, dict[int, int]] = {0: {}}
        self.link[0] = -1
        self.n_states, last = 1, 0
        for i, c in enumerate(s):
            last = self._extended(last, c, i)

    def step(self, state: int, c: int) -> int:
        """The state after ``c``, or -1."""
        if self.letter[state] == c:
            return self.way[state]
        more = self.ways.get(state)
        return more.get(c, -1) if more else -1

    def _put(self, state: int, c: int, to: int) -> None:
        if self.letter[state] == c or (self.letter[state] < 0 and state):
            self.letter[state], self.way[state] = c, to
        else:
            self.ways.setdefault(state, {})[c] = to

    def _extended(self, last: int, c: int, i: int) -> int:
        length, link, first = self.length, self.link, self.first
        new = self.n_states
        self.n_states += 1
        length[new], first[new] = length[last] + 1, i
        p = last
        while p >= 0 and self.step(p, c) < 0:
            self._put(p, c, new)
            p = link[p]
        if p < 0:
            return new
        q = self.step(p, c)
        if length[p] + 1 == length[q]:
            link[new] = q
            return new
        twin = self.n_states
        self.n_states += 1
        length[twin], link[twin], first[twin] = length[p] + 1, link[q], first[q]
        self.letter[twin], self.way[twin] = self.letter[q], self.way[q]
        if q in self.ways:
            self.ways[twin] = dict(self.ways[q])
        while p >= 0 and self.step(p, c) == q:
            self._put(p, c, twin)
            p = link[p]
        link[q] = link[new] = twin
        return new


def factors(s: list[int]) -> list[tuple[int, int]]:
    """(start, start of the earliest occurrence) of each factor; a new word is its own earliest."""
    own, out, i, n = Automaton(s), [], 0, len(s)
    while i < n:
        state, j = 0, i
        while j < n and (after := own.step(state, s[j])) >= 0 and own.first[after] < j:
            state, j = after, j + 1
        out.append((i, own.first[state] - (j - i) + 1 if j > i else i))
        i = max(j, i + 1)
    return out


def common_prefixes(s: list[int]) -> list[int]:
    """Z: for each place the length of the longest common prefix of the rest and the whole."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _touching(s: list[int], low: int, border: int, high: int, longest: int, found: dict[tuple[int, int], int], power: int, least: int) -> None:
    """Adds the runs of s[low:high] that touch the border, by period up to ``longest``, if no neighbour in s extends them."""
    before, after, n = s[low:border], s[border:high], len(s)
    n_before, n_after = len(before), len(after)
    back = before[::-1]
    ahead_after = common_prefixes(after)  # of s[border + p:] and s[border:]
    ahead_before = common_prefixes([*after, -1, *before, *after])  # of s[border - p:] and s[border:]
    behind_before = common_prefixes(back)  # backwards of s[:border - p] and s[:border]
    behind_after = common_prefixes([*back, -1, *after[::-1], *back])  # backwards of s[:border + p] and s[:border]
    for p in range(1, longest + 1):
        spans = []
        if p <= n_after:  # a whole period lies behind the border
            forward = ahead_after[p] if p < n_after else 0
            backward = min(behind_after[n_before + 1 + n_after - p], n_before)
            spans.append((border - backward, border + p + forward))
        if p <= n_before:  # a whole period lies before it
            forward = min(ahead_before[n_after + 1 + n_before - p], n_after)
            backward = behind_before[p] if p < n_before else 0
            spans.append((border - p - backward, border + forward))
        for i, j in spans:
            if j - i >= max(least, power * p) and (i == 0 or s[i - 1] != s[i - 1 + p]) and (j == n or s[j] != s[j - p]):
                found.setdefault((i, j), p)  # periods grow, so the smallest comes first


def runs(s: list[int], power: int = POWER, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period. ``power`` must be 2 or more."""
    n = len(s)
    if n < least:
        return []
    parts = [*factors(s), (n, n)]
    found: dict[tuple[int, int], int] = {}

    def border(low: int, at: int, end: int) -> None:
        longest = (end - low) // (power - 1)  # of a run that touches here and ends before the next border
        if end - low + longest > least:
            _touching(s, max(0, low - longest), at, end, longest, found, power, least)

    for (low, _), (at, _), (end, _) in zip(parts, parts[1:], parts[2:], strict=False):
        border(low, at, end)
    border(parts[-2][0], n, n)
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (i, j), p in found.items():
        by_start.setdefault(i, []).append((j - i, p))
    for (start, source), (end, _) in pairwise(parts):
        if end - start > least and source < start:  # from left to right: a factor may overlap its own source
            for i in range(start + 1, end - least):
                if inside := [r for r in by_start.get(i - start + source, ()) if i + r[0] < end]:
                    by_start.setdefault(i, []).extend(inside)
    return sorted(((i, length, p) for i, some in by_start.items() for length, p in some), key=lambda r: (r[0], r[2]))


def _candidates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and the stretches (text, from, to) that repeated groups cover: only they can hold runs."""
    h, offsets = word_hashes(texts)
    n_words = np.diff(offsets)
    none = n_words, np.zeros((0, 3), np.int64)
    if len(h) < LEAST:
        return none
    doc = np.repeat(np.arange(len(texts)), n_words)
    at = np.flatnonzero(doc[: 1 - GROUP] == doc[GROUP - 1 :])
    group = mixed(rolling(h, GROUP, _BASE)[at] + doc[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(group, kind="stable")
    same = group[order][1:] == group[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = at[twice]
    if not len(starts):
        return none
    new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > GROUP) | (np.diff(doc[starts]) != 0))))
    first, last = starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)] + GROUP
    long = last - first >= LEAST
    first, last = first[long], last[long]
    return n_words, np.stack([doc[first], first - offsets[doc[first]], last - offsets[doc[first]]], 1)


def found_runs(texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[bytes]]:
    """Number of words, runs and what is left of each text: the words of a run after its first period go."""
    n_words, stretches = _candidates(texts)
    every: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    cut: dict[int, list[bytes]] = {}
    for k, i, j in stretches.tolist():
        if k not in cut:
            cut[k] = texts[k].split()
        number: dict[bytes, int] = {}
        every[k] += [(i + start, length, p) for start, length, p in runs([number.setdefault(w, len(number)) for w in cut[k][i:j]])]
    left = []
    for k, text in enumerate(texts):
        words = cut.get(k) or text.split()
        if every[k]:
            kept = np.ones(len(words) + 1, np.int64)
            for start, length, p in every[k]:
                kept[start + p : start + length] = 0
            words = [w for w, stays in zip(words, kept.tolist(), strict=False) if stays]
        left.append(b" ".join(words))
    return n_words, every, left


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_words``, ``runs`` (array of start, length, period, by start, then period) and ``collapsed``, the text
    without the words of runs after their first period, joined by one blank. No exchange."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, every, left = found_runs(list(texts_of(batch.column(1))))
        flat = np.array([r for some in every for r in some], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]), pa.int32()), structs)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), listed, pa.array(left, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [key, text], rows, f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs_column: str = "runs") -> Column:
    """The run of greatest length over period, compared as a fraction; of equal ones the first. Null if there is none."""
    later = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.reduce(runs_column, F.lit(None).cast("struct<start: long, length: long, period: long>"), later)
