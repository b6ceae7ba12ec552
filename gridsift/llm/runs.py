"""Periodic runs of words in each text, from Lyndon words.

A run is a maximal stretch with a smallest period that it holds at least twice. Every run has Lyndon words of its period's length that are
the longest ones at their place, under an order of the words or under the reverse order. So for each of the two orders a stack of Lyndon
words is built from right to left (each entry begins where the next smaller suffix begins); every pair (i, next smaller suffix of i) names
a period, which is extended both ways. Suffixes are compared, and periods extended, word by word at first and then by binary search over
rolling hashes; what the hashes say is verified on the words. No suffix array is made.

The words of a text are numbered by first appearance: any order will do, as long as the other one is its reverse. All of it is work on one
row at a time, over Arrow batches: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, in_batches, utf8
from .wordhash import mixed, windows

#: So many words are compared one by one before hashes are.
SHORT = 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1

Run = tuple[int, int, int]  # start, length, period


class Words:
    """A text's words as numbers from 0, and how far they agree from (or before) two places."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.at = [*ids.tolist(), -1]
        self._sums: list[int] | None = None
        #: By period: a stretch (start, end) that has it and cannot be extended to the right.
        self._known: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of k words from i and from j are equal; i < j."""
        if self._sums is None:
            powers = np.full(self.n + 1, _BASE, np.uint64)
            powers[0] = 1
            with np.errstate(over="ignore"):
                powers = np.cumprod(powers)
                values = mixed(self.ids.astype(np.uint64) + np.uint64(1)) * powers[:-1]
                self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]).tolist()
            self._powers = powers.tolist()
        s = self._sums
        return ((s[i + k] - s[i]) * self._powers[j - i] - (s[j + k] - s[j])) & _MASK == 0

    def _hashed(self, most: int, same: Callable[[int], bool]) -> int:
        """The largest k up to most with same(k), which holds for every k below it."""
        low, step = 0, SHORT
        while low + step <= most and same(low + step):
            low += step
            step *= 2
        high = min(low + step, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if same(mid) else (low, mid)
        return low

    def ahead(self, i: int, j: int) -> int:
        """How many words from i and from j on are equal; i < j."""
        start, end = self._known.get(j - i, (self.n, self.n))
        if start <= i and j <= end and start < self.n:
            return end - j
        # Words that reach a known stretch of this period agree to its end.
        most = min(self.n - j, start - i) if start > i else self.n - j
        k, at = 0, self.at
        while k < most and k < SHORT and at[i + k] == at[j + k]:
            k += 1
        if k == SHORT and k < most:
            k = self._hashed(most, lambda k: self._same(i, j, k))
            differ = self.ids[i : i + k] != self.ids[j : j + k]
            k = int(differ.argmax()) if differ.any() else k
        if start < self.n and i + k == start:
            k = end - j
        if k >= SHORT:
            self._known[j - i] = (i, j + k)
        return k

    def back(self, i: int, j: int) -> int:
        """How many words before i and before j are equal; i < j."""
        k, at = 0, self.at
        while k < i and k < SHORT and at[i - k - 1] == at[j - k - 1]:
            k += 1
        if k == SHORT and k < i:
            k = self._hashed(i, lambda k: self._same(i - k, j - k, k))
            differ = (self.ids[i - k : i] != self.ids[j - k : j])[::-1]
            k = int(differ.argmax()) if differ.any() else k
        return k

    def lyndon(self, reverse: bool) -> np.ndarray:
        """For each place where the next smaller suffix begins (the end of the longest Lyndon word from there). The end of the text is smaller than any word."""
        ids = -self.ids if reverse else self.ids
        at, n = ids.tolist(), self.n
        at.append(-n - 1)
        ends = list(range(1, n + 1))
        ahead = self.ahead
        for i in np.flatnonzero(ids[:-1] <= ids[1:])[::-1].tolist():
            a, j = at[i], i + 1
            while True:
                b = at[j]
                if a > b:
                    break
                if a == b:
                    k = 1
                    while at[i + k] == at[j + k]:
                        k += 1
                        if k == SHORT:
                            k = ahead(i, j)
                            break
                    if at[i + k] > at[j + k]:
                        break
                j = ends[j]
            ends[i] = j
        return np.array(ends, np.int64)

    def runs(self, least: int) -> list[Run]:
        """All runs of at least so many words, by start and then period."""
        n, found = self.n, set()
        if n < max(2, least):
            return []
        # A run of a period p agrees with itself over max(p, least - p) words, to the right or to the left of a Lyndon word over half of them.
        probe = max(1, -(-(-(-least // 2)) // 2))
        if n <= probe:
            probe = 1
        near = windows(self.ids.astype(np.uint64), probe)
        for reverse in (False, True):
            ends = self.lyndon(reverse)
            i, last = np.arange(n), len(near)
            right = (ends < last) & (near[np.minimum(i, last - 1)] == near[np.minimum(ends, last - 1)])
            left = (i >= probe) & (near[np.maximum(i - probe, 0)] == near[np.minimum(np.maximum(ends - probe, 0), last - 1)])
            done: dict[int, int] = {}
            for a in np.flatnonzero(right | left).tolist():
                b = int(ends[a])
                p = b - a
                if b <= done.get(p, -1):
                    continue  # inside the last run of this period
                end = b + (self.ahead(a, b) if b < n else 0)
                start = a - self.back(a, b)
                if end - start >= max(least, 2 * p):
                    found.add((start, end - start, p))
                    done[p] = end
        return sorted(found, key=lambda x: (x[0], x[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), np.int64, len(words))


def runs_of(words: list[bytes], least: int) -> tuple[list[Run], list[bytes]]:
    """The runs of a list of words, and the words without those that a run repeats."""
    runs = Words(_numbered(words)).runs(least)
    if not runs:
        return runs, words
    again = np.zeros(len(words), bool)
    for start, length, period in runs:
        again[start + period : start + length] = True
    return runs, [w for w, gone in zip(words, again.tolist()) if not gone]


Alter = Callable[[object, list[bytes]], list[bytes]]


def _found(least: int, alter: Alter | None):
    pairs = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, [1]):
                ids, n, runs, kept = part.column(0), [], [], []
                for key, text in zip(ids.to_pylist(), part.column(1).to_pylist()):
                    words = utf8(text).split()
                    if alter is not None:
                        words = alter(key, words)
                    mine, rest = runs_of(words, least)
                    n.append(len(words))
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in mine])
                    kept.append(b" ".join(rest))
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(runs, pa.list_(pairs)), texts], names=["id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, alter: Alter | None = None) -> DataFrame:
    """One row per row of docs: its id, n_words, runs (array of start, length, period, in words from 0, by start and then period), collapsed (text).

    Words are [^\\x20\\x09-\\x0D]+. A run is a stretch of words with smallest period q (words q apart are identical) of at least min_words and at
    least 2q words, which no neighbouring word extends. collapsed has, joined by one space, the words that no run contains after its first q.
    alter, if given, makes other words of (id, words) first.

    Null, empty or blank text: no words, no runs, an empty collapsed. Repeated rows each give a row; a null id is passed on. Ties don't
    matter, as all runs are given. Texts of any length are whole; the work on one of n words grows as n log n. An empty table gives an empty
    result. Other columns are not read.
    """
    src = docs.select(id_col, text_col).toDF("id", "text")
    fields = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", fields), T.StructField("collapsed", T.StringType())])
    out = in_batches(src).mapInArrow(_found(min_words, alter), schema)
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")
