"""Phrase collocations: runs of two to four words that are frequent for what their parts are, by language.

Shards of text are put into a suffix automaton each (generalised: one for all runs of words of the shard). Its states are the classes of
substrings that end in the same places; the number of those places goes up along the suffix links, so each state gives the count of all its
substrings, of which those of bounded depth are enumerated. Counts of phrases are then added up over all shards, by phrase: they are exact.

What is not frequent in all documents together isn't put into an automaton or shuffled as text. Two passes before count hashes, dealt to
buckets by value: of pairs of words, and then of longer phrases all of whose pairs are frequent. Of each a Bloom filter of FILTER_BITS
bits at most is broadcast. Filters only save work: what passes by chance falls at the exact counts. Beyond some millions of frequent pairs
they pass more and more, so that the last pass shuffles more.

A phrase's suffix link (itself without its first word) and its counterpart (without its last) lead from a candidate to all phrases inside it:
by them each phrase learns of the most frequent longer one around it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, dropped, in_batches, stored, utf8
from .packed import dealt, from_planes, joined, planes
from .wordhash import WordHashes, mixed

DEPTH = 4
UNIT_PHRASES = 2_000_000
BUCKET_PHRASES = 3_000_000
LEAST_BUCKETS = 24
WORD_BYTES = 6
#: Words of a shard, about.
SHARD_WORDS = 250_000
FILTER_BITS = 1 << 26
FILTER_BITS_EACH = 16
#: Different words that a task counts before it gives their counts back.
MOST_COUNTED = 200_000
#: A language's phrases are ranked in so many parts, and then the first of each part.
RANK_PARTS = 16

#: A byte that no text in UTF-8 has stands for the end of a piece.
END = b"\xff"
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
_END_HASH = np.uint64(xxhash.xxh64_intdigest(END))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with END after each piece."""
    words = utf8(text).lower().translate(_ENDS).replace(END, b" \xff ").split()
    words.append(END)
    return words


class _Part:
    """The words of some texts in a row, and the hashes of phrases at each place: 0 where a phrase would go past a piece."""

    def __init__(self, langs: list[str], texts: list[str | None], hashes: WordHashes):
        self.words, sizes = [], []
        for text in texts:
            before = len(self.words)
            self.words += tokens(text)
            sizes.append(len(self.words) - before)
        self.lang = np.repeat(np.arange(len(langs)), sizes)
        of_lang = np.array([xxhash.xxh64_intdigest(utf8(x)) for x in langs], np.uint64)
        own = hashes.of(self.words)
        self.inside = own != _END_HASH
        self.grams = {1: mixed(own ^ np.repeat(of_lang, sizes))}
        with np.errstate(over="ignore"):
            for k in range(2, DEPTH + 1):
                shorter = self.grams[k - 1]
                self.grams[k] = mixed(shorter[:-1] * _ODD + own[k - 1 :])

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from here on are in one piece."""
        n = max(0, len(self.inside) - k + 1)
        ok = np.ones(n, bool)
        for j in range(k):
            ok &= self.inside[j : j + n]
        return ok


class Bloom:
    """A set of hashes as bits; has() never says no of one that is in it."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return hashes & mask, (hashes >> np.uint64(32) ^ hashes * _ODD) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.mask):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


class Automaton:
    """A suffix automaton of several sequences of words, with the number of places where each state's substrings end."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.end, self.count = [-1], [0], [-1], [0]

    def add(self, words: tuple[bytes, ...], at: int, weight: int = 1) -> None:
        """One sequence more that is there weight times; its words stand from place at on."""
        nxt, link, length, count, last = self.next, self.link, self.length, self.count, 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = len(link)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                self.end.append(at)
                count.append(0)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            count[last] += weight
            at += 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        nxt, new = self.next, len(self.link)
        nxt.append(dict(nxt[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.end.append(self.end[q])
        self.count.append(0)
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def substrings(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words from 2 to depth: (that number, where the last word of each substring stands, how often it is there)."""
        length, link, count = np.array(self.length), np.array(self.link), self.count[:]
        for v in np.argsort(-length, kind="stable")[:-1].tolist():
            count[self.link[v]] += count[v]
        total, end = np.array(count, np.int64), np.array(self.end)
        above = length[np.maximum(link, 0)]
        for k in range(2, depth + 1):
            mine = np.flatnonzero((length >= k) & (above < k) & (link >= 0))
            yield k, end[mine], total[mine]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], _Part]]:
    hashes = WordHashes()
    for batch in batches:
        for rows in chunks(batch, [1]):
            langs = rows.column(0).to_pylist()
            yield langs, _Part(langs, rows.column(1).to_pylist(), hashes)


def _hashed_counts(buckets: int, pairs):
    """(bucket, hashes, counts) of pairs of words, or, if a filter of pairs is given, of longer phrases all of whose pairs pass."""

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            for bucket, at in dealt(hashes, buckets):
                values = [hashes[at].tobytes(), planes(np.minimum(counts[at], 2**32 - 1))]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["bucket", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for _, part in _parts(batches):
            if pairs is None:
                new = [part.grams[2][part.whole(2)]]
            else:
                ok = part.whole(2) & pairs.value.has(part.grams[2])
                new = []
                for k in range(3, DEPTH + 1):
                    ok = ok[:-1] & ok[1:] if len(ok) > 1 else ok[:0]
                    # For k words: k - 1 pairs in a row; each step takes in one pair more.
                    new.append(part.grams[k][: len(ok)][ok])
            found += new
            size += sum(map(len, new))
            if size >= UNIT_PHRASES:
                yield from flush(found)
                found, size = [], 0
        yield from flush(found)

    return run


def _frequent_hashes(least: int):
    def run(table: pa.Table) -> pa.Table:
        hashes = joined(table.column("hashes"), "<u8")
        counts = np.concatenate([from_planes(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        keep = np.add.reduceat(counts[order], first) >= least
        got = hashes[first][keep]
        return pa.table([pa.array([len(got)], pa.int64()), pa.array([got.tobytes()], pa.binary())], names=["n", "hashes"])

    return run


def _bloom(hashed: DataFrame, least: int) -> Bloom:
    """A filter of the hashes (of rows bucket, hashes, counts) whose counts reach least."""
    frequent = stored(hashed.groupBy("bucket").applyInArrow(_frequent_hashes(least), "n long, hashes binary"), "frequent", keep_shuffle=False)
    n = frequent.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, 1 << max(16, (FILTER_BITS_EACH * n).bit_length()))
    mask = np.uint64(bits - 1)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                at = np.unique(np.concatenate(Bloom.places(np.frombuffer(value, "<u8"), mask)))
                if len(at):
                    word = at >> np.uint64(6)
                    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                    bit = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "flags"])

    # FILTER_BITS / 64 rows at most.
    rows = frequent.select("hashes").mapInArrow(flags, "word long, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(rows.column(0), np.int64)] = np.asarray(rows.column(1), np.int64).view(np.uint64)
    dropped(frequent)
    return Bloom(words)


def _shard_counts(pairs, longer):
    """(lang, words, phrase, f) of each shard: of phrases of two and more words that pass the filters, of all words, and (words 0, phrase empty) of the number of words."""

    def rows(langs: list[str], words: list[int], phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "words", "phrase", "f"])

    def singles(counted: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counted.items():
            words.pop(END, None)
            yield rows([lang] * (len(words) + 1), [1] * len(words) + [0], [*words, b""], [*words.values(), words.total()])

    def phrases(runs: dict[str, dict[tuple[bytes, ...], list]]) -> Iterator[pa.RecordBatch]:
        for lang, mine in runs.items():
            automaton, text, grams = Automaton(), [], {k: [] for k in range(3, DEPTH + 1)}
            for words, (weight, own) in mine.items():
                automaton.add(words, len(text), weight)
                text += words
                for k, hashes in own.items():
                    grams[k].append(hashes)
            at = {k: np.concatenate(x) for k, x in grams.items()}
            for k, ends, counts in automaton.substrings(DEPTH):
                if k > 2:
                    passed = longer.value.has(at[k][ends - k + 1])
                    ends, counts = ends[passed], counts[passed]
                found = [b" ".join(text[e - k + 1 : e + 1]) for e in ends.tolist()]
                yield rows([lang] * len(found), [k] * len(found), found, counts.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, runs, size = {}, {}, 0
        for langs, part in _parts(batches):
            edges = np.flatnonzero(np.diff(part.lang, prepend=-1, append=len(langs))).tolist()
            for a, b in zip(edges, edges[1:]):
                counted.setdefault(langs[part.lang[a]], Counter()).update(part.words[a:b])
            linked = part.whole(2) & pairs.value.has(part.grams[2])
            turns = np.flatnonzero(np.diff(linked.astype(np.int8), prepend=0, append=0)).tolist()
            padded = {k: np.concatenate([part.grams[k], np.zeros(k - 1, np.uint64)]) for k in range(3, DEPTH + 1)}
            for a, b in zip(turns[::2], turns[1::2]):
                words, mine = tuple(part.words[a : b + 1]), runs.setdefault(langs[part.lang[a]], {})
                seen = mine.get(words)
                if seen is None:
                    mine[words] = [1, {k: x[a : b + 1] for k, x in padded.items()}]
                    size += len(words)
                else:
                    seen[0] += 1
            if size >= SHARD_WORDS:
                yield from phrases(runs)
                runs, size = {}, 0
            if sum(map(len, counted.values())) >= MOST_COUNTED:
                yield from singles(counted)
                counted = {}
        yield from phrases(runs)
        yield from singles(counted)

    return run


def phrase_counts(src: DataFrame, least: int) -> DataFrame:
    """(lang, words, phrase, f) for all phrases of up to DEPTH words with f >= least, from rows (lang, text); words 0 with an empty phrase has the number of words."""
    spark = in_batches(src).sparkSession
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // (WORD_BYTES * BUCKET_PHRASES)))
    schema = "bucket int, hashes binary, counts binary"
    pairs = spark.sparkContext.broadcast(_bloom(src.mapInArrow(_hashed_counts(buckets, None), schema), least))
    longer = spark.sparkContext.broadcast(_bloom(src.mapInArrow(_hashed_counts(buckets, pairs), schema), least))
    counts = src.mapInArrow(_shard_counts(pairs, longer), "lang string, words int, phrase string, f long")
    return stored(counts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(f"words = 0 OR f >= {least}"), "phrases", keep_shuffle=False)


def _slice(words: str, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, inside_percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score.

    Texts, A-Z lower-cased, are cut at [.,;:!?\\x0A-\\x0D] into pieces and those at [\\x20\\x09] into words. Candidates are phrases of 2 to 4 words
    with a >= least occurrences in pieces (overlapping ones count). A candidate cut after k words gives l and r, the occurrences of both parts,
    and the score floor(scale * a / (l + r)); the cut of the lowest score counts, of equal ones that with the smallest k. Candidates inside a longer one
    with 100 * f(longer) >= inside_percent * a are dropped. By score, then a, then the phrase's bytes. n: words of the language.

    Null texts have no words; a null language counts as 'und', an empty one as itself. Repeated rows count each time. A language without
    candidates has no row; an empty table gives an empty result. Other columns are not read. Texts of any length are whole.
    """
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col)).toDF("lang", "text")
    counts = phrase_counts(src, least)
    phrases = counts.filter("words >= 2").withColumn("split", F.split("phrase", " "))
    # All cuts of all candidates, each with the counts of both parts.
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", "split", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _slice("split", F.lit(1), F.col("k")), "rest": _slice("split", F.col("k") + 1, F.col("words") - F.col("k"))}).drop("split", "words")
    known = counts.filter("words BETWEEN 1 AND 3")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST(CAST({scale} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS LONG)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s"))
    # Along the links, from each phrase to those inside it.
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split, i, m), ' '))))")
    around = phrases.filter("words >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    stay = scored.join(around, ["lang", "phrase"], "left").filter(F.expr(f"around IS NULL OR CAST(100 AS DECIMAL(18, 0)) * around < CAST({inside_percent} AS DECIMAL(18, 0)) * s.a"))
    order = [F.desc("s.score"), F.desc("s.a"), F.asc("phrase")]
    stay = stay.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    stay = stay.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    stay = stay.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return stay.join(n, "lang").select("lang", "rank", "phrase", *[F.col(f"s.{c}").alias(c) for c in ("a", "l", "r")], "n", F.col("s.score").alias("score"))
