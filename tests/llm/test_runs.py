"""Periodic runs against plain definitions."""

import hashlib
import random
import zlib

import pytest

from gridsift.llm.queries import looped, op12_periodic_runs
from gridsift.llm.runs import Words, _numbered, find_runs, runs_of
from pyspark.sql import types as T


def brute_runs(words, least):
    """Every maximal stretch of each period, and of these the stretches whose smallest period it is."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and (i, j + q - i) not in found:
                found[i, j + q - i] = q
            i = j
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_next(ids, reverse):
    key = lambda i: [(-x if reverse else x) for x in ids[i:]]
    return [next((j for j in range(i + 1, len(ids)) if key(j) < key(i)), len(ids)) for i in range(len(ids))]


def cases():
    r = random.Random(3)
    for k in range(400):
        n = r.randrange(70)
        yield [r.choice([b"a", b"b", b"c", b"d"][: 1 + k % 4]) for _ in range(n)]
    for k in range(60):
        part = [b"%d" % r.randrange(5) for _ in range(r.randrange(1, 30))]
        words = [b"%d" % r.randrange(9) for _ in range(r.randrange(20))] + part * r.randrange(1, 5) + part[: r.randrange(len(part))]
        yield words + [b"%d" % r.randrange(9) for _ in range(r.randrange(20))] + words[: r.randrange(len(words) + 1)]
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 200:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    yield fibonacci[1]
    yield [b"ab"[bin(k).count("1") % 2 :][:1] for k in range(256)]  # Thue-Morse


def test_runs_against_brute_force():
    for words in cases():
        for least in (2, 5, 12):
            assert runs_of(words, least)[0] == brute_runs(words, least), (words, least)


def test_lyndon_words():
    for words in list(cases())[:120]:
        w = Words(_numbered(words))
        for reverse in (False, True):
            if w.n:
                assert w.lyndon(reverse).tolist() == brute_next(w.ids.tolist(), reverse)


def test_long_and_very_periodic_texts():
    """Work must not grow as the square of a text's words."""
    n = 200_000
    assert runs_of([b"a"] * n, 12)[0] == [(0, n, 1)]
    assert runs_of([b"a", b"b"] * (n // 2), 12)[0] == [(0, n, 2)]
    block = [b"%d" % random.Random(1).randrange(10**6) for _ in range(1)] + [b"w%d" % k for k in range(9_999)]
    runs, kept = runs_of([b"x"] + block * 20 + [b"y"], 12)
    assert runs == [(1, 200_000, 10_000)] and kept == [b"x", *block, b"y"]
    # Thue-Morse words of this length have equal polynomial hashes modulo 2**64 where they differ.
    thue = [b"ab"[bin(k).count("1") % 2 :][:1] for k in range(1 << 13)]
    assert [r for r in runs_of(thue, 12)[0] if r[1] > 2.5 * r[2]] == [] and len(runs_of(thue + thue, 2 << 13)[0]) == 1


def test_operator(spark):
    rows = [(1, "a b " * 6 + "c"), (2, None), (3, ""), (4, " \n\t "), (1, "a b " * 6 + "c"), (None, "x " * 12), (5, "é x\x0bé x " * 8)]
    got = find_runs(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, runs int")).collect()
    by = sorted((tuple(x) for x in got), key=repr)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words, 12)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        want.append((i, len(words), [T.Row(start=a, length=n, period=q) for a, n, q in runs], b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert by == sorted(want, key=repr)
    assert find_runs(spark.createDataFrame([], "doc_id string, text string")).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert find_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def loop_by_contract(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("runs"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    docs.unionByName(spark.createDataFrame([(10**6 + k, "w " * k if k % 2 else None) for k in range(30)], "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{d}/documents.parquet")
    return d


def test_query(spark, small):
    want, looping = [], 0
    for row in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = (row.text or "").encode().split()
        loop = loop_by_contract(row.doc_id, words)
        assert loop == looped(row.doc_id, words)
        looping += loop != words
        runs = brute_runs(loop, 12)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want.append((row.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), digest(b" ".join(w for k, w in enumerate(loop) if k not in gone))))
    got = [tuple(x) for x in op12_periodic_runs(spark, small).collect()]
    assert looping > 5 and sorted(got) == sorted(want) and len(got) == len(want)
