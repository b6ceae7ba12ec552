"""Substring dedup against plain definitions."""

import hashlib
import random

import numpy as np
import pytest

from gridsift.llm import substrings
from gridsift.llm.packed import cut, dealt, from_planes, joined, planes
from gridsift.llm.queries import op13_substring_dedup
from gridsift.llm.substrings import drop_repeats


def brute(rows, size):
    """(id, n_words, n_removed, kept, spans, longest) of each row."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    holders: dict[tuple, set] = {}
    lengths = [size << k for k in range(12)]
    for i, words in split:
        for n in lengths:
            for a in range(len(words) - n + 1):
                if i is not None:
                    holders.setdefault(tuple(words[a : a + n]), set()).add(i)
    out = []
    for i, words in split:
        gone, longest = set(), 0
        if i is not None:
            for a in range(len(words) - size + 1):
                if min(holders[tuple(words[a : a + size])]) < i:
                    gone.update(range(a, a + size))
            longest = max((n for n in lengths for a in range(len(words) - n + 1) if len(holders[tuple(words[a : a + n])]) > 1), default=0)
        spans = [(a, next(b for b in range(a, len(words) + 1) if b not in gone)) for a in sorted(gone) if a - 1 not in gone]
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode(), spans, longest))
    return sorted(out, key=repr)


def texts(seed, n=40):
    r = random.Random(seed)
    passages = [" ".join(f"p{k}w{j}" for j in range(r.choice([3, 4, 9, 17, 40]))) for k in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice("abcdefgh") for _ in range(r.randrange(8))) for _ in range(r.randrange(6))]
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(parts)))
    return rows + [(90, None), (91, ""), (92, " \n "), (None, rows[3][1]), (None, rows[3][1]), (3, rows[3][1]), (5, rows[3][1] + " é ü"), (93, "x " * 30), (94, "x " * 31), (-7, rows[8][1])]


def got_of(df):
    return sorted(((*tuple(x)[:4], [tuple(s) for s in x.spans], x.longest) for x in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 4, 13])
def test_drop_repeats(spark, size, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_BUCKETS", 3)
    rows = texts(size)
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_words int, tag boolean").repartition(5)
    assert got_of(drop_repeats(docs, words=size)) == brute(rows, size)


def test_empty_and_nothing_in_common(spark):
    none = drop_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["doc_id", "n_words", "n_removed", "kept", "spans", "longest"] and none.count() == 0
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(50))) for i in range(5)]
    assert got_of(drop_repeats(spark.createDataFrame(rows, "doc_id int, text string"))) == brute(rows, 13)


def test_long_copies_and_one_text_in_many_documents(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(0, long), (1, "begin " + long), (2, long + " end")] + [(10 + i, f"own {i} " + " ".join(f"c{k}" for k in range(20))) for i in range(300)]
    got = {x.doc_id: x for x in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_removed, got[1].kept, got[2].kept) == (0, "begin", "end")
    assert got[2].longest == 13 << 11 and got[10].n_removed == 0 and all(got[10 + i].kept == f"own {i}" for i in range(1, 300))


def test_packed():
    x = np.array([0, 1, 255, 256, 2**32 - 1])
    assert from_planes(planes(x)).tolist() == x.tolist()
    h = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    seen = {}
    for b, at in dealt(h, 7):
        assert (np.diff(at) > 0).all()
        seen |= dict.fromkeys(at.tolist(), b)
    assert len(seen) == 1000 and all(h[i] <= h[j] or seen[i] >= seen[j] for i in range(50) for j in range(50))
    assert joined(cut(h, np.array([0, 0, 400, 1000])), "<u8").tolist() == h.tolist()


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(x.doc_id, x.text) for x in docs.collect()], 13)
    got = sorted(tuple(x) for x in op13_substring_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest(), len(spans), longest) for i, n, gone, kept, spans, longest in want) and sum(x[2] for x in got)
