"""Phrase collocations against plain definitions."""

import random
import re
from collections import Counter

import pytest

from gridsift.llm import collocations as module
from gridsift.llm.collocations import Automaton, collocations, tokens
from gridsift.llm.queries import op11_collocations


def brute(rows, least, top=2000):
    f: dict[str, Counter] = {}
    total = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_here = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_here.append((score, a, " ".join(p), left, right))
        rows_here.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k, p, a, left, right, total[lang], score) for k, (score, a, p, left, right) in enumerate(rows_here[:top], 1)]
    return sorted(out)


def rows(seed, n=120):
    r = random.Random(seed)
    stock = ["New York", "a b c d", "b c d", "ÉTÉ Été", "on the other hand", "x x x x x", "b c", "of the"]
    out = []
    for _ in range(n):
        parts = [r.choice(stock) if r.random() < 0.6 else r.choice(["a", "b", "the", "Of", "zz"]) for _ in range(r.randrange(25))]
        text = "".join(p + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "  "]) for p in parts)
        out.append((r.choice(["en", "en", "en", "de", None, ""]), text))
    return out + [(None, None), ("fr", None), ("fr", ""), ("en", out[0][1]), ("en", out[0][1]), ("xx", ".,;"), ("xx", "lone")]


@pytest.mark.parametrize("least", [1, 3, 8])
def test_against_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(module, "LEAST_BUCKETS", 3)
    data = rows(least)
    docs = spark.createDataFrame([(*x, 1, "q") for x in data], "lang string, text string, n int, phrase string").repartition(4)
    assert sorted(map(tuple, collocations(docs, least=least).collect())) == brute(data, least)


def test_top_ties_and_empty(spark):
    data = [("en", ". ".join(f"a{k} b{k}" for k in range(40)))] * 5
    got = sorted(map(tuple, collocations(spark.createDataFrame(data, "lang string, text string"), least=3, top=7).collect()))
    assert got == brute(data, 3, 7) and len(got) == 7
    none = collocations(spark.createDataFrame([], "lang string, text string"))
    assert none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and none.count() == 0


def test_long_text(spark):
    data = [("en", "again and again " * 40_000), ("en", " ".join(f"w{k}" for k in range(50_000)))]
    got = sorted(map(tuple, collocations(spark.createDataFrame(data, "lang string, text string"), least=30).collect()))
    assert got == brute(data, 30) and got


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Filters only save work: one of 64 bits passes everything."""
    data = rows(9)
    monkeypatch.setattr(module, "FILTER_BITS", 64)
    assert sorted(map(tuple, collocations(spark.createDataFrame(data, "lang string, text string"), least=4).collect())) == brute(data, 4)


def test_automaton():
    r = random.Random(2)
    for _ in range(60):
        runs = [tuple(r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 6))]
        automaton, text, want = Automaton(), [], Counter()
        for k, run in enumerate(runs):
            automaton.add(run, len(text), k + 1)
            text += run
            for m in range(2, 5):
                for i in range(len(run) - m + 1):
                    want[run[i : i + m]] += k + 1
        got = Counter()
        for m, ends, counts in automaton.substrings(4):
            for e, n in zip(ends.tolist(), counts.tolist()):
                phrase = tuple(text[e - m + 1 : e + 1])
                assert phrase not in got
                got[phrase] = n
        assert got == want
        # A state's suffix link holds a shorter suffix of what the state holds, in more places.
        for v in range(1, len(automaton.link)):
            assert automaton.length[automaton.link[v]] < automaton.length[v]


def test_tokens():
    assert tokens("A b.C\x0bd\t e") == [b"a", b"b", b"\xff", b"c", b"\xff", b"d", b"e", b"\xff"] and tokens(None) == [b"\xff"]


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([(x.lang, x.text) for x in docs.collect()], 30)
    assert sorted(map(tuple, op11_collocations(spark, str(tmp_path)).collect())) == want and len(want) > 20
