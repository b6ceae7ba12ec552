"""The pipeline against plain Python, on the driver's smallest table."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import pytest
from test_corpus_operators import brute_groups
from test_text_operators import brute_bands, brute_lines, brute_quality

import corpus_pipeline
from gridsift.llm import queries
from gridsift.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def topic(text):
    size = max(1, len(text.encode()))
    forms = {"table": ("|\t", 5), "contact": ("@", 0.5), "markup": ("<{}=", 5), "symbols": ("#$%&*", 5), "speech": ('?"', 6), "list": ("\n", 20)}
    scores = {name: sum(map(text.count, signs)) * 1000 / (size * least) for name, (signs, least) in forms.items()}
    best = max(scores, key=scores.get)
    return best if scores[best] >= 1 else "note" if len(text) < 500 else "article" if len(text) < 4000 else "book"


def brute_mixture(rows):
    """The ids that stay of (id, text, lang, source)."""
    cell = {d: (s or "", lang or "", topic(t)) for d, t, lang, s in rows}
    tokens = defaultdict(float)
    for d, t, _, _ in rows:
        tokens[cell[d]] += len(re.findall("[^\x20\x09-\x0d]+", t))
    total, factor, targets = sum(tokens.values()), dict.fromkeys(tokens, 1.0), []
    for k in range(3):
        has = defaultdict(float)
        for c, v in tokens.items():
            has[c[k]] += v
        raised = {x: v**0.9 for x, v in has.items()}
        targets.append({x: v * total / sum(raised.values()) for x, v in raised.items()})
    for _ in range(40):
        for k in range(3):
            has = defaultdict(float)
            for c, v in tokens.items():
                has[c[k]] += v * factor[c]
            factor = {c: f * targets[k][c[k]] / has[c[k]] for c, f in factor.items()}
    # The first bin, from the top, with which more than a hundredth of the tokens has been passed.
    above = 0.0
    for edge in sorted({math.floor(math.log2(f) * 64) for f in factor.values()}, reverse=True):
        above += sum(v for c, v in tokens.items() if math.floor(math.log2(factor[c]) * 64) == edge)
        if above > 0.01 * total:
            break
    scale = 2 ** ((edge + 1) / 64)
    return {d for d in cell if int(hashlib.md5(f"{d}:17".encode()).hexdigest()[:13], 16) / 2**52 < factor[cell[d]] / scale}


def brute_pipeline(rows):
    """(id, text, token ids) of what the stages leave of (id, text, lang, source)."""
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = queries.ranks_and_pattern()
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(read_ranks(ranks))}, special_tokens={})
    rows = [r for r in rows if not brute_quality(r[1])[-1] and brute_bands(r[1].encode())]
    kept = {d: t for d, _, _, t in brute_lines([r[:2] for r in rows], 40, 5)}
    rows = [(r[0], kept[r[0]], *r[2:]) for r in rows]
    groups = {d: (n, c) for d, n, c in brute_groups([r[:2] for r in rows], 5, 80, 100)}
    rows = [r for r in rows if not groups[r[0]][0] or groups[r[0]][1] == r[0]]
    stay = brute_mixture(rows)
    return sorted((d, t, encoder.encode_ordinary(t)) for d, t, _, _ in rows if d in stay)


@here
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns[: len(columns)] == columns, name
    want = brute_pipeline(rows)
    assert 0 < len(want) < len(rows)
    assert sorted((r.doc_id, r.text, r.token_ids) for r in docs.collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == [d for d, _, _ in want]


ODD = "doc_id long, text string, lang string, source string, n_chars long, node string, c1 array<int>, shard int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, extra columns with an operator's own names."""
    r = random.Random(2)
    prose = " ".join("".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randrange(2, 9))) for _ in range(160))
    shared = "a line of more than forty characters that several documents share"
    rows = [(i, prose + f" tail{i}\n{shared}", "en", "s", 1, "x", [i], 3) for i in range(6)]
    rows += [(20, None, None, None, None, None, None, None), (21, "", "", "", 0, "", [], 0), (None, prose[:500], None, "s", None, None, None, None), (22, "long " * 60_000, "en", "s", 1, "x", [1], 1)]
    rows += [(23, prose[300:], "en", "s", 5, "x", [2], 2)] * 2
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    out = stage(spark, docs, SF)
    got = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    ids = sorted((x.doc_id is None, x.doc_id or 0) for x in got)
    want = {
        # Null, empty and repetitive texts are no prose; the others stay, the repeated row twice.
        "quality rules": [0, 1, 2, 3, 4, 5, 23, 23, None],
        "line dedup": [0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 23, None],
        # One of the near copies and one of the repeated rows; texts without words all stay.
        "n-gram Jaccard join": [0, 20, 21, 22, 23, None],
        "byte-level BPE": [0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 23, None],
    }.get(name)
    if want is None:
        assert set(ids) <= {(d is None, d or 0) for d, *_ in rows} and (False, 20) in ids
    else:
        assert ids == sorted((d is None, d or 0) for d in want)
    if name == "line dedup":
        assert [shared in x.text for x in sorted(got, key=lambda x: x.doc_id or 0) if x.doc_id is not None and x.doc_id < 6] == [False] * 5 + [True]
    kept = {(x.doc_id, x.lang, x.source, x.node, x.shard) for x in got}
    assert kept <= {(d, lang, s, n, k) for d, _, lang, s, _, n, _, k in rows}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_stored_tables_can_be_deleted(spark):
    from gridsift.llm.common import release, stored, written

    place = lambda df: df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    before = place(stored(spark.range(3), "t"))
    begin = written()
    paths = [place(stored(spark.range(3), "t")) for _ in range(3)]
    assert release(spark, begin, keep_last=True) == 2 and [os.path.isdir(p) for p in [before, *paths]] == [True, False, False, True]
    assert release(spark) > 0 and not any(map(os.path.isdir, [before, *paths]))


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
