"""Search, sharding, joins, mixing, archives and the pipeline against plain Python."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridsift.llm import common, kdtree, ngram_join, queries
from gridsift.llm.components import connected_components
from gridsift.llm.hilbert import curve, hilbert_shards, write_shards
from gridsift.llm.kdtree import top_k
from gridsift.llm.mixing import described, marginals, mixture, sample_mixture
from gridsift.llm.ngram_join import folded, keep_one, parity, similar_groups
from gridsift.llm.wordhash import WordHashes
from gridsift.llm.warc import captures, parsed, read_archives, round_trip, unzipped, write_archives

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def brute_top(rows, k):
    whole = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in whole if i % 50 == 0}:
        asked = min(v for i, v in whole if i == q)
        found = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in whole if i != q and len(v) == len(asked))
        out |= {(q, r, i, -s, n) for n, (r, (s, i)) in enumerate(((r + 1, x) for r, x in enumerate(found[:k])))}
    return sorted(x[:4] for x in out)


@pytest.mark.parametrize("shard", [40, 8192])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", shard)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 3)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(60)] + [(600, None), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (750, [float("inf")] * 6), (None, [0.1] * 6), (800, [1.0, 2.0]), (801, [3.0, 4.0]), (7, [0.2] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0, k=5).collect())
    assert got == brute_top(rows, 5)


def test_top_k_of_large_and_few(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(x) for x in top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == 2**63 - 1 and got[1][3] == -(2**63)
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_hilbert_curve_is_one_path():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        order = curve(bits, dims)
        assert sorted(order) == list(range(1 << bits * dims))
        side, cell = 1 << bits, {c: i for i, c in enumerate(order)}
        point = lambda i: [i // side ** (dims - 1 - d) % side for d in range(dims)]
        assert all(sum(abs(a - b) for a, b in zip(point(cell[k]), point(cell[k + 1]))) == 1 for k in range(len(order) - 1))


@pytest.mark.parametrize("n", [0, 5, 100])
def test_shards(spark, tmp_path, n):
    rows = [(i, None if i % 11 == 0 else "é" * (i % 17), None if i % 13 == 0 else f"s{i % 2 * i}", i % 5) for i in range(n)] + [(3, "twice", "s", 1)] * 2 * (n == 100)
    df = docs_of(spark, rows, "doc_id long, text string, source string, shard int")
    got = hilbert_shards(df, dims=["source", "shard"], n_shards=16).collect()
    assert sorted((x.doc_id, x.size, x.text_crc32) for x in got) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(16))
    ordered = sorted(got, key=lambda x: (x.shard, x.slot))
    assert [x.curve for x in ordered] == sorted(x.curve for x in ordered)
    assert sorted(map(tuple, got)) == brute_shards(rows, [2, 3], 16)
    assert sorted(map(tuple, hilbert_shards(df.repartition(7, "text"), dims=["source", "shard"], n_shards=16).collect())) == sorted(map(tuple, got))


def brute_shards(rows, dims, n_shards, bits=4):
    """Rows (id, text, ...) as id, size, crc, curve, shard, slot: bins from sorted values, places from the curve, ranks from one sort of all rows."""
    side, order = 1 << bits, curve(bits, len(dims))
    cell = [0] * len(rows)
    for d in dims:
        values = sorted((r[d] for r in rows), key=lambda v: (v is not None, v))
        edges = {values[-(-len(rows) * k // side) - 1] for k in range(1, side)} if rows else set()
        edges = [e for e in edges if e is not None and e != values[-1]]
        for i, r in enumerate(rows):
            cell[i] = cell[i] * side + sum(r[d] is not None and r[d] > e for e in edges)
    total, counts = len(rows), Counter(order[c] for c in cell)
    placed = []
    for r, c in zip(rows, cell):
        text = (r[1] or "").encode()
        crc, size = zlib.crc32(text), len(text) + 1
        h = xxhash64(r[0], crc, size)
        subs = -(-counts[order[c]] * 2048 // total)
        placed.append((order[c], h % subs, h, r[0], crc, size))
    out, small, more = [], total // n_shards, total % n_shards
    for rank, (place, _, _, d, crc, size) in enumerate(sorted(placed)):
        head = more * (small + 1)
        shard, slot = divmod(rank, small + 1) if rank < head else divmod(rank - head, max(small, 1))
        out.append((d, size, crc, place, shard + (more if rank >= head else 0), slot))
    return sorted(out)


def xxhash64(*values):
    """Spark's: of 64-bit numbers, each one's hash the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) * (seed >> 63)


def test_op3_query(spark):
    rows = [(x.doc_id, x.text, x.source, x.lang, x.n_chars) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [(x.doc_id, x.size, x.text_crc32, x.curve, x.shard, x.slot) for x in queries.op3_hilbert_shards(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == brute_shards(rows, [2, 3, 4], 16)


def test_write_shards(spark, tmp_path):
    rows = [(None, "null id", "common_2023", 1), (1, "é", "common_2024", 2), (2, "twice", "common_2024", 3), (2, "twice", "common_2024", 3), (3, None, None, None)]
    df = docs_of(spark, rows, "doc_id long, text string, size string, slot int")
    manifest = write_shards(df, str(tmp_path / "out"), dims=["size", "slot"], n_shards=2).orderBy("shard").collect()
    assert [(x.rows, x.shard) for x in manifest] == [(3, 0), (2, 1)] and sum(x.bytes for x in manifest) == sum(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    assert [(x.min_size, x.max_size) for x in manifest] == [("common_2023", "common_2024"), ("common_2024", "common_2024")]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, map(tuple, back.select(df.columns).collect()))) == sorted(map(repr, rows))
    assert write_shards(df.limit(0), str(tmp_path / "none"), dims=["size"], n_shards=2).count() == 0


def brute_groups(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x])
        for j, o in both.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                up[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 9, 12, 16, 30, 128, 255, 260, 700]))] + passage * (r.random() < 0.3)
        for _ in range(r.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(r.randrange(1 + max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    drift = [r.choice(words) for _ in range(150)]
    for k in range(70):
        if k % 8 == 0:
            drift[r.randrange(150)] = r.choice(words)
        copy = list(drift)
        copy[r.randrange(150)] = r.choice(words)
        rows.append((len(rows), " ".join(copy)))
    return rows + [(900, ""), (901, None), (None, "a b c d e f"), (7, "A b  C d e f"), (7, "A b  C d e f"), (902, "q"), (903, "x " * 3000)]


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_similar_groups(spark, size, num):
    rows = near_copies(size)
    got = similar_groups(docs_of(spark, rows), size=size, num=num, den=100).collect()
    assert sorted(map(repr, ((x.doc_id, x.n_shingles, x.component_id) for x in got))) == sorted(map(repr, brute_groups(rows, size, num, 100)))


def test_keep_one_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (9, "other words that are alone here", "c"), (8, "", "d"), (10, None, "e"), (8, "", "d")]
    out = keep_one(docs_of(spark, rows, "doc_id long, text string, node string"))
    assert sorted(r.doc_id for r in out.collect()) == [3, 8, 8, 9, 10] and out.columns == ["doc_id", "text", "node"]
    assert similar_groups(docs_of(spark, [])).count() == 0


def test_bitmaps_and_components(spark):
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 900).astype(np.uint64))
    assert folded(parity(s, 2048), 64) == int.from_bytes(parity(s, 512))
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


MIXED = "doc_id long, text string, source string, lang string, factor int, topic string"


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.3, "de": 0.6, "": 0.1, "xx": 0.2}}, {"source": {"big": 0.2}, "lang": {"en": 0.5}}])
def test_mixture(spark, targets):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), "big" if r.random() < 0.7 else f"s{r.randrange(3)}", r.choice(["en", "de", None]), 1, "x") for i in range(800)] + [(5000, None, None, None, None, None), (5001, "", "big", "en", 0, "y"), (3, "w", "big", "en", 1, "x"), (3, "w", "big", "en", 1, "x")]
    df = docs_of(spark, rows, MIXED)
    out = mixture(df, power=0.5, targets=targets).collect()
    assert len(out) == len(rows) and all(0 < x.probability <= 1 for x in out if x.n_tokens)
    error = {(x.dim, x.value): (x.target_share, x.expected_share) for x in marginals(df, power=0.5, targets=targets).collect()}
    for dim in ("source", "lang", "topic"):
        has, want = Counter(), Counter()
        for x in out:
            has[x[dim]] += x.n_tokens
            want[x[dim]] += x.n_tokens * x.probability
        named = (targets or {}).get(dim, {})
        rest, others = max(0, 1 - sum(named.values())) if named else 1, {k: v**0.5 for k, v in has.items() if v and k not in named}
        share = {k: named[k] if k in named else rest * others[k] / sum(others.values()) for k, v in has.items() if v}
        share = {k: v / sum(share.values()) for k, v in share.items()}
        # One part in a hundred of the tokens may ask for more than there is of them.
        assert all(abs(want[k] / sum(want.values()) - share[k]) < 2e-2 for k in share), dim
        assert all(error[dim, k] == pytest.approx((share[k], want[k] / sum(want.values())), abs=1e-6) for k in share), dim
    kept = sample_mixture(df, power=0.5, targets=targets)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in out if x.selected) and kept.columns == df.columns
    assert mixture(df.limit(0)).count() == 0


def test_a_rare_source_does_not_thin_out_the_others(spark):
    rows = [(i, "w " * 30, f"s{i % 5}", "en", 1, "x") for i in range(2000)] + [(9999, "w", "rare", "xx", 1, "x")]
    out = {x.doc_id: x.probability for x in mixture(docs_of(spark, rows, MIXED), power=0.5).collect()}
    assert out[9999] == 1 and all(p > 0.98 for p in out.values())


def test_topics_by_form(spark):
    texts = {"table": "a | b | c\n" * 9, "contact": "write to me@x.org " + "w " * 300, "markup": "<p>x</p> {a=1} " * 5, "symbols": "w $ w # w % " * 9, "speech": 'he said "no"? ' * 9, "list": "one\ntwo\n" * 20, "note": "w " * 100, "article": "w " * 1500, "book": "w " * 3000}
    got = spark.createDataFrame(list(texts.items()) + [("note", None), ("note", "")], "name string, text string").select("name", described(F.col("text"))["topic"].alias("topic")).collect()
    assert all(x.name == x.topic for x in got)


def test_warc(spark, tmp_path):
    body = "<html>" + "é" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</html>"
    rows = [(3, "http://a.example/x?q=1#f", body), (1, "http://a.example/", body), (2, None, body), (4, "bad\r\nurl", "small"), (5, "http://b.example", "small"), (6, "http://c.example", None), (7, "http://d.example", body + "2"), (7, "http://d.example", body + "2")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = round_trip(pages)
    out = sorted((r.main.page_id, r.main.kind, r.main.bytes if r.main.bytes is not None else r.referred.bytes, r.main.digest, r.referred.page_id if r.referred else None) for r in got.collect())
    first = {body: 1, body + "2": 7}
    want = sorted((p, "revisit" if first.get(h or "", p) != p else "response", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), first[h] if first.get(h or "", p) != p else None) for p, _, h in rows)
    assert out == want
    assert all(r.request is not None and r.metadata is not None for r in got.collect())
    path = str(tmp_path / "w")
    write_archives(pages, path)
    records = read_archives(spark, path, payloads=True)
    assert {bytes(r.payload).decode() for r in records.filter("kind = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert captures(records.filter("kind <> 'request'")).filter("request IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        list(parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))
    assert round_trip(pages.limit(0)).count() == 0


def record(kind, name, *concurrent, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"WARC-Concurrent-To: {c}" for c in concurrent], *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_captures_by_chains_and_several_identifiers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    records = [
        # A chain: the metadata names the request, the request the response.
        record("response", "<r1>", block=http), record("request", "<q1>", "<r1>"), record("metadata", "<m1>", "<q1>", block=b"one"),
        # The metadata names both; the response names its request.
        record("response", "<r2>", "<q2>", block=http), record("request", "<q2>"), record("metadata", "<m2>", "<q2>", "<r2>", block=b"two"),
        # One request for two responses.
        record("response", "<r3>", block=http), record("response", "<r4>", block=http), record("request", "<q3>", "<r3>", "<r4>"),
        # No response; a response alone; one that names itself; a plain one.
        record("request", "<q5>", "<gone>"), record("metadata", "<m5>", "<q5>"), record("response", "<r6>", block=http),
        record("response", "<r7>", "<r7>", block=http), record("metadata", "<m7>", "<r7>"), record("response", "<r8>", block=http), record("request", "<q8>", "<r8>"), record("metadata", "<m8>", "<r8>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records[::2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[1::2])) + b"\0" * 8)
    found = read_archives(spark, f"{tmp_path}/*.war*")
    name = lambda x: x.record_id if x else None
    got = sorted(((r.main.record_id, name(r.request), name(r.metadata)) for r in captures(found).collect()), key=repr)
    assert got == [("<r1>", "<q1>", "<m1>"), ("<r2>", "<q2>", "<m2>"), ("<r3>", "<q3>", None), ("<r4>", "<q3>", None), ("<r6>", None, None), ("<r7>", None, "<m7>"), ("<r8>", "<q8>", "<m8>")]
    assert {x.record_id: x.concurrent_to for x in found.collect()}["<m2>"] == ["<q2>", "<r2>"]
    assert captures(found.filter("record_id = '<r1>'")).count() == 1 and captures(found.limit(0)).count() == 0
    with pytest.raises(ValueError):
        unzipped(gzip.compress(b"x" * 100)[:-9])


def test_warc_of_a_gzip_member_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", f"<html>{k}</html>") for k in range(3)], "page_id long, url string, html string").coalesce(1)
    write_archives(pages, str(tmp_path / "one"))
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "one").glob("*.gz"))
    records, at = [b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"], 0
    for end in [*(m.start() for m in re.finditer(rb"(?<=\r\n\r\n)WARC/1.1\r\n", plain)), len(plain)]:
        records += [plain[at:end]] * (end > at)
        at = end
    assert len(records) == 10
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    found = read_archives(spark, str(tmp_path / "many.warc.gz"))
    assert Counter(r.kind for r in found.collect()) == {"warcinfo": 1, "request": 3, "response": 3, "metadata": 3}
    assert sorted((r.main.page_id, r.main.bytes, r.request is not None, r.metadata is not None) for r in captures(found).collect()) == [(k, 14, True, True) for k in range(3)]


def templated(docs, shared, own, seed=5):
    """Documents of one template and words of their own."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(shared)]
    return [(d, " ".join(template + [f"o{r.randrange(10**9)}" for _ in range(own)])) for d in range(docs)]


def test_documents_of_a_template_do_not_meet(spark):
    """Similarity 0.74 each to each: no link, and as many signatures shared however many documents there are."""
    pairs = []
    for docs in (300, 600):
        rows = templated(docs, 850, 150) + [(docs + k, t) for k, (_, t) in enumerate(templated(2, 850, 150))]
        df = docs_of(spark, rows)
        got = {x.doc_id: x.component_id for x in similar_groups(df, size=3, num=90, den=100).collect()}
        assert got == {d: d if d < docs else d - docs for d, _ in rows}
        frequent = ngram_join._frequent(df.select("text"), 3)
        sigs = ngram_join.Signatures(90, 100, frequent)
        hashes = WordHashes()
        held = Counter(x for _, t in rows for x in sigs.of(ngram_join.shingles(t, 3, hashes)).tolist())
        pairs.append(sum(k * (k - 1) // 2 for k in held.values()))
    assert pairs[1] <= 3 * max(pairs[0], 500)


def test_counters_grow_with_the_text():
    assert [ngram_join.counters_for(x) for x in (0, 1 << 27, 1 << 30, (1 << 30) + 128, 1 << 50)] == [1 << 20, 1 << 20, 1 << 23, 1 << 24, 1 << 25]


def test_signatures_are_not_stored(spark):
    """Of texts that share nothing, what is written is far less than their signatures: 200 or more of 8 bytes for each text."""
    r = random.Random(3)
    rows = [(d, " ".join(f"w{r.randrange(10**9)}" for _ in range(402))) for d in range(600)]
    begin = common.written()
    got = similar_groups(docs_of(spark, rows), size=3, num=50, den=100).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == [(d, 400, d) for d, _ in rows]
    left = [f for p in common._WRITTEN[begin:] for f in Path(p.removeprefix("file://")).rglob("*.parquet")]
    assert left and sum(f.stat().st_size for f in left) < 600 * 200 * 8 / 2


def test_copies_in_many_tasks_share_each_signature_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(d, text) for d in range(40)] + [(40, text + " more"), (41, "other words stand here"), (42, ""), (43, None)]
    src = docs_of(spark, rows).selectExpr("doc_id AS id", "text").repartition(8)
    assert src.rdd.getNumPartitions() == 8
    got = [tuple(x) for x in ngram_join._shared(src, 3, 90, 100, bytes(1 << 17)).collect()]
    assert len(got) == len(set(got)) and all(k == 2 for k in Counter(s for s, _ in got).values()) and len({n for _, n in got}) == 2
    assert {x.doc_id: x.component_id for x in similar_groups(src.withColumnRenamed("id", "doc_id")).collect()} == {d: 0 if d <= 40 else d for d, _ in rows}


def test_op7_query(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in queries.op7_ngram_join(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(brute_groups(rows, 3, 90, 100)) and any(d != c for d, _, c in got)


def test_searches_with_thresholds_of_rounds(spark, monkeypatch):
    """Clusters far apart, so that cells are left out, and a hot vector that fills shards of its own."""
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 30)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 4)
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 5)) * 9
    rows = [(i, (centres[i % 12] + r.normal(size=5)).round(2).tolist()) for i in range(500)] + [(1000 + i, centres[0].round(1).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0, k=5).collect())
    assert got == brute_top(rows, 5)
