"""N-gram Jaccard join: documents whose sets of word shingles are nearly equal, exactly, and the components that they form.

Signatures. All shingles have one global order. A set of n shingles can lose t = n - ceil(similarity * n) of them to a
similar set; a prefix of its shingles in that order is taken that no t losses can rob of its signatures. A rare shingle is a
signature by itself. Frequent shingles are dealt into small classes and every pair of a class within the prefix is a
signature; as a pair survives unless all but one of the class are lost, a class of c counts c - 1, and the prefix is
extended until the counts exceed t. Two similar sets then have a signature in common. Which shingles are frequent comes from a
count of all shingles of all documents in hashed counters, as many as the corpus's bytes ask for (MOST_COUNTERS at most); it steers cost
only, never results. As every shingle is counted, documents that share a template but have enough words of their own get signatures of
their own words alone, and never meet.

Signatures are never stored: they go from the texts straight to the one shuffle that brings equal ones together, and only those that
several sets have are written.

Links. A signature's sets are not paired with each other. First each set meets the smallest and the largest set of its
signatures, one such pair is verified, and the links give first components, which hold the large groups of near copies. Then only
pairs across components are left: each set outside its signature's main component meets the rest. Of the pairs
between two components the nearest is verified first, and the others only where that does not join the two. Candidates
must pass bounds by size and by parity bitmaps (which differ in at most as many bits as the sets do in shingles): of 512 bits
inside the joins, then of about a bit for each shingle. What passes is verified on the whole sets. So every link is found or
joins two sets that are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, chunks, dropped, hidden, in_batches, position, restored, stored, utf8
from .components import connected_components
from .wordhash import WordHashes, mixed, windows

#: Counters of shingles: one for so many bytes of text, within these bounds, and their parts that tasks exchange.
BYTES_PER_COUNTER, LEAST_COUNTERS, MOST_COUNTERS, PART = 128, 1 << 20, 1 << 25, 1 << 18
#: Sets of fewer shingles have single-shingle signatures alone.
PAIRS_FROM = 16
#: Sets that a task remembers to have named.
MEMO_SETS = 200_000
BITMAP_WORDS = 8
#: Bits of the filter by which a task knows the sets to be verified (2 MB).
FILTER_BITS = 1 << 24


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. Words: [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    return np.unique(windows(hashes.of(utf8(text).lower().split()), size))


def _counter(h: np.ndarray, width: int) -> np.ndarray:
    return (h >> np.uint64(34)).astype(np.int64) & (width - 1)


def counters_for(size: int) -> int:
    """How many counters so many bytes of text get: a power of two."""
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, size // BYTES_PER_COUNTER - 1).bit_length()))


class Signatures:
    """The signatures of a set. frequent: which counters are (a bit each, packed)."""

    def __init__(self, num: int, den: int, frequent: bytes):
        self.num, self.den = num, den
        self.frequent = np.frombuffer(frequent, np.uint8)

    def of(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        need = n + -(-self.num * n // self.den) * -1 + 1
        at = _counter(s, 8 * len(self.frequent))
        often = ((self.frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        rare, common = s[~often], s[often]
        octave = n.bit_length() - 1
        # Sets that may have a partner in the next octave stand in both.
        octaves = [octave, *[octave + 1] * (n * self.den // self.num >= 2 << octave)]
        return np.unique(np.concatenate([self._in(o, need, rare, common) for o in octaves]))

    def _in(self, octave: int, need: int, rare: np.ndarray, common: np.ndarray) -> np.ndarray:
        salt = mixed(np.array([octave + 1], np.uint64))
        if 1 << octave < PAIRS_FROM:
            rare, common = np.concatenate([rare, common]), common[:0]
            # One order for all, by hash.
            rare.sort()
        if len(rare) >= need:
            return mixed(rare[:need] ^ salt)
        need -= len(rare)
        out = [mixed(rare ^ salt)]
        kind = (mixed(common + salt) % np.uint64(max(1, (1 << octave) // 16))).astype(np.int64)
        worth = np.ones(len(common), np.int64)
        worth[np.unique(kind, return_index=True)[1]] = 0
        gained = np.cumsum(worth)
        took = min(int(np.searchsorted(gained, need)) + 1, len(common))
        need -= int(gained[took - 1]) if took else 0
        kind, common, left = kind[:took], common[:took], common[took:]
        order = np.argsort(kind, kind="stable")
        kind, paired = kind[order], common[order]
        for gap in range(1, took):
            same = kind[gap:] == kind[:-gap]
            if not same.any():
                break
            out.append(mixed(mixed(paired[:-gap][same] ^ salt) * np.uint64(3) + paired[gap:][same]))
        if need > 0:
            # Classes of one: too few pairs in all the set, so frequent shingles stand by themselves as well.
            out.append(mixed(np.concatenate([common, left]) ^ salt))
        return np.concatenate(out)


def parity(s: np.ndarray, bits: int) -> bytes:
    """So many bits, a power of two; each shingle turns one of them over."""
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(wide: bytes, size: int) -> int:
    """A bitmap as a number, folded to so many bytes: what parity() gives for as many bits."""
    while len(wide) > size:
        half = len(wide) // 2
        wide = (int.from_bytes(wide[:half]) ^ int.from_bytes(wide[half:])).to_bytes(half)
    return int.from_bytes(wide)


def wide_bits(n: int) -> int:
    return max(64 * BITMAP_WORDS, 1 << (n - 1).bit_length() if n else 0)


#: Sets of a component that those sharing a signature with it meet, before they meet all that share it.
PIVOTS = 128


def node_of(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def _facts(src: DataFrame, size: int) -> tuple[DataFrame, int]:
    """src (id, text) as id, t (hash of the text), n, node (hash of the set; null if empty), wide, b0...; and, in rows of their own, part and counts: what each task counted of all shingles. Stored; and the number of counters.

    A task's counts are mostly zeros where counters are many, and are compressed: by the bytes of its texts, not by the counters.
    """
    width, long = counters_for(src.agg(F.sum(F.octet_length("text"))).first()[0] or 0), T.LongType()
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("t", long), T.StructField("n", long), T.StructField("node", long), T.StructField("wide", T.BinaryType()), *[T.StructField(f"b{i}", long) for i in range(BITMAP_WORDS)], T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, kind = WordHashes(), np.zeros(width, np.uint32), None
        for batch in (part for whole in batches for part in chunks(whole, [2])):
            n, node, wide, maps, kind = [], [], [], [], batch.schema.types[0]
            for text in batch.column(2):
                s = shingles(text.as_py(), size, hashes)
                np.add.at(total, _counter(s, width), np.uint32(1))
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                wide.append(parity(s, wide_bits(len(s))))
                maps.append(np.frombuffer(folded(wide[-1], 8 * BITMAP_WORDS).to_bytes(8 * BITMAP_WORDS), "<i8").tolist())
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(wide, pa.binary()), *[pa.array(m, pa.int64()) for m in zip(*maps)]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=schema.names)
        packer = zstandard.ZstdCompressor(level=1)
        for i in range(width // PART):
            if (part := total[i * PART : (i + 1) * PART]).any():
                arrays = [pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * BITMAP_WORDS]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([i], pa.int32()), pa.array([packer.compress(part.tobytes())], pa.binary())], names=schema.names)

    return stored(src.select("id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema), "facts"), width


def _frequent(texts: DataFrame, size: int) -> bytes:
    """Which counters are frequent by the shingles of texts (text) alone."""
    return _often(*_facts(texts.select(F.lit(0).alias("id"), "text"), size))


def _often(facts: DataFrame, width: int) -> bytes:
    """Which counters are frequent, a bit each: far above what chance gives a counter at the corpus's number of shingles."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts.as_py()), np.uint32)
                sums[part] = sums.get(part, 0) + got.astype(np.int64)
        for part, total in sums.items():
            # A part's mean is the corpus's, as hashes deal the shingles out.
            mean = total.mean()
            bits = np.packbits(total > mean + 4 * mean**0.5 + 12, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], names=["part", "bits"])

    counted = facts.filter(F.col("part").isNotNull()).select("part", "counts").repartition(width // PART, "part")
    flags = bytearray(width // 8)
    for row in stored(counted.mapInArrow(add, "part int, bits binary"), "frequent", keep_shuffle=False).collect():  # MOST_COUNTERS bits at most
        flags[row.part * PART // 8 : (row.part + 1) * PART // 8] = row.bits
    return bytes(flags)


def _shared(src: DataFrame, size: int, num: int, den: int, frequent: bytes) -> DataFrame:
    """sig, node: the signatures that several sets have, with those sets. Stored.

    All other signatures, nearly all of them, cross one shuffle and no disk besides: they go to it straight from the texts. A task names a
    set once, so copies add no more than a row for each task and signature.
    """
    shared = src.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signatures, seen = WordHashes(), Signatures(num, den, shared.value), set()
        for batch in (part for whole in batches for part in chunks(whole, [0])):
            sigs, nodes = [], []
            for text in batch.column(0):
                s = shingles(text.as_py(), size, hashes)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= MEMO_SETS:
                    seen.clear()
                seen.add(node)
                sigs.append(signatures.of(s).view(np.int64))
                nodes.append(node)
            if nodes:
                arrays = [pa.array(np.concatenate(sigs)), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["sig", "node"])

    of_sig = Window.partitionBy("sig")
    ends = src.select("text").mapInArrow(run, "sig long, node long").select("sig", "node", F.min("node").over(of_sig).alias("lo"), F.max("node").over(of_sig).alias("hi"))
    return stored(ends.filter("lo <> hi").select("sig", "node").distinct(), "shared-signatures", keep_shuffle=False)


def _turned(a: str, b: str):
    """In how many bits of their bitmaps a and b differ."""
    return sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, BITMAP_WORDS)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))


def _may_link(a: str, b: str, num: int, den: int):
    """The bounds by size and by bitmap, for columns n and b0... of a and b."""
    an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(an, bn) * den >= F.greatest(an, bn) * num) & (_turned(a, b) * (den + num) <= (an + bn) * (den - num))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of pairs (u, v) that link: by the wide bitmaps, then by whole sets. These are made anew from the texts (t, text), of the nodes in question alone."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*[batch.column(k).to_pylist() for k in range(2, 6)]):
                least = min(len(x), len(y))
                keep.append((folded(x, least) ^ folded(y, least)).bit_count() * (den + num) <= (n + m) * (den - num))
            yield batch.select(["u", "v", "tu", "tv"]).filter(pa.array(keep, pa.bool_()))

    one = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"w{end}"), F.col("t").alias(f"t{end}"))
    both = pairs.select("u", "v").join(one("u"), "u").join(one("v"), "v").select("u", "v", "nu", "nv", "wu", "wv", "tu", "tv")
    pairs = stored(both.mapInArrow(near, "u long, v long, tu long, tv long"), "near-pairs", keep_shuffle=False)
    found = pairs.select(F.explode(F.array("tu", "tv")).alias("t")).groupBy((F.pmod("t", F.lit(FILTER_BITS)) / 64).cast("int").alias("w"))
    flags = np.zeros(FILTER_BITS // 64, np.int64)
    for row in found.agg(F.expr("bit_or(shiftleft(1L, cast(pmod(t, 64) as int)))").alias("bits")).collect():  # FILTER_BITS at most
        flags[row.w] = row.bits
    shared = pairs.sparkSession.sparkContext.broadcast(flags.view(np.uint64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flags = WordHashes(), shared.value
        for batch in (part for whole in batches for part in chunks(whole, [1])):
            at = batch.column(0).to_numpy() % FILTER_BITS
            took = np.flatnonzero((flags[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            made = [shingles(batch.column(1)[int(i)].as_py(), size, hashes) for i in took]
            made = [s for s in made if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in made], pa.int64()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], names=["node", "s"])

    whole = texts.mapInArrow(sets, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))
    x, y = whole.select(F.col("node").alias("u"), F.col("s").alias("x")), whole.select(F.col("node").alias("v"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return stored(pairs.join(x, "u").join(y, "v").filter(both * den >= (F.size("x") + F.size("y") - both) * num).select("u", "v"), "verified", keep_shuffle=False)


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """id, t, n, node of every row of docs, and component: the smallest id that links reach."""
    src = in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    bits = [f"b{i}" for i in range(BITMAP_WORDS)]
    texts = src.select(F.xxhash64("text").alias("t"), "text")
    first, width = _facts(src, size)
    frequent = _often(first, width)
    # What is kept of each row is short; equal sets are one node from here on.
    rows = first.filter(F.col("part").isNull())
    sets = stored(rows.select("id", "t", "n", "node"), "sets")
    nodes = stored(rows.filter(F.col("node").isNotNull()).select("node", "n", "t", "wide", *bits).dropDuplicates(["node"]), "nodes", keep_shuffle=False)
    dropped(first)
    facts = nodes.select("node", "n", *bits)
    postings = _shared(src, size, num, den, frequent)
    # Signatures of the very same sets bring the same pairs: one of them is enough. Such are those of a template that many texts fill in.
    marks = {"lo": F.min("node"), "hi": F.max("node"), "k": F.count("*"), "x": F.bit_xor(F.xxhash64("node")), "y": F.bit_xor(F.xxhash64(F.lit(7), "node"))}
    ends = postings.groupBy("sig").agg(*[c.alias(n) for n, c in marks.items()])
    ends = ends.groupBy(*marks).agg(F.min("sig").alias("sig")).select("sig", "lo", "hi")
    shared = stored(postings.join(ends, "sig"), "shared-signatures", keep_shuffle=False)
    dropped(postings)

    def linked(ends: DataFrame) -> DataFrame:
        """Of each set's pairs (node, end) the one that the bitmaps put nearest, if it links."""
        a, b = facts.alias("a"), facts.alias("b")
        near = ends.join(a, F.col("a.node") == ends["node"]).join(b, F.col("b.node") == ends["end"]).filter(_may_link("a", "b", num, den))
        nearest = near.groupBy(F.col("a.node").alias("u")).agg(F.min_by("b.node", F.struct(_turned("a", "b"), F.col("b.node"))).alias("v"))
        return _verified(nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), nodes, texts, size, num, den)

    def labelled_by(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each signature's sets with their components, and for each signature with more than one the component that most of its sets are in."""
        labelled = shared.select("sig", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        by_part = labelled.groupBy("sig", "component").agg(F.count("*").alias("k"))
        main = by_part.groupBy("sig").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("k", "component")).alias("main")).filter("parts > 1")
        return labelled, main

    # First each set meets the ends of its signatures; then those that are not in a signature's main component meet some sets of that component.
    links = linked(shared.select("node", F.explode(F.array("lo", "hi")).alias("end")).filter("node <> end").distinct())
    labels = connected_components(links)
    labelled, main = labelled_by(labels)
    apart = labelled.join(main.select("sig", "main"), "sig").filter("component <> main").select("node", "main").distinct()
    members = labels.join(apart.select(F.col("main").alias("component")).distinct(), "component").groupBy("component", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("p"))
    pivots = members.agg(F.min("node").alias("end")).select(F.col("component").alias("main"), "end")
    links = links.union(linked(apart.join(pivots, "main").select("node", "end").distinct()))
    labels = connected_components(links)
    # What is left: pairs of different components that share a signature.
    labelled, main = labelled_by(labels)
    left = stored(labelled.join(main.select("sig", "main"), "sig").join(facts, "node"), "across", keep_shuffle=False)
    a, b = left.filter("component <> main").alias("a"), left.alias("b")
    apart = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    across = a.join(b, (F.col("a.sig") == F.col("b.sig")) & apart & _may_link("a", "b", num, den))
    swap = F.col("a.component") > F.col("b.component")
    ends = [F.when(swap, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}")).alias(n) for n, x, y, c in (("u", "a", "b", "node"), ("v", "b", "a", "node"), ("cu", "a", "b", "component"), ("cv", "b", "a", "component"))]
    across = stored(across.select(*ends, _turned("a", "b").alias("turned")).distinct(), "pairs", keep_shuffle=False)
    if not across.isEmpty():
        best = stored(across.groupBy("cu", "cv").agg(F.min_by(F.struct("u", "v"), F.struct("turned", "u", "v")).alias("p")).select("p.*"), "pairs", keep_shuffle=False)
        links = links.union(_verified(best, nodes, texts, size, num, den))
        labels = connected_components(links)
        now = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"l{end}"))
        rest = across.join(best, ["u", "v"], "left_anti").join(now("u"), "u", "left").join(now("v"), "v", "left")
        rest = stored(rest.filter(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v"), "pairs", keep_shuffle=False)
        if not rest.isEmpty():
            links = links.union(_verified(rest, nodes, texts, size, num, den))
            labels = connected_components(links)
    named = sets.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    placed = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("id").alias("least"))
    of_node = placed.join(least, "component").select("node", "least")
    out = sets.select("id", "t", "n", "node").join(of_node, "node", "left")
    return out.select("id", "t", "n", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("component"))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id of each row: components of the links between texts whose sets of size-word shingles have den * intersection >= num * union.

    With fewer words than size the whole sequence is the one shingle; without words, or with a null text, the set is empty and
    the row is linked with nothing (its component is its own id). Equal texts are linked, rows with equal ids too only if their texts
    are. A null id is never a component's name unless all its ids are null. Repeated rows each give a row; an empty
    table gives an empty result; other columns are not read.
    """
    out = _grouped(docs, id_col, text_col, size, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each of similar_groups(): that with the smallest id. Texts without words all stay, and so do rows with a null id
    in a group without other ids. Of rows repeated with id and text, one stays. Columns stay as they were.
    """
    src = hidden(docs)
    doc_id, text = position(docs, id_col), position(docs, text_col)
    rows = stored(_grouped(docs, id_col, text_col, size, num, den).filter(F.col("node").isNotNull()).withColumn("stays", F.col("id").eqNullSafe(F.col("component"))), "groups", keep_shuffle=False)
    gone = rows.filter(~F.col("stays")).select(F.col("id").alias("gone_id"), F.col("t").alias("gone_t")).distinct()
    few = rows.filter(~F.col("stays")).count() <= BROADCAST_ROWS
    hashed = src.withColumn("t", F.xxhash64(F.col(text)))
    out = hashed.join(F.broadcast(gone) if few else gone, F.col(doc_id).eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left_anti")
    # An id that several texts of one group bear, or repeated rows: rare, and only then worth a shuffle of the texts.
    twice = rows.filter("stays").groupBy("id", "component").agg(F.count("*").alias("k")).filter("k > 1")
    if not twice.isEmpty():
        one = rows.filter("stays").groupBy("id", "component").agg(F.min("t").alias("one_t")).select(F.col("id").alias("one_id"), "one_t").distinct()
        worded = rows.filter("stays").select(F.col("id").alias("w_id"), F.col("t").alias("w_t")).distinct()
        has_words = out.join(worded, F.col(doc_id).eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t")), "left_semi")
        wordless = out.join(worded, F.col(doc_id).eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t")), "left_anti")
        has_words = has_words.join(one, F.col(doc_id).eqNullSafe(F.col("one_id")) & (F.col("t") == F.col("one_t")), "left_semi").dropDuplicates([doc_id, "t"])
        out = has_words.unionByName(wordless)
    return restored(out, docs)
