"""Substring dedup: word sequences that several documents hold are cut from all but the first, found by level-wise doubling.

Level one: every window of so many words of every document is hashed, and the hashes are dealt to buckets by value. A bucket tells which
windows start in more than one document, and which of these start in a document with a smaller id; nothing else goes on. Then each window
that survived and is followed, at its own length, by another survivor, makes one of twice the length, whose hash is that of the two; these
are dealt and judged in the same way, and so on until none survive. A text is read once: from level two on there are only survivors.

The first level tells what is cut; the others how long the common passages are. Windows are 64-bit hashes of sequences of 64-bit word
hashes: two different ones of n windows are taken for one another with a chance of about n**2 / 2**65.

A bucket holds BUCKET_WINDOWS windows or so, in 10 to 20 bytes each, and one that is common in all documents as often as it is there. What a task
holds beside it is a unit of MOST_UNIT windows at most, and one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, in_batches, stored, utf8
from .packed import byte_planes, cut, dealt, from_byte_planes, from_planes, joined, planes
from .wordhash import WordHashes, mixed, windows

BUCKET_WINDOWS = 2_000_000
#: A unit has WINDOWS_A_BUCKET windows for each bucket on average, within these bounds: what is sent to a bucket at once then keeps some size.
LEAST_UNIT, MOST_UNIT, WINDOWS_A_BUCKET = 700_000, 2_500_000, 400
#: Bytes of text for a word, on average; it only steers the number of buckets.
WORD_BYTES = 6
LEAST_BUCKETS = 24

_PACKED = "bucket int, ids binary, tags binary, counts binary, starts binary, hashes binary"
_FOUND = "id long, tag long, n int, starts binary, hashes binary"


class _Unit:
    """Windows of some documents, until there are enough of them to be dealt."""

    def __init__(self, buckets: int):
        self.buckets, self.most = buckets, min(MOST_UNIT, max(LEAST_UNIT, WINDOWS_A_BUCKET * buckets))
        self._clear()

    def _clear(self) -> None:
        self.ids, self.tags, self.docs, self.starts, self.hashes, self.n, self.size = [], [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, tags: np.ndarray, docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows by document (an index into ids and tags) and start, ascending."""
        for x, to in ((ids, self.ids), (tags, self.tags), ((docs + self.n).astype(np.int32), self.docs), (starts.astype(np.uint32), self.starts), (hashes, self.hashes)):
            to.append(x)
        self.n += len(ids)
        self.size += len(hashes)
        if self.size >= self.most:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, tags, docs, starts, hashes = map(np.concatenate, (self.ids, self.tags, self.docs, self.starts, self.hashes))
        self._clear()
        for bucket, at in dealt(hashes, self.buckets):
            doc, start = docs[at], starts[at].astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            step = np.diff(start, prepend=0)
            step[begin] = start[begin]
            counts = np.diff(np.concatenate([begin, [len(at)]]))
            values = [byte_planes(ids[doc[begin]]), planes(tags[doc[begin]]), planes(counts), planes(step), hashes[at].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([v], pa.binary()) for v in values]], names=["bucket", "ids", "tags", "counts", "starts", "hashes"])


def _first_windows(words: int, buckets: int):
    """Rows of _PACKED from (id, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unit = WordHashes(), _Unit(buckets)
        for batch in batches:
            for part in chunks(batch, [2]):
                ids, tags, found = [], [], []
                for i, tag, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    split = utf8(text).split()
                    if len(split) >= words:
                        ids.append(i)
                        tags.append(tag)
                        found.append(windows(hashes.of(split), words))
                if found:
                    sizes = np.array([len(x) for x in found])
                    starts = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
                    yield from unit.add(np.array(ids, np.int64), np.array(tags, np.int64), np.repeat(np.arange(len(found)), sizes), starts, np.concatenate(found))
        yield from unit.rows()

    return run


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (id, tag, parts): for each window its document's index, start, whether a smaller id has it, and hash; by document and start."""
    parts = batch.column(2).flatten()
    starts = joined(parts.field(0), "<u4").astype(np.int64)
    owner = np.asarray(pc.list_parent_indices(batch.column(2)), np.int64)
    doc = np.repeat(owner, np.asarray(pc.binary_length(parts.field(0)), np.int64) // 4)
    key = doc << 33 | starts
    order = np.argsort(key, kind="stable")
    return doc[order], starts[order] >> 1, (starts[order] & 1).astype(bool), joined(parts.field(1), "<u8")[order]


def _doubled_windows(words: int, buckets: int):
    """Rows of _PACKED for windows of twice so many words, from (id, tag, parts) of those that survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _Unit(buckets)
        for batch in batches:
            for part in _bounded(batch):
                doc, start, _, hashes = _spread(part)
                key = doc << 32 | start
                at = np.minimum(np.searchsorted(key, key + words), len(key) - 1)
                here = np.flatnonzero(key[at] == key + words)
                if len(here):
                    with np.errstate(over="ignore"):
                        double = mixed(mixed(hashes[here] + np.uint64(words)) + hashes[at[here]])
                    ids, tags = (np.asarray(part.column(c), np.int64) for c in (0, 1))
                    yield from unit.add(ids, tags, doc[here], start[here], double)
        yield from unit.rows()

    return run


def _bounded(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A batch of (id, tag, parts, n) in parts of so many windows or one row."""
    if batch.num_rows:
        part = np.cumsum(np.asarray(batch.column(3), np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _judged(table: pa.Table) -> pa.Table:
    """Of a bucket's windows those that start in two documents or more: rows of _FOUND. The lowest bit of a start tells that a smaller id has the window."""
    each = lambda name, back: np.concatenate([back(x.as_py()) for x in table.column(name)])
    ids, tags, counts = each("ids", from_byte_planes), each("tags", from_planes), each("counts", from_planes).astype(np.int64)
    starts = each("starts", from_planes).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    firsts = starts[begin]
    np.cumsum(starts, out=starts)
    starts -= np.repeat(starts[begin] - firsts, counts)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    hashes = joined(table.column("hashes"), "<u8")
    order = np.argsort(hashes)
    same = hashes[order]
    group = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    del same
    size = np.diff(np.concatenate([group, [len(order)]]))
    own = ids[doc[order]]
    least = np.minimum.reduceat(own, group)
    several = least != np.maximum.reduceat(own, group)
    lives, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    lives[order] = np.repeat(several, size)
    later[order] = own > np.repeat(least, size)
    del own, order
    at = np.flatnonzero(lives)
    doc, flagged, hashes = doc[at], (starts[at] << 1 | later[at]).astype("<u4"), hashes[at]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    edges = np.concatenate([first, [len(doc)]]).astype(np.int64)
    return pa.table([pa.array(ids[doc[first]]), pa.array(tags[doc[first]].astype(np.int64)), pa.array(np.diff(edges).astype(np.int32)), cut(flagged, edges), cut(hashes, edges)], names=["id", "tag", "n", "starts", "hashes"])


def _covered(words: int):
    """(id, tag, starts, ends) of the stretches that windows with a smaller id cover, from (id, tag, parts, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _bounded(batch):
                doc, start, later, _ = _spread(part)
                doc, start = doc[later], start[later]
                if not len(doc):
                    continue
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + words)])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
                owner = doc[first]
                own = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                edges = pa.array(np.concatenate([own, [len(owner)]]), pa.int32())
                spans = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in (start[first], start[last] + words)]
                took = pa.array(owner[own])
                yield pa.RecordBatch.from_arrays([part.column(0).take(took), part.column(1).take(took), *spans], names=["id", "tag", "starts", "ends"])

    return run


def repeated_passages(src: DataFrame, words: int) -> DataFrame:
    """(id, tag, starts, ends, longest) for each of the rows (id, tag, text) that has a window of so many words in common with another id.

    starts, ends: the stretches of words that windows cover which also start in a row with a smaller id (empty, if there are none).
    longest: the greatest of words, 2 * words, 4 * words .. that is the length of a window in common.
    """
    src = in_batches(src.filter("id IS NOT NULL"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, level, lengths = size // WORD_BYTES, words, []
    spans = state = None
    while True:
        buckets = max(LEAST_BUCKETS, -(-n // BUCKET_WINDOWS))
        packed = src.mapInArrow(_first_windows(words, buckets), _PACKED) if state is None else state.mapInArrow(_doubled_windows(level // 2, buckets), _PACKED)
        found = stored(packed.groupBy("bucket").applyInArrow(_judged, _FOUND), "repeated-windows", keep_shuffle=False)
        if state is not None:
            dropped(state)
        n = found.agg(F.sum("n")).first()[0] or 0
        if not n and spans is not None:
            dropped(found)
            break
        state = stored(found.groupBy("id", "tag").agg(F.collect_list(F.struct("starts", "hashes")).alias("parts"), F.sum("n").alias("n")), "windows", keep_shuffle=False)
        dropped(found)
        lengths.append(stored(state.select("id", "tag", F.lit(level).cast("long").alias("longest")), "lengths"))
        if spans is None:
            spans = stored(state.mapInArrow(_covered(words), "id long, tag long, starts array<long>, ends array<long>"), "spans")
        level *= 2
    longest = lengths[0]
    for more in lengths[1:]:
        longest = longest.unionByName(more)
    longest = longest.groupBy("id", "tag").agg(F.max("longest").alias("longest"))
    none = F.array().cast("array<long>")
    return longest.join(spans, ["id", "tag"], "left").withColumns({c: F.coalesce(c, none) for c in ("starts", "ends")})


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept, starts, ends, longest) from (id, text, starts, ends, longest)."""
    for batch in batches:
        for part in chunks(batch, [1]):
            n, gone, kept = [], [], []
            for text, starts, ends in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                words = utf8(text).split()
                n.append(len(words))
                rest = words
                if starts:
                    rest, at = [], 0
                    for a, b in zip(starts, ends):
                        rest += words[at:a]
                        at = b
                    rest += words[at:]
                gone.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *part.columns[2:]], names=["id", "n_words", "n_removed", "kept", "starts", "ends", "longest"])


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 13) -> DataFrame:
    """One row per row of docs: its id, n_words, n_removed, kept (text), spans (array of start, end: the words removed, from 0), longest.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is so many consecutive words of one text; each word that a window covers whose words also
    start somewhere in a row with a smaller id goes. Windows are judged on the texts as they are given. kept: the other words, joined by one
    space. longest: the greatest of words, 2 * words, 4 * words .. for which a window of that length is in a row with another id as well, or 0.

    ids are whole numbers. A null id takes no part: its row keeps all words, and no other row loses any for it. Null, empty or blank text: no
    words. Rows that share an id don't count against each other; repeated rows each give a row with the same result. Texts of any length are
    whole, and of fewer words than a window lose nothing. An empty table gives an empty result. Other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col)).toDF("id", "text").withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(1 << 32)))
    passages = repeated_passages(src.select("id", "tag", "text"), words)
    both = src.join(passages, ["id", "tag"], "left").select("id", "text", "starts", "ends", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
    out = both.mapInArrow(_without, "id long, n_words long, n_removed long, kept string, starts array<long>, ends array<long>, longest long")
    spans = F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", spans.alias("spans"), "longest")
