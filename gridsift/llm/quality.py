"""Quality rules: word and line statistics, and compression bands.

The zstandard ratio (bytes before over bytes after) of a whole text and of its fixed chunks tells repetitive text (high) and
noise (low). All limits depend on the length, as short texts hardly compress; chunks are judged by their own length. All of it is work on one row at a time, over
Arrow batches: nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, chunks, hidden, in_batches, position, restored, utf8
from .wordhash import WordHashes, windows

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bytes of characters outside ASCII.
OUTSIDE = bytes(range(128, 256))


#: Points (bytes, ratio) of a limit: in between it is linear in the logarithm of the bytes.
Points = tuple[tuple[int, float], ...]


@dataclass(frozen=True)
class Bands:
    """A text, and each of its chunks, must have a ratio from the lower to the upper limit of its own length.

    Lower limits lie between noise (random words of printable ASCII, base64, letters, hex; random CJK) and prose of the same length. Where the
    two overlap prose stays, and such noise with it: random letters below about 2 KB, hex below about 6 KB. Upper limits are 1.5 times and more
    the largest ratio of 8,700 documents labelled good and of their chunks (1.57 below 256 bytes, 1.85 below 512, 2.02, 2.11, 2.23 and 2.35 below
    1, 2, 4 and 8 KiB, 2.54 below 64 KiB), so that tables and lists stay.
    """

    high: Points = ((64, 2.4), (256, 2.9), (512, 3.2), (1024, 3.6), (2048, 4.0), (4096, 4.4), (16384, 5.0), (65536, 5.5))
    #: Below the first point there is no lower limit: no such text can be told from noise.
    low: Points = ((256, 1.09), (512, 1.24), (1024, 1.48), (2048, 1.69), (4096, 1.9), (8192, 1.97), (16384, 2.05))
    #: Lower limits of texts and chunks more than wide_share of whose bytes are outside ASCII: letters of several bytes (CJK above all).
    wide: Points = ((1024, 1.2), (2048, 1.4), (4096, 1.58), (8192, 1.7), (16384, 1.75))
    wide_share: float = 0.25
    chunk_bytes: int = 2048
    #: A last chunk of fewer bytes is part of the one before, so every byte is judged.
    chunk_least: int = 512
    #: The largest share of chunks that may be out of their bands.
    chunk_share: float = 0.25
    level: int = 3


def limit(size: int, points: Points) -> float:
    """The limit at a size: that of the last point from there on, that of the first up to there."""
    for (a, low), (b, high) in zip(points, points[1:]):
        if size < b:
            return low if size <= a else low + (high - low) * math.log(size / a) / math.log(b / a)
    return points[-1][1]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in windows of so many words that occur twice or more. ids: one number for each word."""
    if len(ids) <= window:
        return 0
    hashes = windows(ids, window)
    order = np.sort(hashes)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Equal hashes exist: number the windows exactly, doubling their length until it is reached.
    _, rank = np.unique(ids, return_inverse=True)
    have, parts, done = 1, rank.astype(np.int64), 0
    exact: np.ndarray | None = None
    while have <= window:
        if window & have:
            piece = parts[done : done + len(ids) - window + 1]
            exact = piece if exact is None else np.unique(exact * (int(piece.max()) + 1) + piece, return_inverse=True)[1]
            done += have
        if have * 2 > window:
            break
        left, right = parts[:-have], parts[have:]
        parts = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        have *= 2
    again = np.bincount(exact)[exact] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _is_wide(data: bytes, share: float) -> bool:
    return not data.isascii() and len(data) - len(data.translate(None, OUTSIDE)) > share * len(data)


def chunks_of(data: bytes, bands: Bands) -> list[bytes]:
    ends = list(range(bands.chunk_bytes, len(data) - bands.chunk_least + 1, bands.chunk_bytes))
    return [data[a:b] for a, b in zip([0, *ends], [*ends, len(data)])]


def in_bands(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> bool:
    """Whether a whole text and all but chunk_share of its chunks are inside the bands. An empty text is."""

    def inside(part: bytes) -> bool:
        points = bands.wide if _is_wide(part, bands.wide_share) else bands.low
        ratio = len(part) / len(packer.compress(part))
        return ratio <= limit(len(part), bands.high) and (len(part) < points[0][0] or ratio >= limit(len(part), points))

    if not data:
        return True
    if not inside(data):
        return False
    parts = chunks_of(data, bands)
    return len(parts) == 1 or sum(not inside(p) for p in parts) <= bands.chunk_share * len(parts)


def statistics(text: str | None, hashes: WordHashes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    text = text or ""
    data = utf8(text)
    words = data.split()  # of bytes: splits at [\x20\x09-\x0D] and nothing else
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = repeated_words(hashes.of(words))
    failed = len(words) < 20 or 100 * again > 30 * len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, not failed and in_bands(data, bands, packer)


FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def _judged(df: DataFrame, at: int, names: list[str], bands: Bands) -> DataFrame:
    """df (few columns) with FIELDS added."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, (_, k) in zip(names, FIELDS)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = WordHashes(), zstandard.ZstdCompressor(level=bands.level)
        for batch in (part for whole in batches for part in chunks(whole, [at])):
            rows = [statistics(t.as_py(), hashes, bands, packer) for t in batch.column(at)]
            more = [pa.array([r[k] for r in rows], pa.bool_() if isinstance(kind, T.BooleanType) else pa.int64()) for k, (_, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return in_batches(df).mapInArrow(run, schema)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """id and FIELDS for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+. n_dup_lines: lines with a word that equal an earlier line. base_failed: fewer than 20 words, or
    over 30 % of them in repeated windows of 8. kept: not base_failed, and inside the compression bands. Null text counts as
    empty and is not kept. Repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    """
    return _judged(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")), 1, [n for n, _ in FIELDS], bands).drop("text")


def keep_good(docs: DataFrame, *, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that quality_report() keeps, columns as they were: null and empty texts go, repeated rows share their fate, an empty table stays empty."""
    src = hidden(docs)
    at = src.columns.index(position(docs, text_col))
    return restored(_judged(src, at, [f"q_{n}" for n, _ in FIELDS], bands).filter("q_kept"), docs)
