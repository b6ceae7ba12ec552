"""Byte-level BPE over Arrow batches with the tokenizers library, from a file of byte ranks.

Bytes are written as the 256 printable characters of the byte-level alphabet; the vocabulary and the merges are built on that table,
and decoding takes each token's characters back through the inverted table. Offsets come from the tokens' bytes: a table from
each byte to the character it belongs to turns them into code points, so a character that is split between tokens gives each of them the whole
character's span, and decoding joins the bytes before any text is made of them.

With the pattern that most byte-level vocabularies use, texts are cut where no match can cross, each distinct piece is encoded once and kept
(PIECES at most, the most used ones stay), and a batch's tokens are gathered by numpy. With any other pattern whole texts are encoded.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CHUNK_BYTES, chunks, in_batches

#: So many distinct pieces keep their tokens, in a worker's memory.
PIECES = 200_000
#: New pieces are encoded so many at a time.
JOINED = 2000

# Fixed value: the pattern for which the cuts below are proved.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Space or newline or neither, then letters of the Latin blocks, digits, marks but the apostrophe: what is there of these is one match each.
SIMPLE = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ɏ]*)([0-9]*)([!-&(-/:-@\[-`{-~]*)")
#: The places to cut a text with other white space: a match can begin at a single space between other characters, but not go over it.
CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the other bytes take the code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 of the bytes, space, rank), in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(text) for text, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def _model(tokens: list[bytes]):
    from tokenizers import models

    alphabet = byte_alphabet()
    rank = {t: i for i, t in enumerate(tokens)}
    as_text = ["".join([alphabet[b] for b in t]) for t in tokens]
    # Every way to put a token together from two others is a merge with that token's rank.
    merges = [
        (as_text[rank[t[:k]]], as_text[rank[t[k:]]])
        for t in tokens
        for k in range(1, len(t))
        if t[:k] in rank and t[k:] in rank
    ]
    return models.BPE(vocab={t: i for i, t in enumerate(as_text)}, merges=merges, ignore_merges=True, cache_capacity=0)


class _Pieces(dict):
    """Numbers of distinct pieces. A word stands for the piece of it and the space before it (a word that begins with a newline for itself), a tuple of one
    text for that text. 0: a word that cannot be cut out so. New pieces wait in `fresh`."""

    def __init__(self):
        self.fresh: list[str | tuple[str]] = []
        self.used = 1

    def __missing__(self, key) -> int:
        number = self.used + len(self.fresh)
        if key.__class__ is str:
            body = key[1:] if key[:1] == "\n" else key
            if not body or body[0].isspace() or body[-1].isspace():
                self[key] = 0
                return 0
        self.fresh.append(key)
        self[key] = number
        return number


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of them, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        model = _model(read_ranks(path))
        self.known = pattern == PATTERN
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # For matches that are already cut and written in the alphabet, with spaces between them.
        self.matches = Tokenizer(model)
        self.matches.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        alphabet = byte_alphabet()
        self.to_alphabet = dict(enumerate(alphabet)) | {ord("\t"): " "}
        # The byte table, inverted.
        back = {c: b for b, c in enumerate(alphabet)}
        tokens = [bytes([back[c] for c in self.tokenizer.id_to_token(i)]) for i in range(self.tokenizer.get_vocab_size())]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    # Pieces

    def _forget(self) -> None:
        self.pieces = _Pieces()
        self.first, self.count, self.uses = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _keep_most_used(self) -> None:
        """Half of PIECES, by use."""
        old, first, count, ids = self.pieces, self.first, self.count, self.ids
        least = np.partition(self.uses, -PIECES // 2)[-PIECES // 2]
        stay = [(k, n) for k, n in old.items() if n and self.uses[n] > least]
        took = np.array([n for _, n in stay], np.int64)
        self._forget()
        self.pieces.update({k: i for i, (k, _) in enumerate(stay, 1)})
        self.pieces.used += len(stay)
        self.count = np.concatenate([[0], count[took]])
        self.first = np.cumsum(self.count) - self.count
        self.ids = ids[_spread(first[took], count[took])]
        self.uses = np.zeros(len(self.count), np.int64)

    def _learn(self) -> None:
        """Encodes the fresh pieces."""
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if not fresh:
            return
        self.pieces.used += len(fresh)
        first, count = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        ids, held = [self.ids], len(self.ids)
        simple: tuple[list, list, list] = [], [], []
        odd: tuple[list, list, list] = [], [], []
        alone: tuple[list, list, list] = [], [], []
        for i, key in enumerate(fresh):
            text = key[0] if key.__class__ is tuple else key if key[0] == "\n" else " " + key
            if key.isalpha() and key.isascii() if key.__class__ is str else False:
                group, form = simple, text
            elif (m := SIMPLE.fullmatch(text)) and (parts := [p for p in m.groups()[1:] if p]):
                group, form = simple, ("\n\t" if m[1] == "\n" else m[1]) + "\t".join(parts)
            else:
                group, form = alone if key.__class__ is tuple else odd, text
            group[0].append(i)
            group[1].append(len(text) if text.isascii() else len(text.encode()))
            group[2].append(form)
        matches = lambda x: self.matches.encode("\t".join(x).encode().decode("latin-1").translate(self.to_alphabet), add_special_tokens=False).ids
        pieces = lambda x: self.tokenizer.encode("".join(x), add_special_tokens=False).ids
        for (which, sizes, forms), encode, many in ((simple, matches, JOINED), (odd, pieces, JOINED), (alone, pieces, 1)):
            for at in range(0, len(which), many):
                got = np.array(encode(forms[at : at + many]), np.uint32)
                upto = np.searchsorted(np.cumsum(self.length[got]), np.cumsum(sizes[at : at + many]), "right")
                place = np.array(which[at : at + many])
                count[place] = np.diff(upto, prepend=0)
                first[place] = held + upto - count[place]
                ids.append(got)
                held += len(got)
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        self.ids = np.concatenate(ids)

    def _numbers(self, text: str) -> np.ndarray:
        """The pieces of a text.

        No match of PATTERN goes over a single space between characters that are no space: it can only begin there. Nor
        over a single newline there: that is a match by itself.
        """
        numbers = self.pieces.__getitem__
        words = text.replace("\n", " \n").split(" ")
        first = words[0]
        if not (first[:1].isspace() or first[-1:].isspace() or (not first and len(words) > 1)):
            words[0] = (first,)
            got = np.fromiter(map(numbers, words), np.int64, len(words))
            if got.all():
                return got
        words = CUT.split(text)
        return np.fromiter(map(numbers, zip(words)), np.int64, len(words))

    # Texts

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and how many of them are each text's."""
        if not self.known:
            found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)
        if len(self.pieces) > PIECES:
            self._keep_most_used()
        parts, owner = [], []
        for i, text in enumerate(texts):
            for piece in slices(text):
                parts.append(self._numbers(piece))
                owner.append(i)
        self._learn()
        numbers = np.concatenate([np.zeros(0, np.int64), *parts])
        counts = self.count[numbers]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ids = self.ids[_spread(self.first[numbers], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        edges = np.cumsum([0, *map(len, parts)])
        of_part = upto[edges[1:]] - upto[edges[:-1]]
        return ids, np.bincount(np.array(owner, np.int64), of_part, len(texts)).astype(np.int64)

    def spans(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's first and last code point (exclusive) in its text, by the table from bytes to characters."""
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        to_char = np.cumsum((data & 0xC0) != 0x80) - 1
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        chars = np.array([len(t) for t in texts], np.int64)
        base = np.repeat(np.cumsum(chars) - chars, counts)
        return to_char[ends - lengths] - base, to_char[ends - 1] + 1 - base

    def decode_all(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, one after the other."""
        return self.bytes[_spread(self.begin[ids], self.length[ids])].tobytes()

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("a token is not in the vocabulary")
        return self.decode_all(ids)


def slices(text: str, size: int = CHUNK_BYTES) -> Iterator[str]:
    """A text in parts of about so many characters, cut where no match of PATTERN can cross."""
    at = 0
    while len(text) - at > 2 * size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


@lru_cache(2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def encode_bytes(docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = True) -> DataFrame:
    """id, n_tokens, ids (binary: little-endian unsigned 32-bit), and if asked for: starts, ends (binary likewise: each token's code points
    in the text, end exclusive), decoded (binary: the bytes that the ids give back).

    Each match of pattern is encoded by itself, without special tokens. Null text: no tokens, as empty text. Very long texts are
    worked on in slices. Repeated rows each give a row; an empty table gives an empty result; other columns are not read.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if offsets:
        schema.add("starts", T.BinaryType()).add("ends", T.BinaryType())
    if decoded:
        schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            for part in chunks(batch, [1]):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, counts = bpe.encode_texts(texts)
                arrays = [part.column(0), pa.array(counts), pa.array(cut(ids.astype("<u4").tobytes(), 4 * counts), pa.binary())]
                if offsets:
                    arrays += [pa.array(cut(x.astype("<u4").tobytes(), 4 * counts), pa.binary()) for x in bpe.spans(texts, ids, counts)]
                if decoded:
                    upto = np.concatenate([[0], np.cumsum(bpe.length[ids])])
                    ends = upto[np.cumsum(counts)]
                    arrays.append(pa.array(cut(bpe.decode_all(ids), np.diff(ends, prepend=0)), pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    out = in_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode_bytes(df: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded (binary), text (the bytes as UTF-8; what is not UTF-8, as where ids end inside a character, becomes U+FFFD).

    Null ids give null; ids outside the vocabulary raise an error. Repeated rows each give a row; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            for part in chunks(batch, [1]):
                got = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in part.column(1).to_pylist()]
                text = [None if x is None else x.decode("utf-8", "replace") for x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary()), pa.array(text, pa.string())], names=schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_tokens(docs: DataFrame, *, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with two more columns: token_ids (array of int; null for a null text) and n_tokens. Columns of these names are replaced.

    The tokens are decoded again and must give the text. Rows stay as they are, repeated ones too; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())
    at = kept.index(next(c for c in kept if c.lower() == text_col.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            for part in chunks(batch, [at]):
                texts = part.column(at).to_pylist()
                missing = [t is None for t in texts]
                texts = [t or "" for t in texts]
                ids, counts = bpe.encode_texts(texts)
                if bpe.decode_all(ids) != "".join(texts).encode("utf-8", "surrogatepass"):
                    raise ValueError("the tokens do not give the text back")
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32)), mask=pa.array(missing, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(counts)], names=schema.names)

    return in_batches(docs.select(*kept)).mapInArrow(run, schema)
