"""Byte-level BPE: texts to token ids and back, with a sentencepiece model made from the vocabulary.

A rank file holds one token a line: its bytes in base64 and its rank.  No merge
list is needed: of two neighbouring parts those are joined first whose
concatenation has the least rank.  That is what a sentencepiece BPE model does
if a piece's score is the negative of its rank, so the model is serialised from
the ranks: each byte becomes one character (U+0100 and up), the normaliser is
the identity, and nothing is trained.

A text is first cut into pre-tokens by a pattern; pieces never cross them.  Each
kind of pre-token goes through the model once for as long as a bounded cache
holds it.  A pre-token that is a token as a whole is that token, whether or not
the joins lead there; those that they don't lead to are found when the model is
built and looked up.  Decoding concatenates the bytes of the ids.

The rank file is read on the driver.  The model and the byte table, a few MB
and as large as the vocabulary (``MOST_BYTES`` at most), are broadcast.  Long texts
are cut into windows at safe places, so that memory is bounded by the text, its
ids and the longest stretch without a blank.

The pattern's classes are those of the ``regex`` module.  A character that its
Unicode version has and another implementation's lacks may be cut otherwise
there.

Edge cases: null and empty texts have no ids and decode to no bytes; null ids
decode to no bytes; ids that the vocabulary lacks are an error; repeated rows
are encoded each; other columns stay as they are, but for one with the name of a result,
which the result replaces; empty tables give empty tables; a vocabulary that
lacks a single byte is refused.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

MOST_BYTES = 64 << 20
WINDOW = 1 << 20
CACHED = 400_000
CACHED_CHARS = 48
BATCH_IDS = 1 << 20

_NAME = {b: chr(0x100 + b) for b in range(256)}
_ODD = re.compile(r"\s ")
_SAFE = re.compile(r"\S(?= )")


def named(raw: bytes) -> str:
    """One character for each byte."""
    return raw.decode("latin-1").translate(_NAME)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    return ranks


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(no: int, value: bytes) -> bytes:
    return _number(no << 3 | 2) + _number(len(value)) + value


def _int_field(no: int, value: int) -> bytes:
    return _number(no << 3) + _number(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes_field(1, _bytes_field(1, text.encode()) + _number(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind))


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: pieces in order of rank, then the unknown piece that each model must have.

    Ranks are exact as scores up to 2**24.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(_piece(named(token), -float(rank), normal) for token, rank in sorted(ranks.items(), key=lambda x: x[1]))
    trainer = _int_field(3, bpe) + _int_field(4, len(ranks) + 1)
    identity = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)  # no dummy prefix, blanks kept and not renamed
    return pieces + _piece("<unk>", 0.0, unknown) + _bytes_field(2, trainer) + _bytes_field(3, identity)


@dataclass
class Vocabulary:
    """What the tasks need: the model, the rank of each of its pieces, tokens that joins don't lead to, and the pattern."""

    model: bytes
    tokens: list[bytes]
    ranks: np.ndarray
    whole: dict[str, int]
    pattern: str


def vocabulary(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks of 2**24 and more aren't exact as scores")
    order = sorted(ranks, key=ranks.__getitem__)
    model = serialize_model(ranks)
    if len(model) > MOST_BYTES:
        raise ValueError(f"the model has {len(model)} bytes, more than the {MOST_BYTES} that are broadcast")
    reached = sentencepiece.SentencePieceProcessor(model_proto=model).encode([named(x) for x in order], num_threads=1)
    whole = {named(x): ranks[x] for i, x in enumerate(order) if reached[i] != [i]}
    return Vocabulary(model, order, np.array([ranks[x] for x in order], np.int32), whole, pattern)


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a space that follows something else than a blank."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class Encoder:
    """Encodes texts in one task.

    No pre-token goes on from something else than a blank to a space, so texts
    are cut there, and the pattern has to look at each kind of part once only.
    A text with a space after another blank is left to the pattern as a whole.
    Ids are held as the bytes of 32-bit integers.
    """

    def __init__(self, v: Vocabulary):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=v.model)
        self.cut = regex.compile(v.pattern).findall
        self.ranks = None if (v.ranks == np.arange(len(v.ranks))).all() else v.ranks.tolist()
        self.whole = v.whole
        self.kinds: dict[str, bytes] = {}  # of pre-tokens
        self.units: dict[str, bytes] = {}  # of what follows a space up to the next one, the space included

    def _encode_kinds(self, kinds: list[str]) -> Iterator[bytes]:
        names = [x.encode("utf-8", "replace").decode("latin-1").translate(_NAME) for x in kinds]
        for name, ids in zip(names, self.model.encode(names, num_threads=1)):
            if name in self.whole:
                ids = [self.whole[name]]
            elif self.ranks is not None:
                ids = [self.ranks[i] for i in ids]
            yield array("i", ids).tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        for known in (self.kinds, self.units):
            if len(known) > CACHED:
                known.clear()
        split = [(self.cut(x), []) if _ODD.search(x) else (self.cut(x[: x.find(" ")] if " " in x else x), x.split(" ")[1:]) for x in parts]
        units = list({u: None for _, rest in split for u in rest if u not in self.units})
        found = [self.cut(" " + u) for u in units]
        kinds = list({k: None for x in chain(found, (head for head, _ in split)) for k in x if k not in self.kinds})
        self.kinds |= zip(kinds, self._encode_kinds(kinds))
        of_kind, of_unit = self.kinds.__getitem__, self.units.__getitem__
        self.units |= zip(units, [b"".join(map(of_kind, x)) for x in found])
        out = [b"".join(chain(map(of_kind, head), map(of_unit, rest))) for head, rest in split]
        for known, new in ((self.kinds, kinds), (self.units, units)):
            for x in new:
                if len(x) > CACHED_CHARS:
                    del known[x]
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text.  Texts are taken together up to a window, and what is new in them is encoded at once."""
        held: list[str] = []
        owner: list[int] = []
        begun: list[list[bytes]] = []  # texts whose ids aren't all there yet
        size = 0

        def flush() -> None:
            nonlocal size
            for row, ids in zip(owner, self._encode_parts(held)):
                begun[row].append(ids)
            held.clear()
            owner.clear()
            size = 0

        for text in texts:
            begun.append([])
            for part in windows(text):
                held.append(part)
                owner.append(len(begun) - 1)
                size += len(part)
                if size >= WINDOW:
                    flush()
            if not held:
                yield from (np.frombuffer(b"".join(x), np.int32) for x in begun)
                begun.clear()
        flush()
        yield from (np.frombuffer(b"".join(x), np.int32) for x in begun)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names) if f != name}
    return pa.RecordBatch.from_arrays([*columns.values(), values], names=[*columns, name])


def _schema(df: DataFrame, name: str, kind: t.DataType) -> t.StructType:
    return t.StructType([*[f for f in df.schema.fields if f.name != name], t.StructField(name, kind)])


def encode(df: DataFrame, v: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as ``ids``, an array of integers."""
    handle = df.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(handle.value)
        for batch in batches:
            texts, at, held, n = batch.column(batch.schema.names.index(text)), 0, [], 0

            def flush(to: int) -> pa.RecordBatch:
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                flat = np.concatenate(held) if held else np.zeros(0, np.int32)
                return _with(batch.slice(at, to - at), ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))

            for i, found in enumerate(encoder.encode_all(x.as_py() or "" for x in texts)):
                held.append(found)
                n += len(held[-1])
                if n >= BATCH_IDS:
                    yield flush(i + 1)
                    at, held, n = i + 1, [], 0
            if held:
                yield flush(batch.num_rows)

    return df.mapInArrow(run, _schema(df, ids, t.ArrayType(t.IntegerType())))


def decode(df: DataFrame, v: Vocabulary, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for as ``raw``."""
    handle = df.sparkSession.sparkContext.broadcast((v.tokens, v.ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = handle.value
        table = dict(zip(ranks.tolist(), tokens))
        for batch in batches:
            lists, at, held, n = batch.column(batch.schema.names.index(ids)), 0, [], 0
            for i in range(batch.num_rows):
                found = lists[i].values
                try:
                    held.append(b"".join(map(table.__getitem__, found.to_numpy().tolist())) if found is not None else b"")
                except KeyError as e:
                    raise ValueError(f"no token has the id {e.args[0]}") from e
                n += len(held[-1])
                if n >= 4 * BATCH_IDS or i + 1 == batch.num_rows:
                    yield _with(batch.slice(at, i + 1 - at), raw, pa.array(held, pa.binary()))
                    at, held, n = i + 1, [], 0

    return df.mapInArrow(run, _schema(df, raw, t.BinaryType()))


def token_digests(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """One row for each document: doc_id, n_tokens, and digests of its ids and of the bytes they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    back = decode(encode(rows, v).drop("text"), v)
    shown = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), shown.alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
