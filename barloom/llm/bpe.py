"""Byte-level BPE encoding and decoding by a sentencepiece model.

The ranks of a byte-level vocabulary are serialised directly as a sentencepiece
BPE model: each token's bytes become printable characters (one character a
byte), the score of a piece is its negative rank, and the normaliser is the
identity.  Merging the adjacent pair of best score is then merging the pair of
lowest rank.  Pre-tokens are matched by the vocabulary's pattern and encoded
one by one; ids are decoded by the inverse mapping of the pieces.

Defined results: a null text is the empty text, which has no tokens; texts of
any length are encoded whole; rows are independent, so repeated rows, ties and
empty tables need nothing special, and other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import read_documents, whole_text

#: Pre-tokens remembered by a Python worker at once.
REMEMBERED = 200_000
#: Texts whose tokens a worker holds at once.
PIECE = 500


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


@lru_cache(1)
def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks, and one unknown piece after them.

    Fields: pieces 1 (piece 1, score 2, type 3), trainer 2 (model type 3, size 4,
    unknown, begin, end and pad ids 40 to 43), normaliser 3 (name 1, dummy prefix 3,
    remove spaces 4, escape spaces 5).
    """
    chars = byte_characters()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_block(1, _block(1, "".join(chars[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)) for token, rank in ordered]
    unknown = _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(ordered) + 1) + _number(40, len(ordered)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normaliser)


class ByteBpe:
    """Encodes and decodes; keeps what it found for the last pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(read_ranks(path)))
        self.table = str.maketrans(dict(enumerate(byte_characters())))
        back = {c: b for b, c in enumerate(byte_characters())}
        self.token = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(words)
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
        self.known.update(zip(new, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self._learn(set(words))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def count(self, text: str) -> int:
        words = self.split(text)
        self._learn(set(words))
        return sum(map(len, map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(4)
def coder(path: str | None, pattern: str | None) -> ByteBpe:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ByteBpe(path or vocabulary_path(), pattern)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE rows, so that a worker holds the tokens of few texts at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            yield batch.slice(k, PIECE)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` array<int>: the tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in _slices(batches):
            yield _with(batch, "ids", pa.array([bpe.encode(t or "") for t in batch.column(text).to_pylist()], pa.list_(pa.int32())))

    kept = docs.drop("ids")
    return kept.mapInArrow(run, kept.withColumn("ids", F.array().cast("array<int>")).schema)


def decode_ids(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``rows`` with ``decoded`` binary: the bytes that the tokens stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in _slices(batches):
            yield _with(batch, "decoded", pa.array([bpe.decode(x.as_py() or []) for x in batch.column(ids)], pa.binary()))

    kept = rows.drop("decoded")
    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit(b"").cast("binary")).schema)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode its tokens: the id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if they are kept."""
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in _slices(batches):
            n, digest, back, kept = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids))
                digest.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), schema.names)

    return docs.select(F.col(id_column), whole_text(text).alias("t")).mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_documents(spark, sf_dir))
