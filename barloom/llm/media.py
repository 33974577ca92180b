"""Texts as PNG images in a binary column, read back and hashed by their low frequencies.

A payload becomes an 8-bit grey image 64 samples wide: signature, header,
deflated scan lines and end chunk, each chunk with its CRC-32.  Every scan line
has the filter of the five whose residuals have the least sum of absolute
values.  Reading tests the signature and every checksum, inflates, and undoes the
filters with numpy for a group of images at once: a sample depends on those to
its left and above, so the samples of one anti-diagonal of all images are one
step.  The feature is a 64-bit hash: the image is
averaged to 32 x 32, its cosine transform is taken by a matrix product, and each
of the 8 x 8 lowest frequencies is compared with their median.

Defined results: a null text is the empty one, which is stored as 64 zero bytes;
rows are independent, so repeated rows, ties and empty tables need nothing
special; columns other than the id and the text are not looked at.  A damaged
image raises ``ValueError`` and names the chunk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialise, pieces, read_documents, whole_text

WIDTH = 64
LINES = 1 << 16  # scan lines that are filtered or unfiltered at once; an image of more is alone
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filter_lines(rows: np.ndarray, first: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Scan lines of several images, each with its filter's number before it.

    first: whether a row is the first of its image; kind: one filter for all, else
    the one of least absolute residuals, the lowest number of equals.
    """
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    up[first] = 0
    corner[:, 1:] = up[:, :-1]
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    least = np.full(len(rows), 1 << 30)
    for k, guess in enumerate((0, left, up, (left + up) >> 1, _paeth(left, up, corner))):
        if kind in (None, k):
            residual = (x - guess).astype(np.uint8)
            size = np.abs(residual.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            better = size < least
            least[better] = size[better]
            out[better, 0], out[better, 1:] = k, residual[better]
    return out


def _image(lines: np.ndarray, level: int) -> bytes:
    header = struct.pack(">IIBBBBB", lines.shape[1] - 1, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _groups(sizes: list[int]) -> Iterator[range]:
    """Neighbours of at most LINES lines together, or one alone."""
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > LINES:
            yield range(start, k)
            start, held = k, 0
        held += n
    if len(sizes):
        yield range(start, len(sizes))


def encode_png(payloads: list[bytes], kind: int | None = None, level: int = 6) -> list[bytes]:
    """Grey images of the payloads, whose lengths are positive multiples of WIDTH."""
    heights = [len(p) // WIDTH for p in payloads]
    out = []
    for group in _groups(heights):
        starts = np.cumsum([0, *(heights[k] for k in group)])
        first = np.zeros(starts[-1], bool)
        first[starts[:-1]] = True
        lines = filter_lines(np.frombuffer(b"".join(payloads[k] for k in group), np.uint8).reshape(-1, WIDTH), first, kind)
        out += [_image(lines[a:b], level) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return out


def decode_png(images: list[bytes]) -> Iterator[np.ndarray]:
    """The samples of each image, height x width; raises ValueError where a checksum or a length is wrong."""
    held: list[np.ndarray] = []
    for data in images:
        lines = _inflated(data)
        if held and (lines.shape[1] != held[0].shape[1] or sum(map(len, held)) + len(lines) > LINES):
            yield from unfilter(held)
            held = []
        held.append(lines)
    yield from unfilter(held)


def _inflated(data: bytes) -> np.ndarray:
    """The filtered scan lines, each with its filter's number before it."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, packed, header, kind = 8, [], None, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the image ends inside a chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"wrong checksum in chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing are read")
    width, height = header[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    return lines.reshape(height, width + 1)


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """The samples of filtered images of one width.

    Lines are kept in order of their place in their image, so that step t (the
    samples whose line and column add up to t) takes neighbouring lines.
    """
    if not images:
        return []
    heights = np.array([len(x) for x in images])
    lines = np.concatenate(images)
    if lines[:, 0].max(initial=0) > 4:
        raise ValueError(f"unknown filter {lines[:, 0].max()}")
    n, width = len(lines), lines.shape[1] - 1
    place = np.arange(n) - np.repeat(np.cumsum(heights) - heights, heights)
    order = np.argsort(place, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    place, kind, given = place[order], lines[order, 0], np.ascontiguousarray(lines[order, 1:])
    above = np.where(place > 0, back[order - 1], n)  # line n and column 0 are zero
    out = np.zeros((n + 1, width + 1), np.int16)
    flat, residual = out.ravel(), given.ravel()
    last = int(place[-1]) if n else -1
    first = np.searchsorted(place, np.arange(last + 2))  # of the lines at each place
    for t in range(last + width):
        a, b = first[max(0, t - width + 1)], first[min(t, last) + 1]
        column = t - place[a:b]
        here = np.arange(a, b) * (width + 1) + column
        over = above[a:b] * (width + 1) + column
        left, corner, up = flat[here], flat[over], flat[over + 1]
        guess = np.choose(kind[a:b], (0, left, up, (left + up) >> 1, _paeth(left, up, corner)))
        flat[here + 1] = (residual[np.arange(a, b) * width + column] + guess) & 255
    whole = out[back, 1:].astype(np.uint8)
    return np.split(whole, np.cumsum(heights)[:-1])


@lru_cache(1)
def cosine_basis() -> np.ndarray:
    """The 8 lowest frequencies over 32 samples."""
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / 64)


def frequency_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine frequencies are above their median (the constant one left out of it)."""
    height = image.shape[0]
    columns = image.reshape(height, 32, -1).mean(axis=2)
    edges = np.arange(33) * height // 32
    first, last = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    sums = np.vstack([np.zeros(32), np.cumsum(columns, axis=0)])
    small = (sums[last] - sums[first]) / (last - first)[:, None]
    low = np.round(cosine_basis() @ small @ cosine_basis().T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def text_media(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``n_bytes`` and ``media``: each whole text as an image in a binary column."""
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raws = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array(encode_png([pad(r) for r in raws]), pa.binary())], schema.names)

    return docs.select(F.col(id_column), whole_text(text).cast("binary").alias("raw")).mapInArrow(run, schema)


def media_features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What the stored images hold: payload size and digest, checksum of the last 64 samples, size and digest of the image, frequency hash."""
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    schema = T.StructType([T.StructField(id_column, media.schema[id_column].dataType), *(T.StructField(k, T.LongType() if v == "long" else T.StringType()) for k, v in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            stored = batch.column(2).to_pylist()
            for data, image in zip(stored, decode_png(stored), strict=True):
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), frequency_hash(image)))
            found = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(v), pa.int64() if k == "long" else pa.string()) for v, k in zip(found, list(kinds.values())[1:], strict=True))], schema.names)

    return media.select(id_column, "n_bytes", "media").mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialise(text_media(read_documents(spark, sf_dir)), "media"))
