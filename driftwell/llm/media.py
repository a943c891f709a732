"""Media columns: payloads as PNG images in binary columns, read back with every checksum tested.

A payload is laid out as an 8-bit grey image of 576 samples a row.  The writer picks a filter for each row
(none, left or up, whichever leaves the smaller residual), deflates the filtered rows and cuts the stream
into IDAT chunks.  The reader checks signature, chunk order, every CRC-32 and the Adler-32, undoes all five
PNG filters with numpy and takes a perceptual hash from the low frequencies of a two-dimensional cosine
transform.

Defined cases: null text is an empty text; an empty text is one row of 255; very long texts are one image each, of as
many rows as they need; equal texts give equal rows; repeated ids and null ids pass through; an empty table gives no
rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftwell.llm._util import frugal, table, texts

ROW = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
SIDE, LOW = 32, 8

# The first LOW rows of the orthogonal cosine transform of SIDE samples.
_DCT = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))


def pad(data: bytes, multiple: int = ROW) -> bytes:
    """``data`` with bytes 255 up to a positive multiple."""
    size = max(1, -(-len(data) // multiple)) * multiple
    return data + b"\xff" * (size - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = ROW, level: int = 1) -> bytes:
    """Lossless grey PNG of ``payload``, whose length is a positive multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    # Residuals count by their distance from zero as signed bytes.
    costs = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, left, up)])
    kind = costs.argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], left, up))
    stream = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", stream[i : i + IDAT_BYTES]) for i in range(0, len(stream), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered 8-bit grey scan lines (filter byte first)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    i = 0
    while i < len(out):
        kind, j = kinds[i], i + 1
        while j < len(out) and kinds[j] == kind:
            j += 1
        if kind == 1:
            np.cumsum(out[i:j], axis=1, dtype=np.uint8, out=out[i:j])
        elif kind == 2:
            if i:
                out[i] += out[i - 1]
            np.cumsum(out[i:j], axis=0, dtype=np.uint8, out=out[i:j])
        elif kind > 2:  # each sample needs its decoded left neighbour
            for y in range(i, j):
                above = out[y - 1].tolist() if y else [0] * out.shape[1]
                line, a, c = out[y].tolist(), 0, 0
                for x, b in enumerate(above):
                    a = (line[x] + ((a + b) // 2 if kind == 3 else _paeth(a, b, c))) & 255
                    line[x], c = a, b
                out[y] = line
        i = j
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG; a wrong checksum, order, method or size, and a file cut anywhere, raise ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut short")
        (size,) = struct.unpack_from(">I", media, at)
        if at + 12 + size > len(media):
            raise ValueError("cut short")
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if (kind == b"IHDR") != (shape is None):
            raise ValueError("chunk order")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("size of the header")
            width, height, depth, colour, squeeze, method, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, squeeze, method, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("only plain 8-bit grey images are read")
            shape = height, width
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or shape is None:
        raise ValueError("cut short")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError("zlib stream") from e
    if len(raw) != shape[0] * (shape[1] + 1):
        raise ValueError("size of the image")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest frequencies lie above their median, the mean aside.

    Coefficients are rounded first, so flat images do not hash their rounding noise.
    """

    def shrink(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < SIDE:
            return x[np.arange(SIDE) * n // SIDE]
        edge = np.arange(SIDE + 1) * n // SIDE
        return np.add.reduceat(x, edge[:-1], axis=0) / np.diff(edge)[:, None]

    # Columns first, by whole runs of samples where the width allows, as it does at 576.
    h, w = image.shape
    wide = image.reshape(h, SIDE, -1).mean(2) if w % SIDE == 0 else shrink(image.T.astype(float)).T
    low = np.round(_DCT @ shrink(wide) @ _DCT.T, 4).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def with_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as a PNG in a binary column."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [t.encode() for t in b.column(1).to_pylist()]
            for i in range(0, len(data), 1000):
                part = data[i : i + 1000]
                media = [encode_png(pad(d)) for d in part]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1000), pa.array([len(d) for d in part], pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode the ``media`` column of ``with_media`` and describe what was read back."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                image = decode_png(m)
                payload = image.tobytes()
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(m),
                        hashlib.sha256(m).hexdigest(),
                        cosine_hash(image),
                    )
                )
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents")))
