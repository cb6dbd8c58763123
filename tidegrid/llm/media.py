"""Media columns: PNG images in binary columns and cosine-transform hashes (operator 5).

``encode`` stores bytes as 8-bit grey samples of a 64-sample-wide PNG, each line less
the one above (filter up); ``decode`` walks the chunks, tests every checksum, inflates, undoes the line filters in
numpy and derives a perceptual hash: the picture is averaged to 32 x 32, its
lowest 8 x 8 cosine coefficients are compared with their median.

Cases: null payloads count as empty ones, and an empty payload is one row of
zeros; equal payloads give equal images and hashes; damaged images raise
``ValueError``; row order and other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH = 64
#: The line filter that encode writes: up, which decode undoes.
FILTER = 2
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of the width."""
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(samples: np.ndarray, kind: int = 0, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a (rows, columns) array; kind: the line filter, 0 none, 1 sub or 2 up."""
    rows, cols = samples.shape
    lines = np.zeros((rows, cols + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = samples
    if kind == 1:
        lines[:, 2:] -= samples[:, :-1]
    elif kind == 2:
        lines[1:, 1:] -= samples[:-1]
    head = struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a PNG chunk is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of PNG chunk {kind!r} differs")
        yield kind, body
        at += 12 + n


def _undo_predicted(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Lines of filters average (3) and Paeth (4): a sample needs those left, above and left above, so a diagonal is undone at once."""
    rows, cols = lines.shape
    known = np.zeros((rows + 1, cols + 1), np.int32)  # a line above and a column of zeros
    known[0, 1:] = above
    for d in range(rows + cols - 1):
        r = np.arange(max(0, d - cols + 1), min(rows, d + 1))
        c = d - r
        left, up, corner = known[r + 1, c], known[r, c + 1], known[r, c]
        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        known[r + 1, c + 1] = (lines[r, c] + np.where(kinds[r] == 3, (left + up) >> 1, paeth)) & 255
    return known[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the PNG line filters, of a run of lines at once: equal filters none, sub or up, or any of average and Paeth."""
    if not kinds.any():
        return lines
    out = lines.copy()
    cuts = np.flatnonzero(np.diff(np.minimum(kinds, 3))) + 1
    if kinds.max() > 4:
        raise ValueError(f"unknown PNG filter {kinds.max()}")
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
        kind = int(kinds[a])
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind:
            out[a:b] = _undo_predicted(kinds[a:b], lines[a:b], out[a - 1] if a else np.zeros(out.shape[1], np.uint8))
    return out


def png_decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without interlace."""
    head, idat, ended = None, [], False
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("a PNG of another kind, or cut off")
    cols, rows = head[:2]
    raw = zlib.decompress(b"".join(idat))
    if len(raw) != rows * (cols + 1):
        raise ValueError("PNG data of another size")
    lines = np.frombuffer(raw, np.uint8).reshape(rows, cols + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_COS = np.cos(np.pi / 32 * (np.arange(32) + 0.5)[None, :] * np.arange(8)[:, None])


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits, hexadecimal: low-frequency cosine coefficients above their median (the first is left out of it)."""
    rows, cols = samples.shape
    x = samples
    if rows >= 32:
        cut = np.arange(32) * rows // 32
        small = np.add.reduceat(x, cut, axis=0, dtype=np.int64) / np.diff(np.append(cut, rows))[:, None]
    else:
        small = x[np.arange(32) * rows // 32].astype(float)
    if cols >= 32:
        cut = np.arange(32) * cols // 32
        small = np.add.reduceat(small, cut, axis=1) / np.diff(np.append(cut, cols))
    else:
        small = small[:, np.arange(32) * cols // 32]
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a PNG. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sizes, made = [], []
                for x in part.column(1).cast(pa.binary()).to_pylist():
                    x = x or b""
                    sizes.append(len(x))
                    made.append(png_encode(np.frombuffer(padded(x), np.uint8).reshape(-1, WIDTH), FILTER))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=[id_col, "n_bytes", "media"])

    schema = T.StructType([df.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Adds rows, columns, payload (the samples) and feature (the hash) to stored images; nulls stay null. No shuffle."""
    names = ["height", "width", "payload", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(media_col)
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                got: list[tuple] = []
                for x in part.column(at).to_pylist():
                    if x is None:
                        got.append((None, None, None, None))
                        continue
                    s = png_decode(x)
                    got.append((s.shape[0], s.shape[1], s.tobytes(), cosine_hash(s)))
                new = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.string()))]
                yield pa.record_batch([*part.columns, *new], names=[*part.schema.names, *names])

    kept = df.drop(*names)
    extra = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.BinaryType(), T.StringType()), strict=True)]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *extra]))
