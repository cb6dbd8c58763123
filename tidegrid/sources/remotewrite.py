"""Remote-write bodies: a snappy block around a protobuf message, one a row.

The message has time series (field 1), each with labels (1: name 1, value 2) and
samples (2: value 1 as a double, milliseconds 2).  Everything else is skipped, as
are series without labels or samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineprotocol import _ARROW, PARSED

#: Bytes a body may have once decompressed.
LARGEST = 512 << 20


def varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("cut off, or a number too long")
        x = b[at]
        value |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return value, at


def decompressed(body: bytes) -> bytes:
    n, _ = varint(body, 0)
    if n > LARGEST:
        raise ValueError("body too large")
    out = pa.Codec("snappy").decompress(body, n).to_pybytes()
    if len(out) != n:
        raise ValueError("body of another length")
    return out


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; fixed-width values as bytes."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind in (1, 2, 5):
            n, at = varint(b, at) if kind == 2 else ((8, at) if kind == 1 else (4, at))
            if at + n > len(b):
                raise ValueError("a field is cut off")
            value, at = b[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def series_of(message: bytes) -> Iterator[tuple[dict[str, str], list[tuple[int, float]]]]:
    for number, body in fields(message):
        if number != 1 or not isinstance(body, bytes):
            continue
        labels, samples = {}, []
        for n, x in fields(body):
            if n == 1 and isinstance(x, bytes):
                pair = dict(fields(x))
                if isinstance(pair.get(1), bytes) and isinstance(pair.get(2), bytes) and pair[2]:
                    labels[pair[1].decode()] = pair[2].decode()
            elif n == 2 and isinstance(x, bytes):
                s = dict(fields(x))
                samples.append((signed(s.get(2, 0)), struct.unpack("<d", s[1])[0] if 1 in s else 0.0))
        if labels and samples:
            yield labels, samples


def parse(bodies: DataFrame, column: str = "content") -> DataFrame:
    """(seq, labels, t, v, skipped, error) of binary bodies, such as spark.read.format("binaryFile") gives. No shuffle."""
    seq = F.col("seq").cast("long") if "seq" in bodies.columns else F.monotonically_increasing_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for labels, samples in series_of(decompressed(body or b"\0")):
                        rows += [(n, list(labels.items()), t, v, 0, None) for t, v in samples]
                except (ValueError, OSError, struct.error) as e:
                    rows = [(n, None, None, None, 0, f"bad body: {e}"[:200])]
                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return bodies.select(seq.alias("seq"), F.col(column)).mapInArrow(run, PARSED)


def _bytes(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _varint(x: int) -> bytes:
    out, x = b"", x & (1 << 64) - 1
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def body_of(series: list[tuple[dict[str, str], list[tuple[int, float]]]]) -> bytes:
    """A body for parse(): the client's side of the format."""
    message = b""
    for labels, samples in series:
        inner = b"".join(_bytes(1, _bytes(1, k.encode()) + _bytes(2, v.encode())) for k, v in labels.items())
        inner += b"".join(_bytes(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _varint(t)) for t, v in samples)
        message += _bytes(1, inner)
    return pa.Codec("snappy").compress(message).to_pybytes()
