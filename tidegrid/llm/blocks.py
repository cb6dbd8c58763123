"""Asking the whole corpus about hashed keys without a row for every occurrence.

Every task packs its rows, in their order, into blocks of a few megabytes of text,
compressed: whatever ids or sources repeat, blocks are alike, and a retried task
packs the same ones.  A block lists its distinct keys once, sorted and cut into
buckets by their leading bits (a key of any frequency is one entry of a block, so no
bucket grows with a hot key).  A bucket merges the lists of all blocks and replies
to each block in the order of its list.  Blocks and replies meet in a cogroup, where
texts are unpacked again and replies are looked up by binary search.  The exchange
of packed texts is the same in every pass and Spark reuses it.

Lists hold differences of neighbours, by byte planes, so that the bytes that a
sorted list has in common cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 8 << 20

PACKED = "block long, packed binary"
ASKED = "kind int, bucket int, block long, n int, keys binary, given binary"
REPLIED = "kind int, bucket int, block long, reply binary"


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def buckets_for(total: int) -> int:
    """A power of two: about four megabytes of text to a bucket."""
    return 1 << max(3, (max(1, total >> 22) - 1).bit_length())


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(block, packed): the rows (doc_id, text, ...) of each block as one compressed value. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = made = 0
        for b in batches:
            at = 0
            sizes = np.cumsum([0, *(x or 0 for x in pa.compute.binary_length(b.column(1)).to_pylist())])
            while at < b.num_rows:
                upto = min(b.num_rows, max(at + 1, int(np.searchsorted(sizes, sizes[at] + BLOCK_BYTES - size, "right"))))
                held.append(b.slice(at, upto - at))
                size += int(sizes[upto] - sizes[at])
                at = upto
                if size >= BLOCK_BYTES:
                    yield _block(first + made, held)
                    held, size, made = [], 0, made + 1
        if held:
            yield _block(first + made, held)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    return df.select(*cols, *[v.alias(k) for k, v in (extra or {}).items()]).mapInArrow(run, PACKED)


def _block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(held).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.record_batch([pa.array([number], pa.int64()), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], names=["block", "packed"])


def unpacked(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of the blocks of a group."""
    for number, raw in zip(table["block"].to_pylist(), table["packed"], strict=True):
        data = zstandard.decompress(raw.as_buffer())
        yield number, pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()


def _planes(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _from_planes(raw: bytes, n: int, dtype: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, n).T).view(dtype)[:, 0] if n else np.zeros(0, dtype)


def _shift(buckets: int) -> np.uint64:
    return np.uint64(64 - (buckets.bit_length() - 1))


def asked(kind: int, block: int, keys: np.ndarray, given: np.ndarray | None, buckets: int) -> pa.Table:
    """The rows of one block's sorted distinct keys, with a value for each."""
    cut = np.searchsorted(keys >> _shift(buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
    rows: list[tuple[int, int, bytes, bytes | None]] = []
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if b > a:
            rows.append((i, b - a, _planes(np.diff(keys[a:b], prepend=np.uint64(0))), None if given is None else _planes(given[a:b])))
    n = len(rows)
    cols = [[kind] * n, [r[0] for r in rows], [block] * n, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ASKED.split(", ")])


def lists(table: pa.Table, given_type: str | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and values of each row."""
    sizes = table["n"].to_pylist()
    keys = [np.cumsum(_from_planes(x, n, "<u8"), dtype=np.uint64) for x, n in zip(table["keys"].to_pylist(), sizes, strict=True)]
    given = [] if given_type is None else [_from_planes(x, n, given_type) for x, n in zip(table["given"].to_pylist(), sizes, strict=True)]
    return keys, given


def merge(table: pa.Table, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], given_type: str | None) -> pa.Table:
    """All blocks' lists of one bucket: answer(group, given) gives a value for each distinct key.

    group numbers the distinct keys along the sorted entries, given are their values in that order.
    """
    keys, given = lists(table, given_type)
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    k = flat[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    group = np.cumsum(fresh) - 1
    value = answer(group, np.concatenate(given)[order] if given else None)
    reply = np.empty(len(flat), value.dtype)
    reply[order] = value[group]
    ends = np.cumsum([len(x) for x in keys])
    out = [reply[b - len(x) : b] for x, b in zip(keys, ends.tolist(), strict=True)]
    wire = [zstandard.compress(np.packbits(x).tobytes(), 1) if x.dtype == bool else _planes(x) for x in out]
    return pa.table([table["kind"], table["bucket"], table["block"], pa.array(wire, pa.binary())], names=["kind", "bucket", "block", "reply"])


def replies_of(table: pa.Table, kind: int, keys: np.ndarray, buckets: int, dtype: str) -> np.ndarray:
    """The replies to a block's sorted keys, in their order; dtype "bit" for packed bits."""
    cut = np.searchsorted(keys >> _shift(buckets), np.arange(buckets + 1, dtype=np.uint64))
    out = np.zeros(len(keys), bool if dtype == "bit" else dtype)
    for k, bucket, reply in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["reply"].to_pylist(), strict=True):
        if k == kind:
            a, b = int(cut[bucket]), int(cut[bucket + 1])
            if dtype == "bit":
                out[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(reply), np.uint8), count=b - a)
            else:
                out[a:b] = _from_planes(reply, b - a, dtype)
    return out
