"""Blocks of documents, and the packed rows by which they exchange what they hold with parts of a larger table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from opsledger.llm.wordhash import mix

SCHEMA = "part long, block long, kind int, data binary"
NAMES = ["part", "block", "kind", "data"]


#: Text bytes of a block, at least, and bytes that a message from a block to a part holds, about, in a large exchange.
BLOCK_BYTES, MESSAGE_BYTES = 8 << 20, 4 << 10


def block_bytes(total: int) -> int:
    """Text bytes of a block: beyond 16 GiB of text the root of their number, so that messages don't shrink with it."""
    return max(BLOCK_BYTES, math.isqrt(total * MESSAGE_BYTES))


def spread(block: int) -> int:
    """A number of a block that is even over any number of parts, as the blocks' own numbers are not."""
    return int(mix(np.array([block], dtype=np.uint64))[0] >> np.uint64(33))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned or signed integers as byte planes, each compressed; ascending uint64 ones by differences.

    The lowest bytes of small values, whose higher bytes are 0, stand apart from the others, as they spread otherwise.
    A plane of zeros takes no bytes but its length.
    """
    codec, out = pa.Codec("zstd", compression_level=1), [np.int64(len(columns[0])).tobytes()]

    def add(plane: np.ndarray) -> None:
        data = codec.compress(plane.tobytes(), asbytes=True) if plane.any() else b""
        out.extend((np.int32(len(data)).tobytes(), data))

    for c in columns:
        if c.dtype == np.uint64 and len(c):
            c = np.concatenate([c[:1], c[1:] - c[:-1]])
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T
        large = planes[1:].any(axis=0)
        for plane in (*planes[:0:-1], planes[0][~large], planes[0][large]):
            add(plane)
    return b"".join(out)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns that packed() was given, by their types."""
    codec, n, at, out = pa.Codec("zstd"), int(np.frombuffer(data, np.int64, 1)[0]), 8, []

    def plane(size: int) -> np.ndarray:
        nonlocal at
        length = int(np.frombuffer(data, np.int32, 1, at)[0])
        body, at = data[at + 4 : at + 4 + length], at + 4 + length
        return np.frombuffer(codec.decompress(body, size, asbytes=True), np.uint8) if length else np.zeros(size, np.uint8)

    for kind in map(np.dtype, kinds):
        planes = np.zeros((n, kind.itemsize), dtype=np.uint8)
        for i in range(kind.itemsize - 1, 0, -1):
            planes[:, i] = plane(n)
        large = planes[:, 1:].any(axis=1)
        planes[~large, 0] = plane(n - int(large.sum()))
        planes[large, 0] = plane(int(large.sum()))
        c = planes.view(kind).reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if kind == np.uint64 else c)
    return out


def batch_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.record_batch([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=NAMES)


def blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list[list], list[bytes]]]:
    """(block number, columns but the last, texts) of blocks of about block_bytes; the last column is the text, binary.

    Numbers are unique over the tasks of a stage. A null text is an empty one.
    """
    from pyspark import TaskContext

    block, columns, texts, size = TaskContext.get().partitionId() << 24, None, [], 0
    for batch in batches:
        columns = columns or [[] for _ in batch.columns[:-1]]
        rest = [c.to_pylist() for c in batch.columns[:-1]]
        for i, text in enumerate(batch.columns[-1]):
            data = text.as_buffer()
            body = data.to_pybytes() if data is not None else b""
            if texts and size + len(body) > block_bytes:
                yield block, columns, texts
                pa.default_memory_pool().release_unused()
                block, columns, texts, size = block + 1, [[] for _ in rest], [], 0
            for to, c in zip(columns, rest):
                to.append(c[i])
            texts.append(body)
            size += len(body)
    if texts:
        yield block, columns, texts
