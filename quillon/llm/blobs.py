"""Arrays packed into one binary value for each target partition.

Millions of small rows cost the JVM far more than a few large values with the same content:
a map task deals its rows out to numbered bins and sends one packed value a bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SCHEMA = "bin int, kind int, blob binary"


def bounded(source: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes or of one row, whatever the size of Spark's: arrays made for a
    batch are several times as large as its texts."""
    for b in source:
        parts = [b]
        while parts:
            b = parts.pop()
            if b.num_rows <= 1 or b.nbytes <= most:
                yield b
            else:
                half = b.num_rows // 2
                parts += [b.slice(half), b.slice(0, half)]


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of each array, compressed: small numbers leave their high planes empty."""
    planes = [np.int64(len(arrays[0])).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        plane = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += size
    return out


def dealt(kind: int, bins: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bin, kind, blob) for each bin that has rows; rows keep their order within a bin."""
    if not len(bins):
        return
    order = np.argsort(bins, kind="stable")
    bins = bins[order]
    cuts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    arrays = [a[order] for a in arrays]
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bins)], strict=True):
        yield int(bins[low]), kind, pack(*[a[low:high] for a in arrays])


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, v = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.binary())], ["bin", "kind", "blob"])


def batches(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def by_bin(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Input sorted by bin, as one bin after another: its blobs by kind."""
    now, held = None, {}
    for b in source:
        for at, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if at != now:
                if held:
                    yield now, held
                now, held = at, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def joined(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The arrays of many blobs, one after another."""
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]
