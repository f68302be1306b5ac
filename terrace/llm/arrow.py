"""Views of Arrow string columns as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and n + 1 offsets into them. Nulls count as empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def parts(b: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in a column have ``size`` bytes or so; a longer value makes a slice of its own."""
    if not b.num_rows:
        return
    turn = utf8(b.column(column))[1][:-1] // size
    edges = [0, *(1 + np.flatnonzero(turn[1:] != turn[:-1])).tolist(), b.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield b.slice(lo, hi - lo)


def byte_values(col: pa.Array) -> list[bytes]:
    """Values as bytes; nulls as empty."""
    data, offs = utf8(col)
    raw, o = data.tobytes(), offs.tolist()
    return [raw[a:b] for a, b in zip(o, o[1:])]


def strings(col: pa.Array) -> list[str]:
    """Values as str; nulls as empty."""
    return [x or "" for x in col.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
