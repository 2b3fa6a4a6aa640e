"""Packed binary rows: columns to rows of bytes and back.

A row holds its fixed-width values at aligned offsets in column order, for text and binary the place and length of
their bytes (two unsigned 32-bit numbers), one validity bit a column, then the bytes themselves; it is padded to
eight bytes.  All is little-endian.  Null values are zero bytes.  Kernels are NumPy over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}
_VARIABLE = (T.StringType, T.BinaryType)
#: Bounds of ``pack_fixed``.
MOST_COLUMNS, MOST_BYTES = 99, 1024


class Layout(NamedTuple):
    offsets: list[int]
    widths: list[int]
    validity: int
    size: int


def layout(schema: T.StructType) -> Layout:
    """Offsets and widths of the columns, and where the validity bits and the variable part begin."""
    offsets, widths, at = [], [], 0
    for f in schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            width = 4 if f.dataType.precision <= 9 else 8 if f.dataType.precision <= 18 else 16
        elif isinstance(f.dataType, _VARIABLE):
            width = 8
        elif type(f.dataType) in _WIDTHS:
            width = _WIDTHS[type(f.dataType)]
        else:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} has no packed form")
        step = 4 if isinstance(f.dataType, _VARIABLE) else min(width, 8)
        at = -(-at // step) * step
        offsets.append(at)
        widths.append(width)
        at += width
    return Layout(offsets, widths, at, at + -(-len(offsets) // 8))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for sizes[0] numbers, then the same for the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and int64 offsets of a text or binary column, nulls being empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, bufs = len(column), column.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    return np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8), offs


def _pack(schema: T.StructType):
    plan = layout(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fixed = np.zeros((n, plan.size), np.uint8)
            valid = np.zeros((n, -(-len(plan.offsets) // 8) * 8), np.uint8)
            sizes, parts = np.full(n, plan.size, np.int64), []
            for i, f in enumerate(schema.fields):
                column, at, width = batch.column(i), plan.offsets[i], plan.widths[i]
                valid[:, i] = np.asarray(column.is_valid())
                if isinstance(f.dataType, _VARIABLE):
                    data, offs = _bytes_of(column)
                    parts.append((data, offs[:-1], np.diff(offs), sizes.copy()))
                    fixed[:, at : at + 8] = np.stack([sizes, parts[-1][2]], axis=1).astype("<u4").view(np.uint8).reshape(n, 8)
                    fixed[valid[:, i] == 0, at : at + 8] = 0
                    sizes += parts[-1][2]
                elif n:
                    if isinstance(f.dataType, T.BooleanType):
                        column = column.cast(pa.uint8())
                    step = 16 if isinstance(f.dataType, T.DecimalType) else width
                    raw = np.frombuffer(column.buffers()[1], np.uint8, n * step, column.offset * step).reshape(n, step)[:, :width]
                    fixed[:, at : at + width] = raw * valid[:, i, None]
            fixed[:, plan.validity :] = np.packbits(valid, axis=1, bitorder="little")[:, : plan.size - plan.validity]
            sizes = -(-sizes // 8) * 8
            ends = np.cumsum(sizes)
            starts, out = ends - sizes, np.zeros(int(sizes.sum()), np.uint8)
            out[_runs(starts, np.full(n, plan.size))] = fixed.reshape(-1)
            for data, source, lengths, place in parts:
                out[_runs(starts + place, lengths)] = data[_runs(source, lengths)]
            offs = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.record_batch([pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(out)])], ["row"])

    return run


def _unpack(schema: T.StructType):
    plan = layout(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            data, offs = _bytes_of(batch.column(0).fill_null(bytes(-(-plan.size // 8) * 8)))
            starts = offs[:-1]
            fixed = data[_runs(starts, np.full(n, plan.size))].reshape(n, plan.size)
            valid = np.unpackbits(fixed[:, plan.validity :], axis=1, bitorder="little").astype(bool)
            out = []
            for i, f in enumerate(schema.fields):
                kind, at, width = to_arrow_type(f.dataType), plan.offsets[i], plan.widths[i]
                bits = pa.py_buffer(np.packbits(valid[:, i], bitorder="little"))
                raw = np.ascontiguousarray(fixed[:, at : at + width])
                if isinstance(f.dataType, _VARIABLE):
                    place = raw.view("<u4").reshape(n, 2).astype(np.int64)
                    body = data[_runs(starts + place[:, 0], place[:, 1])]
                    where = np.concatenate([[0], np.cumsum(place[:, 1])]).astype(np.int32)
                    binary = pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string()
                    out.append(pa.Array.from_buffers(binary, n, [bits, pa.py_buffer(where), pa.py_buffer(body)]).cast(kind))
                    continue
                if isinstance(f.dataType, T.BooleanType):
                    out.append(pa.Array.from_buffers(pa.uint8(), n, [bits, pa.py_buffer(raw)]).cast(kind))
                    continue
                if isinstance(f.dataType, T.DecimalType) and width < 16:
                    low = raw.view(f"<i{width}").reshape(n).astype(np.int64)
                    raw = np.stack([low, low >> 63], axis=1)
                out.append(pa.Array.from_buffers(kind, n, [bits, pa.py_buffer(np.ascontiguousarray(raw))]))
            yield pa.record_batch(out, schema.names)

    return run


def pack(df: DataFrame) -> DataFrame:
    """One column ``row`` of packed rows; nested types fail.  An empty table gives an empty one."""
    layout(df.schema)
    return df.mapInArrow(_pack(df.schema), "row binary")


def pack_fixed(df: DataFrame) -> DataFrame:
    """``pack`` for fixed-width columns alone, of which there are fewer than 100 and whose row has at most 1 KB; else it fails."""
    if any(isinstance(f.dataType, _VARIABLE) for f in df.schema.fields):
        raise TypeError("only fixed-width columns")
    if len(df.columns) > MOST_COLUMNS or -(-layout(df.schema).size // 8) * 8 > MOST_BYTES:
        raise ValueError("too many columns or bytes a row")
    return pack(df)


def unpack(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The table of a column ``row`` of packed rows; a null row gives nulls in all columns."""
    layout(schema)
    return rows.select("row").mapInArrow(_unpack(schema), T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
