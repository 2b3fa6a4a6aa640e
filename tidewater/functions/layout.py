"""Space-filling-curve keys for sort-based layouts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interleave_bits(cols: Sequence[Column], bits: int = 32) -> Column:
    """Z-order key of integer columns as big-endian binary; the first column's bits come first, null counts as 0."""
    if not cols:
        return F.lit(b"")
    if bits not in (8, 16, 32, 64):
        raise ValueError("bits must be 8, 16, 32 or 64")
    xs = [F.coalesce(c, F.lit(0)).cast("long") for c in cols]
    n, out = len(cols), []
    for at in range(0, bits * n, 64):  # eight bytes at a time
        size = min(64, bits * n - at)
        terms = []
        for k in range(size):
            level, col = divmod(at + k, n)
            terms.append(F.shiftleft(F.shiftright(xs[col], bits - 1 - level).bitwiseAND(F.lit(1).cast("long")), size - 1 - k))
        while len(terms) > 1:
            terms = [x.bitwiseOR(y) for x, y in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2 :]
        out.append(F.unhex(F.lpad(F.hex(terms[0]), size // 4, "0")))
    return F.concat(*out)


def hilbert_index(cols: Sequence[Column], bits: int) -> Column:
    """Hilbert curve index (long) of non-negative integer columns of ``bits`` bits each; null counts as 0.

    Its steps feed on each other's results, which as nested expressions would be repeated or interpreted, so
    a vectorised UDF takes them, over whole Arrow batches.
    """
    n = len(cols)
    if not 0 < bits <= 32 or bits * n > 64 or not n:
        raise ValueError("bits must be 1 to 32 and at most 64 over all columns")

    @F.pandas_udf("long")
    def index(axes: pd.DataFrame) -> pd.Series:
        x = [axes.iloc[:, i].to_numpy(np.int64) for i in range(n)]
        for b in range(bits - 1, 0, -1):
            low = np.int64((1 << b) - 1)
            for i in range(n):
                hit = (x[i] >> b & 1).astype(bool)
                swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
                x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
                x[i] = x[0] if i == 0 else x[i] ^ swap
        for i in range(1, n):
            x[i] = x[i] ^ x[i - 1]
        flip = np.zeros(len(axes), np.int64)
        for b in range(bits - 1, 0, -1):
            flip ^= np.where(x[-1] >> b & 1, np.int64((1 << b) - 1), np.int64(0))
        out = np.zeros(len(axes), np.int64)
        for b in range(bits - 1, -1, -1):
            for v in x:
                out = out << 1 | (v ^ flip) >> b & 1
        return pd.Series(out)

    return index(F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(f"x{i}") for i, c in enumerate(cols))))


def cluster_by(df: DataFrame, key: Column, partitions: int) -> DataFrame:
    """Rows dealt and sorted by a layout key, ready to be written as files with narrow column ranges."""
    return df.withColumn("_key", key).repartitionByRange(partitions, "_key").sortWithinPartitions("_key").drop("_key")
