"""User functions: vectorised scalar ones, and aggregates whose partial results merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def vector(f: Callable[..., pd.Series], returns: str | T.DataType):
    """A column function of one that maps pandas series to a series; it runs on Arrow batches."""
    return F.pandas_udf(f, returns)


def merged(df: DataFrame, groups: Sequence[str], partial: Callable[[pd.DataFrame], dict], state: str, finish: dict[str, F.Column]) -> DataFrame:
    """A user aggregate: ``partial`` turns a group's rows of one batch into numbers, which are summed over all batches.

    ``state`` is the schema of those numbers and ``finish`` makes the result columns of their sums.  Sums are taken by
    Spark's own two-step aggregate, so no group is ever gathered.  Null groups count as a group.
    """
    names = [f.name for f in T.StructType.fromDDL(state).fields]

    schema = T.StructType([T.StructField(g, df.schema[g].dataType) for g in groups] + T.StructType.fromDDL(state).fields)

    def run(batches):
        arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
        for batch in batches:
            codes: dict[tuple, int] = {}
            of = np.array([codes.setdefault(k, len(codes)) for k in zip(*(batch.column(g).to_pylist() for g in groups))], int)
            frame = batch.to_pandas()
            found = [partial(frame.iloc[rows]) for rows in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])] if len(of) else []
            cols = [list(k) for k in zip(*codes)] or [[] for _ in groups]
            cols += [[got[n] for got in found] for n in names]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(cols, arrow)], schema=arrow)

    sums = df.mapInArrow(run, schema).groupBy(*groups).agg(*(F.sum(n).alias(n) for n in names))
    return sums.select(*groups, *(c.alias(n) for n, c in finish.items()))
