"""What the vector operators share: usable rows, distinct vectors, and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a block; a block of 64 doubles a row is half a MB.
BLOCK = 1024


def usable(vector: str) -> Column:
    """Vectors with at least one component, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def packed(df: DataFrame, by: list[str], ids: list[str], vector: str) -> DataFrame:
    """One row for each block (columns `by`): `n`, `ids` and `data` as bytes of int64 and float64.

    A block holds a bounded number of rows, so a group is never larger than its block.
    """
    fields = [df.schema[c] for c in by]

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column(vector).combine_chunks()
        data = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        held = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ids])
        out = {c: table.column(c).slice(0, 1) for c in by}
        out |= {"n": pa.array([table.num_rows], pa.int32()),
                "ids": pa.array([held.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())}
        return pa.table(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n int, ids binary, data binary"
    return df.select(*by, *ids, vector).groupBy(*by).applyInArrow(pack, schema)


def unpacked(ids: bytes, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (one row for each id column) and vectors of a block."""
    return np.frombuffer(ids, np.int64).reshape(-1, n), np.frombuffer(data, np.float64).reshape(n, -1)


def bounded_sample(df: DataFrame, vector: str, key: str, size: int) -> np.ndarray:
    """At most `size` vectors of the most common dimension among them: those of least hash of the key."""
    rows = df.select(vector).orderBy(F.xxhash64(key), key).limit(size).collect()
    dims = [len(r[0]) for r in rows]
    if not dims:
        return np.empty((0, 0))
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    return np.array([r[0] for r in rows if len(r[0]) == dim], np.float64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a row may hold a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
