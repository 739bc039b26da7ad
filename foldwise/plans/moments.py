"""Sums of outer products per group, the one pass behind the linear models.

For z = (1, v) the matrix sum(z z') holds the row count, the sums and all second
moments. Each task adds its rows up with one matrix product per group and batch;
the partial matrices travel in blocks of rows and are added by a JVM aggregate
that combines on the map side, so no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 64
BUDGET_BYTES = 256 << 20


def group_positions(batch: pa.RecordBatch, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Row numbers of every key combination in a batch; NULL is a key."""
    if not keys:
        return {(): np.arange(batch.num_rows)}
    coded = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
    values = [c.dictionary.to_pylist() for c in coded]
    frame = pd.DataFrame({k: c.indices.to_numpy(zero_copy_only=False) for k, c in zip(keys, coded, strict=True)})
    found = frame.groupby(list(keys), sort=False).indices
    codes = {(k if isinstance(k, tuple) else (k,)): v for k, v in found.items()}
    return {tuple(v[i] for v, i in zip(values, k, strict=True)): rows for k, rows in codes.items()}


def as_matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The chosen rows of a list column of equal lengths as a matrix."""
    taken = column.take(pa.array(rows))
    flat = taken.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1).astype(np.float64, copy=False)


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def gram(df: DataFrame, keys: Sequence[str], vec: str, folds: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Gram matrix of (1, vec) per group: keys, ``block``, ``part`` (row block, row-major).

    ``folds`` names fold columns. Each gives its own set of matrices, one per
    fold, told apart by ``split`` (the column's name) and ``fold``; the rows
    themselves go to Python once. A row counts ``weight`` times.
    """
    keys, folds = list(keys), list(folds)
    fold_fields = [T.StructField("split", T.StringType()), T.StructField("fold", T.IntegerType())] if folds else []
    schema = T.StructType([*key_fields(df, keys), *fold_fields, T.StructField("block", T.IntegerType()),
                           T.StructField("part", T.ArrayType(T.DoubleType(), False))])
    group_by = [*keys, "split", "fold"] if folds else keys

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: dict[str, pa.DataType] = {}

        def flush():
            for key, g in held.items():
                blocks = [g[i:i + BLOCK_ROWS].ravel() for i in range(0, len(g), BLOCK_ROWS)]
                arrays = [pa.array([v] * len(blocks), type=types[k]) for k, v in zip(group_by, key, strict=True)]
                arrays.append(pa.array(range(len(blocks)), type=pa.int32()))
                arrays.append(pa.array(blocks, type=pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(arrays, [*group_by, "block", "part"])
            held.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = {k: batch.schema.field(k).type for k in keys} | {"split": pa.string(), "fold": pa.int32()}
            marks = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in folds}
            for key, rows in group_positions(batch, keys).items():
                x = as_matrix(batch.column(vec), rows)
                z = np.hstack([np.ones((len(x), 1)), x])
                if weight:
                    z *= np.sqrt(batch.column(weight).to_numpy(zero_copy_only=False)[rows])[:, None]
                if folds:
                    cells = [((*key, f, int(v)), z[m]) for f in folds
                             for v in np.unique(marks[f][rows]) for m in [marks[f][rows] == v]]
                else:
                    cells = [(key, z)]
                for cell, part in cells:
                    g = part.T @ part
                    held[cell] = held[cell] + g if cell in held else g
            if sum(g.nbytes for g in held.values()) > BUDGET_BYTES:
                yield from flush()
        yield from flush()

    parts = df.select(*keys, *folds, vec, *([weight] if weight else [])).mapInArrow(partial, schema)
    return parts.groupBy(*group_by, "block").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("part")))).alias("part")
    )


def assemble(blocks: pd.DataFrame) -> np.ndarray:
    """The full matrix of one group from its blocks."""
    rows = [np.asarray(p, dtype=np.float64) for p in blocks.sort_values("block")["part"]]
    total = sum(len(r) for r in rows)
    width = int(round(total**0.5))
    return np.concatenate(rows).reshape(width, width)
