"""Cross-validation folds as a column; the data is never copied per fold."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.hashing import md5_int, seeded
from foldwise.plans.keyjoin import join_keys
from foldwise.plans.ordering import group_index

SCHEMES = ("random", "modulo", "contiguous", "position_groupkfold")


def random_fold(variant_id: Column, k: Column | int, seed: int = 42) -> Column:
    """A uniform fold per variant: rows of one variant stay together."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.pmod(md5_int(seeded(seed, variant_id)), k).cast("int")


def modulo_fold(pos: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.pmod(pos - 1, k).cast("int")


def contiguous_fold(pos: Column, seq_len: Column, k: Column | int) -> Column:
    """Equal segments of the sequence."""
    k = F.lit(k) if isinstance(k, int) else k
    segment = F.floor((pos - 1) * k / F.greatest(seq_len, F.lit(1)).cast("double"))
    return F.greatest(F.lit(0), F.least(segment, k - 1)).cast("int")


def position_groups(rows: DataFrame, n_folds: int = 5) -> DataFrame:
    """Size-balanced folds of whole positions: (dataset, pos, fold).

    Positions are taken from the largest to the smallest (ties: the higher
    position first) and put in the fold with the fewest rows so far. Only the
    position counts of a dataset are brought together, and those are bounded by
    the sequence length, not by the rows.
    """
    counts = rows.groupBy("dataset", "pos").agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType([rows.schema["dataset"], rows.schema["pos"], T.StructField("fold", T.IntegerType())])

    def put(key, table):
        table = table.sort_by([("n", "descending"), ("pos", "descending")])  # nulls last
        loads = [(0, f) for f in range(min(n_folds, table.num_rows))]
        folds = []
        for n in table.column("n").to_pylist():
            load, f = loads[0]
            heapq.heapreplace(loads, (load + n, f))
            folds.append(f)
        return pa.Table.from_arrays([table.column("dataset"), table.column("pos"), pa.array(folds, pa.int32())], schema.names)

    return counts.groupBy("dataset").applyInArrow(put, schema)


def assign_fold(rows: DataFrame, scheme: str, n_folds: int = 5, seed: int = 42,
                out: str = "fold", min_rows: int = 0) -> DataFrame:
    """Add the fold of one scheme.

    ``rows`` carries dataset, variant_id, pos and (for contiguous) seq_len.
    Datasets below ``n_folds`` rows get as many folds as rows. Callers whose row gate
    keeps only datasets of ``min_rows`` or more say so, and where that is ``n_folds``
    or more the rows are not counted.
    """
    k: Column = F.lit(n_folds)
    if n_folds > min_rows and scheme != "position_groupkfold":
        sizes = rows.groupBy("dataset").agg(F.least(F.lit(n_folds), F.count(F.lit(1))).alias("_k"))
        rows, k = join_keys(rows, sizes, ["dataset"]), F.col("_k")
    if scheme == "random":
        done = rows.withColumn(out, random_fold(F.col("variant_id"), k, seed))
    elif scheme == "modulo":
        done = rows.withColumn(out, modulo_fold(F.col("pos"), k))
    elif scheme == "contiguous":
        done = rows.withColumn(out, contiguous_fold(F.col("pos"), F.col("seq_len"), k))
    elif scheme == "position_groupkfold":
        groups = position_groups(rows, n_folds).withColumnRenamed("fold", out)
        done = rows.join(groups, ["dataset", "pos"])
    else:
        raise ValueError(f"unknown scheme: {scheme}; choose from {SCHEMES}")
    return done.drop("_k")


def with_schemes(rows: DataFrame, schemes=SCHEMES, n_folds: int = 5, seed: int = 42, min_rows: int = 0) -> DataFrame:
    """One row per scheme, columns ``split`` and ``fold``."""
    wide = rows
    for s in schemes:
        wide = assign_fold(wide, s, n_folds, seed, out=f"_fold_{s}", min_rows=min_rows)
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"_fold_{s}").alias("fold")) for s in schemes]))
    return wide.withColumn("_sf", pairs).select(*rows.columns, "_sf.split", "_sf.fold")


def shuffled_kfold(rows: DataFrame, n_folds: int = 5, large: int | None = None, large_folds: int = 3,
                   seed: int = 42, out: str = "fold", **sizes) -> DataFrame:
    """Plain K-fold: rows in hashed order, cut into equal runs.

    With ``large`` set, datasets of more rows than that use ``large_folds``.
    """
    hashed = rows.withColumn("_h", md5_int(seeded(seed, F.col("row_id")), 1, 12).cast("double"))
    placed = group_index(hashed, ["dataset"], "_h", ["row_id"], "_i", total="_n", **sizes)
    k = F.lit(n_folds) if large is None else F.when(F.col("_n") > large, large_folds).otherwise(n_folds)
    size, extra, i = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_i") - 1
    head = extra * (size + 1)
    fold = F.when(i < head, F.floor(i / (size + 1))).otherwise(
        extra + F.floor((i - head) / F.greatest(size, F.lit(1)))
    )
    return placed.withColumn(out, fold.cast("int")).drop("_h", "_i", "_n")


def usable_folds(rows: DataFrame, keys: list[str], fold: str = "fold") -> DataFrame:
    """Folds with a test and a training part; groups with fewer than two are left out."""
    counts = rows.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n_test"))
    totals = counts.groupBy(*keys).agg(F.sum("n_test").alias("_all"), F.count(F.lit(1)).alias("_folds"))
    return (
        counts.join(totals.filter(F.col("_folds") >= 2), keys)
        .withColumn("n_train", F.col("_all") - F.col("n_test"))
        .drop("_all", "_folds")
    )


def train_test(rows: DataFrame, n_folds: int = 5, fold: str = "fold") -> DataFrame:
    """One row per row and held-out fold with its role; only for inspection."""
    held = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    return rows.withColumn("held_out", held).withColumn(
        "role", F.when(F.col(fold) == F.col("held_out"), "test").otherwise("train")
    )
