"""Merging, restricting and checking keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.plans.ordering import sorted_index


def overlay(base: DataFrame, patches: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of later patches replace those of earlier ones and of the base.

    Uses an aggregate, so many copies of one key meet as partial results.
    """
    stacked = base.withColumn("_p", F.lit(0))
    for i, patch in enumerate(patches, 1):
        stacked = stacked.unionByName(patch.withColumn("_p", F.lit(i)))
    values = [c for c in base.columns if c not in keys]
    newest = stacked.groupBy(*keys).agg(F.max_by(F.struct(*values), "_p").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def overlap(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a patch would replace."""
    return base.select(*keys).distinct().join(patch.select(*keys).distinct(), keys, "left_semi")


def merge_nested(old: Column, new: Column) -> Column:
    """Two-level maps joined: new entries are added under old ones, new values win."""
    def inner(_, a, b):
        both = F.map_zip_with(a, b, lambda _k, x, y: F.coalesce(y, x))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)

    return F.map_zip_with(old, new, inner)


def not_done(candidates: DataFrame, results: DataFrame, conditions: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that miss at least one of the wanted conditions."""
    wanted = conditions.select(*by).distinct()
    have = results.select("dataset", *by).distinct().join(wanted, by, "left_semi").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_have")
    )
    need = wanted.agg(F.count(F.lit(1)).alias("_need"))
    done = have.join(F.broadcast(need)).filter(F.col("_have") >= F.col("_need")).select("dataset")
    return candidates.join(done, "dataset", "left_anti")


def done_keys(*tables: DataFrame, key: str = "dataset") -> DataFrame:
    """Union of the keys of several tables."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def shared_keys(a: DataFrame, b: DataFrame, key: str = "dataset") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def restrict(df: DataFrame, keys: DataFrame, on: str = "dataset") -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: str = "dataset") -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def key_status(names: DataFrame, current: DataFrame, renamed: DataFrame, removed: DataFrame) -> DataFrame:
    """same / renamed / removed for every name, with the new name; ``n_classes`` must be 1."""
    def flag(df, name):
        return df.select("dataset").distinct().withColumn(name, F.lit(1))

    joined = (
        names.join(flag(current, "_same"), "dataset", "left")
        .join(renamed.select("dataset", "new_name"), "dataset", "left")
        .join(flag(removed, "_gone"), "dataset", "left")
    )
    same, moved, gone = F.col("_same").isNotNull(), F.col("new_name").isNotNull(), F.col("_gone").isNotNull()
    status = F.when(same, "same").when(moved, "renamed").when(gone, "removed")
    hits = same.cast("int") + moved.cast("int") + gone.cast("int")
    return joined.withColumn("status", status).withColumn("n_classes", hits).drop("_same", "_gone")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that only one side has."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    equal = F.lit(True)
    for v in values:
        equal = equal & F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    return left.join(right, keys, "full").filter(~equal)


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """Named checks, each a one-row frame with a boolean ``ok``, as one table."""
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.coalesce("ok", F.lit(False)).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def check_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def first_datasets(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` dataset names in order."""
    names = df.select("dataset").distinct().orderBy("dataset").limit(n)
    return df.join(names, "dataset", "left_semi")


def shard(df: DataFrame, shard_no: int, n_shards: int) -> DataFrame:
    """Rows of every ``n_shards``-th dataset name in order."""
    placed = sorted_index(df.select("dataset").distinct(), ["dataset"], "_i")
    mine = placed.filter(F.col("_i") % n_shards == shard_no).select("dataset")
    return df.join(mine, "dataset", "left_semi")


def completeness(results: DataFrame, by: list[str], target: int) -> DataFrame:
    """Distinct datasets per condition and whether the target is reached."""
    return results.select(*by, "dataset").distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_datasets")
    ).withColumn("complete", F.col("n_datasets") >= target)
