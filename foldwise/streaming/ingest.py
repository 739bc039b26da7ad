"""Results that arrive as files, folded into the score table as they come.

Versions decide, not arrival. A stream keeps the newest row of every key as its state and passes on a key only when its row has
changed; the sink appends these changes, one folder a batch, so that nothing that was written is written again and a batch repeated
after a failure replaces its own folder. The table is the newest change of each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldwise.sources.results import exists, newest, upsert_results

SALTS = 16


def _arriving(spark: SparkSession, source: str, schema: T.StructType, files_per_trigger: int | None) -> DataFrame:
    stream = spark.readStream.schema(schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(source)


def _append(changes: DataFrame, target: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Every batch in a folder of its own, until nothing is left to read."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_changes(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keys: list[str],
                   version: str = "version", files_per_trigger: int | None = None) -> StreamingQuery:
    """Read every new file once and append the rows that are newer than what their key had; stops when nothing is left.

    The state is one row per key. Of equal versions the row greatest in its other columns stays, so any order of arrival gives the same
    table. A row's batch time rides along in the state: a key whose newest row came in an earlier batch is not passed on.
    """
    rest = [f.name for f in schema.fields if f.name not in (*keys, version)]
    now = F.unix_micros(F.current_timestamp())  # one value for a whole batch
    held = _arriving(spark, source, schema, files_per_trigger).withColumn("_before", -now).groupBy(*keys).agg(
        F.max(F.struct(version, *rest, "_before")).alias("_v"))
    changed = held.filter(-F.col("_v._before") == now)
    return _append(changed.select(*[F.col(f.name) if f.name in keys else F.col(f"_v.{f.name}").alias(f.name) for f in schema.fields]), target, checkpoint)


def current_results(spark: SparkSession, target: str, schema: T.StructType, keys: list[str], version: str = "version") -> DataFrame:
    """The table that the changes make up."""
    if not exists(spark, target):
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(f"{target}/batch=*"), keys, version)


def ingest_results(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
                   keys: list[str], partitions: list[str], version: str = "version",
                   files_per_trigger: int | None = None) -> StreamingQuery:
    """The same into a partitioned table that readers take as it is; each batch rewrites the partitions it touches."""
    def put(batch: DataFrame, _: int) -> None:
        upsert_results(batch, target, keys, partitions, version)

    return (
        _arriving(spark, source, schema, files_per_trigger).writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def completed_keys(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
                   by: list[str]) -> StreamingQuery:
    """Append every (condition, dataset) pair once, for counting how complete a condition is."""
    pairs = spark.readStream.schema(schema).parquet(source).select(*by, "dataset").dropDuplicates([*by, "dataset"])
    return (
        pairs.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def monitor_completeness(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, by: list[str], need: int,
                         salts: int = SALTS, files_per_trigger: int | None = None) -> StreamingQuery:
    """Follow how many datasets a condition has until it has ``need``, with state that ends there.

    A condition's datasets are dealt into ``salts`` parts by hash, so that no task sees all of a large one. A part's state is the datasets seen,
    at most ``need``; a part that has as many makes its condition complete by itself, forgets them and keeps the count alone. Counts that grew are appended.
    """
    salt = F.pmod(F.xxhash64("dataset"), F.lit(salts)).cast("int").alias("_part")
    rows = _arriving(spark, source, schema, files_per_trigger).filter(F.col("dataset").isNotNull()).select(*by, salt, F.col("dataset").cast("string").alias("dataset"))
    fields = [rows.schema[c] for c in (*by, "_part")]
    out = T.StructType([*fields, T.StructField("n", T.LongType())])
    state = T.StructType([T.StructField("n", T.LongType()), T.StructField("seen", T.ArrayType(T.StringType()))])

    def follow(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, seen = held.get if held.exists else (0, [])
        if n >= need:
            return
        names = set(seen)
        for frame in frames:
            if len(names) < need:
                names.update(frame["dataset"].unique())
        grown = min(len(names), need)
        if grown > n:
            held.update((grown, [] if grown >= need else sorted(names)))
            yield pd.DataFrame([(*key, grown)], columns=out.names)

    counted = rows.groupBy(*by, "_part").applyInPandasWithState(follow, out, state, "update", GroupStateTimeout.NoTimeout)
    return _append(counted, target, checkpoint)


def completeness_so_far(spark: SparkSession, target: str, by: list[str], need: int) -> DataFrame:
    """by, n_datasets (counted up to ``need``), complete."""
    parts = spark.read.parquet(f"{target}/batch=*").groupBy(*by, "_part").agg(F.max("n").alias("_n"))
    total = parts.groupBy(*by).agg(F.least(F.sum("_n"), F.lit(need)).alias("n_datasets"))
    return total.withColumn("complete", F.col("n_datasets") >= need)
