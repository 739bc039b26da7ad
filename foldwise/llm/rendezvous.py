"""Shards by rendezvous hashing.

Every shard has a number and a weight. A record's key and a shard's number give a hash, read as a number u in (0, 1); the record goes
to the shard of the largest weight / -ln(u). Nothing else decides, so a record's shard is known anywhere from its key alone, shards
fill in proportion to their weights, and a new shard takes records into itself and moves none between the others.

A shard's records stand in slots 0, 1, 2, ... in order of key (null first), checksum and size of the text. All records are sorted
by ranges of these, rows alike by where they are stored, so a range is of like size however hot a key is. A task
numbers each shard's records in its range; the counts' prefix sums over the ranges are the bases.

A null key is a key like any other: its records lie in one shard. Null texts have size 1 and checksum 0, as empty ones. Repeated rows
are records of their own. An empty table gives an empty table. Extra columns, also of the names used here, don't come out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import written

DIGITS = 13  # hex digits of a hash that a double holds exactly


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard's number decide, the same in every engine with md5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{shard}"))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Shards of weight 0 take nothing; of equal scores the lower number wins."""
    if not any(w > 0 for w in weights):
        raise ValueError("a shard with weight is needed")
    scores = [F.struct((F.lit(float(w)) / -F.log(unit(key, i))).alias("score"), F.lit(-i).alias("shard"))
              for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]).cast("int")


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, shard and others) with slot."""
    stored = written(rows.withColumn("_row", F.monotonically_increasing_id()), "records")
    ordered = stored.orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "_row").drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            sizes = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(sizes) - sizes - taken, sizes)
            taken += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
                                             [*batch.schema.names, "_part", "_local"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    placed = written(ordered.mapInArrow(run, f"{fields}, _part int, _local bigint"), "numbered")
    counts = placed.groupBy(F.col("shard").alias("_shard"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    both = placed.join(starts, (F.col("shard") == F.col("_shard")) & (F.col("_part") == F.col("_of")))
    return both.withColumn("slot", F.col("_start") + F.col("_local")).drop("_shard", "_of", "_part", "_local", "_start")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with the shards of ``grown``; null without them).

    Shards keep their numbers: ``grown`` has to begin with ``weights`` for few records to move.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("bigint")
    after = shard_of(key, grown) if grown else F.lit(None).cast("int")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.lit("key").alias("law"), shard_of(key, weights).alias("shard"), after.alias("grown_shard"))
    return numbered(rows, len(weights)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
