"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times. Documents of a source stand in
order of size; the running sum of expected copies starts at one random offset per source, and a document
is taken once for every whole number its span crosses. Neighbours in that order have like sizes, so
the words taken stay within about one document of the target.

Null and empty texts have size 0 and cross boundaries like any other, adding no words. A null source is a
source of its own and comes last. Repeated rows are documents of their own. Sources without words have
target 0. An empty table gives an empty table. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.text import word_count
from foldwise.session import written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 7
#: Documents of a source are ordered in blocks: sizes within 2^(1/8) of each other, in so many hashed shares.
SHARES = 64


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, the same in every engine with md5."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: water filling, one aggregate of the sources a round.

    ``sizes`` has source and size. Sources in code-point order take the weights in turn. A round gives all
    open sources the same level per weight; those above ``most`` times their size are closed at it, and what
    they leave is shared again, until none is above.
    """
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    listed = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1))
    listed = listed.withColumn("_cap", F.col("source_size") * float(most))
    level = None
    while True:
        closed = F.lit(False) if level is None else F.col("_cap") <= F.col("_w") * level
        found = listed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(closed, F.col("_cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(closed, 0.0).otherwise(F.col("_w"))).alias("w"), F.sum(closed.cast("int")).alias("n")).first()
        if not found["w"]:
            break
        new = max(0.0, share * found["all"] - found["capped"]) / found["w"]
        if level is not None and new <= level:
            break
        level = new
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.col("_w") * level)
    return listed.select("source", "source_size", target.alias("target"))


def copies(slim: DataFrame, goals: DataFrame, seed: int = SEED) -> DataFrame:
    """``slim`` (doc_id, source, size, any identity columns) with source_size, target and copies."""
    mark = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = slim.withColumns({
        "_mark": mark, "_class": F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int"),
    }).withColumn("_share", (F.conv(F.substring("_mark", 1, 4), 16, 10).cast("int") % SHARES))
    same = lambda a, b: a.eqNullSafe(b)
    block = ["source", "_class", "_share"]
    filled = slim.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_class", "_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(
        goals.withColumnRenamed("source", "_s"), same(F.col("source"), F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_share").alias("_h"), "_start", "source_size", "target")
    extra = [c for c in slim.columns if c not in {*block, "size", "_mark", "doc_id"}]
    inside = Window.partitionBy(*block).orderBy("size", "_mark", "doc_id", *extra)
    placed = slim.withColumn("_place", F.row_number().over(inside)).join(
        starts, same(F.col("source"), F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_share") == F.col("_h")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = lambda k: F.floor(k * rate + draw(F.lit(seed), F.col("source")))
    rank = F.col("_start") + F.col("_place")
    return placed.withColumn("copies", (at(rank) - at(rank - 1)).cast("bigint")).drop(
        "_mark", "_class", "_share", "_place", "_s", "_c", "_h", "_start")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Only ids, sizes and text hashes are ordered; the texts move once, to meet their copies. Rows alike in
    doc_id, source and text (by 64-bit hash) share their copies as evenly as whole numbers allow.
    """
    key = F.xxhash64("doc_id", "source", "text", F.length("text"))
    slim = written(docs.select("doc_id", "source", key.alias("_key"), word_count(F.col("text")).alias("size")), "sizes")
    taken = copies(slim, targets(slim, weights, share, most), seed).groupBy(F.col("_key").alias("_of")).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    both = docs.withColumn("_key", key).join(taken, F.col("_key") == F.col("_of"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))  # dealt by the join already
    mine = F.floor(F.col("_copies") / F.col("_rows")) + F.when(place <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return both.withColumn("_mine", mine.cast("int")).filter(F.col("_mine") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_mine")))).select(*[F.col(c) for c in docs.columns])
