"""Variant tables from key-value records and from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.substitutions import finite, parse_substitutions
from foldwise.plans.keyjoin import beside

RECORD = "struct<mut_info:string,fitness:string,seq:string>"


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, key, value-as-JSON) records as variants and references.

    Numeric keys are variants; ``wild_type`` gives the reference. Values that are
    no JSON objects are left out.
    """
    parsed = records.filter(F.col("key").rlike("^[0-9]+$")).select(
        "dataset", F.col("key").alias("variant_id"), F.from_json("value", RECORD).alias("_v")
    )
    variants = parsed.filter(F.col("_v").isNotNull() & F.col("_v.mut_info").isNotNull()).select(
        "dataset", "variant_id", "_v.mut_info", "_v.fitness", "_v.seq"
    )
    as_text = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "struct<v:string>")["v"]
    refs = records.filter(F.col("key") == "wild_type").select("dataset", F.coalesce(as_text, "value").alias("wt")).filter(
        F.length("wt") > 0
    )
    return variants, refs.withColumn("seq_len", F.length("wt"))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of (dataset, key, value); value is the JSON text of the record."""
    return split_records(spark.read.schema("dataset string, key string, value string").json(path))


def csv_variants(lines: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Variants of (dataset, mutant, DMS_score, mutated_sequence) in file order.

    The length of the first non-empty sequence is the reference length of a
    dataset; of several lines for one mutant the last usable one stays.
    """
    place = F.struct(*order)
    good = lines.withColumn("fitness", finite(F.col("DMS_score"))).filter(F.col("fitness").isNotNull())
    filled = good.filter(F.length("mutated_sequence") > 0)
    refs = filled.groupBy("dataset").agg(F.min_by(F.length("mutated_sequence"), place).alias("seq_len"))
    subs = parse_substitutions(F.col("mutant"))
    small = beside(lines.select("dataset").distinct())
    fits = good.join(small(refs), "dataset", "left").withColumn("_s", subs).withColumn(
        "_in", F.filter("_s", lambda s: F.col("seq_len").isNull() | s["pos"].between(1, F.col("seq_len")))
    )
    odd = F.coalesce((F.length("mutated_sequence") > 0) & (F.length("mutated_sequence") != F.col("seq_len")), F.lit(False))
    kept = fits.filter((F.size("_in") > 0) & ~odd)
    last = kept.groupBy("dataset", "mutant").agg(
        F.max_by(F.struct("fitness", "mutated_sequence"), place).alias("_v")
    )
    variants = last.select(
        "dataset", F.col("mutant").alias("variant_id"), F.col("mutant").alias("mut_info"),
        F.col("_v.fitness").cast("string").alias("fitness"), F.nullif(F.col("_v.mutated_sequence"), F.lit("")).alias("seq"),
    )
    return variants, refs


def read_csv_variants(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of CSV files, one per dataset. A file's order is its block, then the order inside the block."""
    lines = spark.read.option("header", True).schema(
        "mutant string, DMS_score string, mutated_sequence string"
    ).csv(path).select(
        "*", F.regexp_replace("_metadata.file_name", r"\.csv$", "").alias("dataset"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
    )
    return csv_variants(lines, ["_block", "_line"])


def anchors(wide: DataFrame, keys: list[str], label: str = "DMS_score", suffix: str = "_predictions") -> DataFrame:
    """Wide predictions as rows: keys, label, method, pred."""
    found = [c for c in wide.columns if c.endswith(suffix)]
    doubles = wide.select(*keys, label, *[F.col(c).try_cast("double").alias(c) for c in found])
    long = doubles.unpivot([*keys, label], found, "method", "pred")
    return long.withColumn("method", F.regexp_replace("method", f"{suffix}$", ""))
