"""Score files as one long table, and the table written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.sequences import condition_parts
from foldwise.functions.substitutions import finite
from foldwise.operators.curves import best_layer, layer_curve
from foldwise.operators.keyed import overlay
from foldwise.session import materialise

_ENTRY = "map<string,struct<n_rows:int,n_variants:int,capped:boolean,result:map<string,string>>>"
_POOLED = "map<string,struct<n_rows:int,capped:boolean,arms:map<string,map<string,map<string,string>>>>>"
_READOUTS = "map<string,struct<spearman:string,n:int>>"
CONDITION = ["arm", "featset", "split"]


def parse_results(files: DataFrame) -> DataFrame:
    """(file, value) documents named by condition as (arm, featset, split, shard, dataset, layer, rho, n, ...).

    Three payloads occur: layers with a score each, one score, or the mean of
    draws; the last two have a NULL layer. Missing and non-finite scores are NULL.
    """
    parts = condition_parts(F.regexp_extract("file", r"([^/]+)$", 1))
    entries = files.select(
        *[c.alias(k) for k, c in parts.items()], F.explode(F.from_json("value", _ENTRY)).alias("dataset", "_e")
    ).select(*parts, "dataset", "_e.n_rows", "_e.n_variants", "_e.capped", F.col("_e.result").alias("_r"))
    single = F.coalesce(F.try_element_at("_r", F.lit("rho_mean")), F.try_element_at("_r", F.lit("spearman")))
    flat = F.map_contains_key("_r", "rho_mean") | F.map_contains_key("_r", "spearman")
    count = F.coalesce(F.try_element_at("_r", F.lit("n")), F.try_element_at("_r", F.lit("n_draws")))
    none = F.struct(F.lit(None).cast("int").alias("layer"), finite(single).alias("rho"), count.try_cast("int").alias("n"))
    layers = F.transform(
        F.map_entries("_r"),
        lambda e: F.struct(
            e["key"].try_cast("int").alias("layer"),
            finite(F.get_json_object(e["value"], "$.spearman")).alias("rho"),
            F.get_json_object(e["value"], "$.n").try_cast("int").alias("n"),
        ),
    )
    rows = F.explode(F.when(flat, F.array(none)).otherwise(layers))
    return entries.withColumn("_l", rows).select(
        *parts, "dataset", "n_rows", "n_variants", "capped", "_l.layer", "_l.rho", "_l.n"
    )


def parse_pooling(files: DataFrame) -> DataFrame:
    """(file, value) pooling documents as (dataset, arm, split, strategy, featset, readout, rho, n)."""
    entries = files.select(F.explode(F.from_json("value", _POOLED)).alias("dataset", "_e"))
    arms = entries.select("dataset", F.explode("_e.arms").alias("arm", "_a"))
    splits = arms.select("dataset", "arm", F.explode("_a").alias("split", "_s"))
    cells = splits.select("dataset", "arm", "split", F.explode("_s").alias("_name", "_json"))
    inner = F.coalesce(F.get_json_object("_json", "$.rho"), F.col("_json"))
    name = F.split("_name", "__")
    return cells.select(
        "dataset", "arm", "split", F.get(name, F.lit(0)).alias("strategy"), F.get(name, F.lit(1)).alias("featset"),
        F.explode(F.from_json(inner, _READOUTS)).alias("readout", "_v"),
    ).select("dataset", "arm", "split", "strategy", "featset", "readout", finite(F.col("_v.spearman")).alias("rho"), "_v.n")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents with their file names; one document describes one condition."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_results(read_documents(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version per key; of equal versions the row that is greatest in its other columns."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_v"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def upsert_results(new: DataFrame, path: str, keys: list[str], partitions: list[str], version: str | None = None) -> None:
    """Replace the given keys in a partitioned table, touching only the partitions they lie in.

    With ``version`` a row only gives way to a higher version, so the order in which batches come doesn't matter. Folders
    follow conditions, not datasets, so their number stays small. Running the same batch twice leaves the same table.
    """
    spark = new.sparkSession
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        old = old.join(new.select(*partitions).distinct(), partitions, "left_semi").select(*new.columns)
        merged = newest(old.unionByName(new), keys, version) if version else overlay(old, [new], keys)
    else:
        merged = newest(new, keys, version) if version else overlay(new, [], keys)
    # written aside first: the partitions being read are the ones being replaced
    materialise(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partitions
    ).parquet(path)


def report_cells(results: DataFrame, by: list[str], final_layer: int) -> DataFrame:
    """``mean (Lbest→final) n=`` per condition, the mean being that of the best layer."""
    curve = layer_curve(results, by)
    best = best_layer(curve, by)
    final = curve.filter(F.col("layer") == final_layer).select(*by, F.col("rho").alias("_f"))
    n = results.filter(F.col("rho").isNotNull()).select(*by, "dataset").distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n")
    )
    text = F.concat(_signed(F.col("best_rho")), F.lit(" (L"), F.col("best").cast("string"), F.lit("→"),
                    F.coalesce(_signed(F.col("_f")), F.lit("—")), F.lit(") n="), F.col("_n").cast("string"))
    return best.join(final, by, "left").join(n, by).select(*by, text.alias("cell"))


def _signed(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%+.3f", x))


def markdown(cells: DataFrame, rows: list[str], column: str, levels: list[str]) -> DataFrame:
    """Cells as the lines of a Markdown table, ready for ``write.text``."""
    wide = cells.groupBy(*rows).pivot(column, levels).agg(F.max("cell"))
    body = [F.coalesce(F.col(f"`{c}`"), F.lit("—")) for c in levels]
    return wide.orderBy(*rows).select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *rows, *body), F.lit(" |")).alias("value")
    )
