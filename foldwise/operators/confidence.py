"""Features from predicted-structure confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.plans.keyjoin import join_keys


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))


def _clamped(pos: Column, length: Column, offset: int = 0) -> Column:
    """0-based place of a 1-based position, moved by ``offset`` and held inside the array."""
    base = F.greatest(F.lit(0), F.least(pos - 1, length - 1))
    return F.greatest(F.lit(0), F.least(base + offset, length - 1))


def confidence_features(rows: DataFrame, confidence: DataFrame, pae: DataFrame, window: int = 2) -> DataFrame:
    """Twelve numbers per row (``struct``) for the default window.

    Local value, the values of the window (edges repeated), mean and largest
    error of the position's row, local minus global, population sd of the window,
    global mean and the interface score. Joined by key, so dropped rows cannot
    shift the features of others. They depend on a residue alone, so they are worked out once for each: the long arrays never
    travel with the rows.
    """
    length = F.size("plddt")
    errors = F.transform("pae_row", lambda x: x.cast("double"))
    spots = pae.select("dataset", F.col("i").alias("_i"), _mean(errors).alias("_mean"), F.array_max(errors).alias("_max")).join(confidence.select("dataset", "plddt", "iptm"), "dataset")
    near = F.array(*[F.get("plddt", _clamped(F.col("_i"), length, o)).cast("double") for o in range(-window, window + 1)])
    spots = spots.withColumn("_near", near).withColumn("_mid", _mean(F.col("_near"))).withColumn(
        "_all", _mean(F.transform("plddt", lambda x: x.cast("double")))
    )
    local = F.get("plddt", F.col("_i") - 1).cast("double")
    sd = F.sqrt(_mean(F.transform("_near", lambda x: (x - F.col("_mid")) * (x - F.col("_mid")))))
    vector = F.concat(
        F.array(local), F.col("_near"),
        F.array(F.col("_mean"), F.col("_max"), local - F.col("_all"), sd, F.col("_all"), F.col("iptm").cast("double")),
    )
    spots = spots.select("dataset", "_i", length.alias("_len"), vector.alias("struct"))
    # structures of one name may differ in length: each length once beside a row, every structure at the spot
    lengths = confidence.select("dataset", F.size("plddt").alias("_len")).distinct()
    placed = rows.join(lengths, "dataset").withColumn("_i", _clamped(F.col("pos"), F.col("_len")) + 1)
    return join_keys(placed, spots, ["dataset", "_i", "_len"]).drop("_i", "_len")


def error_statistics(rows: DataFrame, pae: DataFrame, radius: int | None = None) -> DataFrame:
    """Mean, largest and smallest error of each row's position, optionally near it only."""
    lengths = pae.groupBy("dataset").agg(F.max(F.size("pae_row")).alias("_len"))
    placed = rows.join(lengths, "dataset").withColumn("i", _clamped(F.col("pos"), F.col("_len")) + 1)
    band = F.col("pae_row")
    if radius is not None:
        start = F.greatest(F.lit(0), F.col("i") - 1 - radius)
        stop = F.least(F.size("pae_row"), F.col("i") + radius)
        band = F.slice("pae_row", start + 1, F.greatest(F.lit(0), stop - start))
    band = F.transform(band, lambda x: x.cast("double"))
    # of a residue alone: three numbers travel to the rows, not the errors
    spots = pae.select("dataset", "i", band.alias("_b")).select(
        "dataset", "i", _mean(F.col("_b")).alias("pae_mean"), F.array_max("_b").alias("pae_max"), F.array_min("_b").alias("pae_min"))
    return placed.join(spots, ["dataset", "i"]).drop("_len", "i")


def exposure(plddt: Column) -> Column:
    """Exposure proxy of every residue: low confidence reads as exposed."""
    return F.transform(
        plddt, lambda p: (100.0 - F.least(F.greatest(p.cast("double"), F.lit(40.0)), F.lit(100.0))) / 60.0
    )


def distance_proxy(pae_row: Column, beta: float = 0.5) -> Column:
    return F.transform(pae_row, lambda x: x.cast("double") * beta)


def neighbour_window(residues: DataFrame, half: int = 2) -> DataFrame:
    """The edge-clamped window for a long table (dataset, pos, value), by joins on the shifted position.

    Long sequences stay spread over tasks; no window over a whole dataset is used.
    """
    ends = residues.groupBy("dataset").agg(
        F.min("pos").alias("_first"), F.max("pos").alias("_last")
    )
    shifts = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    wanted = residues.select("dataset", "pos").join(ends, "dataset").withColumn("_o", shifts).select(
        "dataset", "pos", "_o",
        F.greatest(F.col("_first"), F.least(F.col("pos") + F.col("_o"), F.col("_last"))).alias("_at"),
    )
    source = residues.select("dataset", F.col("pos").alias("_at"), "value")
    ordered = F.sort_array(F.collect_list(F.struct("_o", "value")))
    return wanted.join(source, ["dataset", "_at"]).groupBy("dataset", "pos").agg(
        F.transform(ordered, lambda s: s["value"]).alias("near")
    )
