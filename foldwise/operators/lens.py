"""Scores from per-layer token logits.

Logits come packed, the vocabulary of a spot (dataset, pos, layer) as one array; the normaliser and the letters are
array functions of it, so neither tokens nor letters become rows, and rows meet their spots in one join. Logits with a row
for each token are summed by ``letter_log_probs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.alphabet import AMINO_ACIDS
from foldwise.operators.correlation import spearman
from foldwise.operators.curves import summary
from foldwise.plans.keyjoin import beside

SPOT = ["dataset", "pos", "layer"]


def letter_log_probs(logits: DataFrame, direct: bool = False) -> DataFrame:
    """Marginal log-probability of each letter: log-sum-exp over its tokens.

    ``logits`` has one row per (dataset, pos, layer, token_id) with the letter the
    token stands for (NULL for special tokens, which still count in the
    normaliser). ``direct`` uses only the lowest token of a letter. The windows
    span one spot of one layer, i.e. the vocabulary.
    """
    spot = Window.partitionBy(*SPOT)
    raised = logits.withColumn("_top", F.max("logit").over(spot)).withColumn(
        "_e", F.exp(F.col("logit") - F.col("_top"))
    )
    part = F.min_by("_e", "token_id") if direct else F.sum("_e")
    letters = raised.groupBy(*SPOT, "letter").agg(part.alias("_s"), F.sum("_e").alias("_t"))
    letters = letters.withColumn("_all", F.sum("_t").over(spot)).filter(F.col("letter").isNotNull())
    return letters.select(*SPOT, "letter", (F.log("_s") - F.log("_all")).alias("logp"))


def letter_arrays(packed: DataFrame, vocabulary: Sequence[str | None], direct: bool = False) -> DataFrame:
    """``packed`` (SPOT, logits) with ``logp``: the log-probability of every letter in the order of the alphabet, NULL where no token stands for it.

    ``vocabulary`` gives the letter of each token, None for special ones, which count in the normaliser. ``direct`` uses
    only the lowest token of a letter.
    """
    tokens = [[t for t, x in enumerate(vocabulary) if x == letter] for letter in AMINO_ACIDS]
    if direct:
        tokens = [t[:1] for t in tokens]
    groups = F.array(*[F.array(*[F.lit(t) for t in ts]) if ts else F.array().cast("array<int>") for ts in tokens])
    add = lambda a, v: a + v
    raised = packed.withColumn("_e", F.transform("logits", lambda v: F.exp(v - F.array_max("logits")))).withColumn(
        "_all", F.log(F.aggregate("_e", F.lit(0.0), add)))
    each = F.transform(groups, lambda ts: F.when(F.size(ts) > 0, F.log(F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.get("_e", t))) - F.col("_all")))
    return raised.filter(F.array_max("logits").isNotNull()).withColumn("logp", each).drop("_e", "_all", "logits")


def _letter(logp: str, letter: Column) -> Column:
    return F.get(logp, F.instr(F.lit(AMINO_ACIDS), letter) - 1)


def packed_log_ratio(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """log p(to) - log p(from) of every row at every layer of ``letter_arrays``; unknown letters are skipped. Spots counted to be few are broadcast."""
    known = lambda x: F.when(F.length(x) == 1, x)
    small = beside(spots.select(*SPOT))
    score = _letter("logp", known(F.col("to_aa"))) - _letter("logp", known(F.col("from_aa")))
    return rows.join(small(spots), ["dataset", "pos"]).withColumn("score", score).filter(F.col("score").isNotNull()).drop("logp")


def packed_lens_scores(rows: DataFrame, packed: DataFrame, vocabulary: Sequence[str | None], direct: bool = False, **sizes) -> DataFrame:
    """Zero-shot rank correlation per dataset and layer."""
    scored = packed_log_ratio(rows, letter_arrays(packed, vocabulary, direct))
    return spearman(scored, ["dataset", "layer"], "score", "fitness", **sizes)


def log_ratio(rows: DataFrame, log_probs: DataFrame) -> DataFrame:
    """log p(to) - log p(from) of every row at every layer; unknown letters are skipped.

    The letters of a spot are packed in one map, so rows are joined once.
    """
    spots = log_probs.groupBy(*SPOT).agg(
        F.map_from_entries(F.collect_list(F.struct("letter", "logp"))).alias("_m")
    )
    scored = rows.join(spots, ["dataset", "pos"]).withColumn(
        "score", F.try_element_at("_m", F.col("to_aa")) - F.try_element_at("_m", F.col("from_aa"))
    )
    return scored.filter(F.col("score").isNotNull()).drop("_m")


def lens_scores(rows: DataFrame, logits: DataFrame, direct: bool = False, **sizes) -> DataFrame:
    """Zero-shot rank correlation per dataset and layer."""
    scored = log_ratio(rows, letter_log_probs(logits, direct))
    return spearman(scored, ["dataset", "layer"], "score", "fitness", **sizes)


def lens_summary(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """Mean, sd (ddof 0) and n per layer over the datasets that pass the numeric gate."""
    passed = gate.filter("gate_pass").select("dataset")
    return summary(scores.join(passed, "dataset", "left_semi"), ["layer"], "rho", 0)
