"""Quality rules judged by host: failures pooled per source, shrunk, and joined back.

A document fails by itself when it has under ten words or when over a fifth of them lie in repeated
five-word windows. Failures are then counted per host (the ``source`` column). The hosts' rates have a
common beta prior, fitted by moments to all hosts. A host is rejected with all its documents when its posterior
rate, less two of its standard deviations, exceeds the hosts' bound: one standard deviation of the prior
above its mean, but never below ``least_rate`` nor above ``max_rate``. So hosts that fail alike all stay, unless they
fail beyond ``max_rate``, and a host with few documents isn't rejected on them alone.

Null and empty texts have no words and fail. Documents without a source are one host of their own.
Repeated rows count as often as they occur. An empty table gives an empty table. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.text import SPACES, WORD, bind, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEAST_HOST_RATE = 0.2
MAX_HOST_RATE = 0.5
DOUBT = 2.0  # posterior standard deviations
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repeated_words(ws: Column) -> Column:
    """How many words lie in windows of five words that the text has twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: s[a]["h"] == s[b]["h"]
            twice = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k - 1, k)).otherwise(F.lit(False))
                             | F.when(k < last, same(k, k + 1)).otherwise(F.lit(False)))
            return F.sort_array(F.transform(twice, lambda k: s[k]["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(bind(ordered, places), start, step, lambda a: a["n"])

    def count(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashed) - WINDOW),
                              lambda i: F.xxhash64(*[hashed[i + k] for k in range(WINDOW)]))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < WINDOW + 1, 0).otherwise(bind(hashes, count))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counts = bind(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    out = docs.drop(*MEASURES).withColumn("_counts", counts).withColumns({
        "n_words": F.col("_counts.n").cast("bigint"),
        "word_chars": without(SPACES).cast("bigint"),
        "n_symbols": (F.length(text) - without(SYMBOLS)).cast("bigint"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": F.col("_counts.r").cast("bigint"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_counts")


def host_rates(measured: DataFrame, least_rate: float = LEAST_HOST_RATE, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """source, n_docs, n_failed, the failure rate shrunk by the hosts' common beta prior, the hosts' bound and the verdict.

    The prior's mean is the mean rate of hosts and its strength follows from their variance beyond
    that of binomial counts. With one host, or no variance beyond it, the prior is as strong as all
    documents, so every host has the common rate.
    """
    hosts = measured.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("inverse"),
        F.sum("n_docs").cast("double").alias("total"),
    )
    m, binomial = F.col("m"), F.col("m") * (1 - F.col("m")) * F.col("inverse")
    beyond = F.col("v") - binomial
    strength = F.when((beyond > 0) & (m > 0) & (m < 1), F.least(F.greatest(m * (1 - m) / beyond - 1, F.lit(0.5)), F.col("total")))
    prior = prior.select(m.alias("_m"), F.coalesce(strength, F.col("total")).alias("_strength"))
    spread = F.sqrt(F.col("_m") * (1 - F.col("_m")) / (F.col("_strength") + 1))
    bound = F.least(F.lit(max_rate), F.greatest(F.lit(least_rate), F.col("_m") + spread))
    weight = F.col("_strength") + F.col("n_docs")
    rates = hosts.crossJoin(F.broadcast(prior)).select(  # the prior is one row
        "source", "n_docs", "n_failed", ((F.col("_m") * F.col("_strength") + F.col("n_failed")) / weight).alias("host_rate"),
        bound.alias("host_bound"), weight.alias("_weight"))
    doubt = DOUBT * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("_weight") + 1))
    return rates.withColumn("host_rejected", F.col("host_rate") - doubt > F.col("host_bound")).drop("_weight")


def judge(measured: DataFrame, hosts: DataFrame) -> DataFrame:
    """``measured`` with host_rate, host_bound and kept. Joins one row per host; a hot host is split by adaptive execution."""
    rates = hosts.select(F.col("source").alias("_host"), "host_rate", "host_bound", F.col("host_rejected").alias("_rejected"))
    joined = measured.drop("host_rate", "host_bound", "kept", "_rejected").join(rates, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("_rejected"), F.lit(False))).drop("_rejected")
