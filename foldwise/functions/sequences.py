"""Text helpers for aligned sequences, structure tokens and condition names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.functions.alphabet import GAP


def gap_pad(tokens: Column, start: Column, length: Column) -> Column:
    """Tokens placed at a 0-based start, ``#`` before and after, up to ``length``."""
    return F.rpad(F.concat(F.repeat(F.lit(GAP), start), tokens), length, F.lit(GAP))


def strip_insertions(seq: Column) -> Column:
    """Drop insertions of an aligned sequence: keep capitals and gaps, '.' becomes '-'."""
    return F.translate(F.regexp_replace(seq, r"[^A-Z.\-]", ""), ".", "-")


def gap_count(tokens: Column) -> Column:
    return F.length(tokens) - F.length(F.replace(tokens, F.lit(GAP), F.lit("")))


def condition_parts(name: Column) -> dict[str, Column]:
    """arm, featset, split and shard of a ``v4__arm__featset__split[__shardK]`` name."""
    stem = F.regexp_replace(name, r"\.json$", "")
    base = F.regexp_replace(stem, r"__shard[0-9]+$", "")
    parts = F.split(base, "__")
    return {
        "arm": F.get(parts, F.lit(1)),
        "featset": F.get(parts, F.lit(2)),
        "split": F.get(parts, F.lit(3)),
        "shard": F.regexp_extract(stem, r"__shard([0-9]+)$", 1).try_cast("int"),
    }
