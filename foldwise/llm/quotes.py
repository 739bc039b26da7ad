"""Quotation linking: quoted lines find the messages they come from, and conversations lose their quotes.

A line's quote level is the number of ``>`` that it starts with. The rest, in lower case with single spaces, is a
passage. A quoted passage comes from the first message of the conversation that says it unquoted, if that message
is earlier; nested levels are looked up alike. A message answers the latest message that its outermost quotes come
from. ``reply_path`` lists the turns from the first message down to this one, so that ordering by it puts answers
right below what they answer, earlier ones first.

Messages without a conversation or turn are kept and never linked. Null and empty texts quote nothing. Passages
without letters or digits don't link. Repeated rows (one conversation and turn) answer the same message, and a passage
said twice belongs to the earlier turn. An empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.session import written

QUOTE = r"^[ \t]*(>[ \t]*)+"
INTRODUCTION = r"(?i)^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)\s*:\s*$"
NEW = ("body", "n_quoted", "n_linked", "max_level", "parent_turn", "reply_path", "depth")


def lines(text: Column) -> Column:
    """Array of (level, said): the lines of a text without their quote marks."""
    def read(line: Column) -> Column:
        mark = F.regexp_extract(line, QUOTE, 0)
        return F.struct((F.length(mark) - F.length(F.translate(mark, ">", ""))).alias("level"),
                        F.when(mark == "", line).otherwise(F.expr("''")).alias("own"), F.regexp_replace(line, QUOTE, "").alias("said"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), read)


def normal(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(said), r"\s+", " "))


def _body(read: Column) -> Column:
    """Unquoted lines, without lines that only introduce a quote."""
    return F.trim(F.array_join(F.transform(
        F.filter(read, lambda x, i: (x["level"] == 0) & ~((F.try_element_at(read, i + 2)["level"] > 0) & x["said"].rlike(INTRODUCTION)).eqNullSafe(F.lit(True))),
        lambda x: x["said"]), "\n"), F.lit("\n"))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (64-bit hash): the distinct lines of each message that can link."""
    spoken = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", F.explode(lines(F.col("text"))).alias("_line"))
    said = spoken.select("conv_id", "turn", F.col("_line.level").alias("level"), normal(F.col("_line.said")).alias("_said"))
    return said.filter(F.col("_said").rlike(r"[\p{L}\p{N}]")).select(
        "conv_id", "turn", "level", F.xxhash64("_said", F.length("_said")).alias("passage"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, original: every quoted passage and the turn it comes from (null: not found)."""
    found = passages(messages)
    first = found.filter(F.col("level") == 0).groupBy("conv_id", "passage").agg(F.min("turn").alias("_first"))
    quoted = found.filter(F.col("level") > 0).distinct()
    return quoted.join(first, ["conv_id", "passage"], "left").select(
        "conv_id", "turn", "level", "passage", F.when(F.col("_first") < F.col("turn"), F.col("_first")).alias("original"))


def _step(turn: Column) -> Column:
    """Twenty digits that sort as the turn does, negative ones included."""
    return F.lpad((turn.cast("decimal(20,0)") + F.lit(Decimal(2**63))).cast("string"), 20, "0")


def reply_paths(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, reply_path, depth from conv_id, turn, parent_turn (one row a message).

    Each round doubles the stretch of ancestors that a message knows, so rounds grow with the logarithm of the depth.
    """
    state = written(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("_up"),
                                   _step(F.col("turn")).alias("reply_path"), F.lit(0).alias("depth")), "replies")
    while not state.filter(F.col("_up").isNotNull()).isEmpty():
        above = state.select(F.col("conv_id"), F.col("turn").alias("_up"), F.col("_up").alias("_next"),
                             F.col("reply_path").alias("_path"), F.col("depth").alias("_depth"))
        state = written(state.join(above, ["conv_id", "_up"], "left").select(
            "conv_id", "turn", "parent_turn", F.col("_next").alias("_up"),
            F.concat_ws("/", "_path", "reply_path").alias("reply_path"),
            (F.col("depth") + F.when(F.col("_up").isNull(), 0).otherwise(F.col("_depth") + 1)).cast("int").alias("depth")), "replies")
    return state.drop("_up")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``messages`` without text, with body (the text without quotes), n_quoted, n_linked, max_level, parent_turn, reply_path and depth."""
    keep = [c for c in messages.columns if c not in {*NEW, "text"}]
    quoted = written(links(messages.select("conv_id", "turn", "text")), "links")
    counts = quoted.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quoted"), F.count("original").alias("n_linked"), F.max("level").alias("max_level"),
        F.max(F.when(F.col("level") == 1, F.col("original"))).alias("_outer"), F.max("original").alias("_any"))
    keys = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    answers = counts.select("conv_id", "turn", "n_quoted", "n_linked", "max_level", F.coalesce("_outer", "_any").alias("parent_turn"))
    paths = reply_paths(keys.join(answers.select("conv_id", "turn", "parent_turn"), ["conv_id", "turn"], "left"))
    facts = paths.join(answers.drop("parent_turn"), ["conv_id", "turn"], "left")
    facts = facts.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), *[c for c in NEW if c in facts.columns])
    body = messages.select(*keep, _body(lines(F.col("text"))).alias("body"))
    joined = body.join(facts, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("n_quoted", "n_linked", "max_level", "depth")}
    return joined.select(*keep, "body", *[zero.get(c, F.col(c)).alias(c) for c in NEW[1:]])
