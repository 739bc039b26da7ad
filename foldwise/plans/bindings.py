"""The library's inputs built from the driver's tables.

An order is a variant, its line items are the substitutions, a priority class is
a dataset, and every vector of ``embeddings`` is a position of the reference
sequence. Nothing is sampled: each binding covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.alphabet import AMINO_ACIDS

LAYERS = 8
DIMS = 8
SPLIT_OF_EVENT = {
    "click": "random",
    "view": "modulo",
    "purchase": "contiguous",
    "signup": "position_groupkfold",
    "error": "legacy",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``embeddings``: answered from the parquet footers."""
    return table(spark, sf_dir, "embeddings").count()


def letter_at(pos):
    return F.substring(F.lit(AMINO_ACIDS), 1, 20).substr((pos * 7 % 20 + 1).cast("int"), F.lit(1))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, seq_len, wt. The length comes from the aggregate, so that no filter on the text can move below it, where it would be built per order."""
    n = vector_count(spark, sf_dir)
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"))
    lens = names.groupBy("dataset").agg(F.max(F.lit(n) - 5 * F.substring("dataset", 1, 1).cast("int")).alias("seq_len"))
    wt = F.array_join(F.transform(F.sequence(F.lit(1), F.col("seq_len")), letter_at), "")
    return lens.withColumn("wt", wt)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, variant_id, mut_info, fitness (text), seq; with dirty records."""
    n = vector_count(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_partkey") % n + 1).cast("int").alias("pos"),
        F.when((F.col("l_suppkey") % 20 == 7) & (F.col("l_tax") >= 0.07), F.lit("X"))
        .otherwise(F.lit(AMINO_ACIDS).substr((F.col("l_suppkey") % 20 + 1).cast("int"), F.lit(1)))
        .alias("to_aa"),
    )
    token = F.concat(letter_at(F.col("pos")), F.col("pos").cast("string"), F.col("to_aa"))
    lists = items.groupBy("l_orderkey").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("line_no", token.alias("tk")))), lambda x: x["tk"]),
            ":",
        ).alias("mut_info")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderpriority").alias("dataset"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 10 == 0), F.lit("nan"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("fitness"),
        F.when(F.col("o_custkey") % 50 == 1, F.lit("ACD")).alias("seq"),
    )
    return orders.join(lists, "l_orderkey").select(
        "dataset", F.col("l_orderkey").cast("string").alias("variant_id"), "mut_info", "fitness", "seq"
    )


def position_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, pos, layer, vec: every vector cut in layers, for every dataset it fits in."""
    vectors = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).cast("int").alias("pos"), "embedding"
    )
    places = references(spark, sf_dir).select(
        "dataset", F.explode(F.sequence(F.lit(1), F.col("seq_len"))).alias("pos")
    )
    return layered(places.join(vectors, "pos"), ["dataset", "pos"])


def layered(df: DataFrame, keys: list[str]) -> DataFrame:
    cut = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(LAYERS - 1)),
            lambda l: F.struct(
                l.alias("layer"),
                F.transform(F.slice("embedding", l * DIMS + 1, DIMS), lambda x: x.cast("double")).alias("vec"),
            ),
        )
    )
    return df.withColumn("_l", cut).select(*keys, "_l.layer", "_l.vec")


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset (= label), pos, layer, vec over the whole embeddings table."""
    src = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("dataset"), (F.col("vec_id") + 1).cast("int").alias("pos"), "embedding"
    )
    return layered(src, ["dataset", "pos"])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, model, split, layer, rho, n: a long table of scores."""
    split = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(s)) for e, s in SPLIT_OF_EVENT.items()])
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").cast("string").alias("dataset"),
            F.when(F.col("event_id") % 2 == 0, F.lit("base")).otherwise(F.lit("real")).alias("model"),
            split.alias("split"),
            (F.get_json_object("props", "$.k").cast("int") % 4).alias("layer"),
        )
        .agg(
            (F.sum(F.round(F.col("value") * 100).cast("bigint")) / (F.count(F.lit(1)) * 100000.0)).alias("rho"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def letters(text):
    """The residue letters of a text in capitals; foreign letters go first, see the note in the checks."""
    foreign = f"[^{AMINO_ACIDS}{AMINO_ACIDS.lower()}]"
    return F.upper(F.regexp_replace(text, foreign, ""))


def alignments(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """dataset, seq_no, part, seq: the letters of every document, wrapped to lines of ``width``."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("seq_no"), letters("text").alias("_t")
    )
    lines = F.when(F.col("_t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("_t", F.lit(f".{{1,{width}}}"), F.lit(0)))
    return docs.select("dataset", "seq_no", F.posexplode(lines).alias("part", "seq"))


def alignment_refs(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset")).distinct().withColumn(
        "seq_len", F.lit(width)
    )


def scores(rows: DataFrame) -> DataFrame:
    """A substitution-score table counted from the rows: from_aa, to_aa, score."""
    return rows.groupBy("from_aa", "to_aa").agg((F.count(F.lit(1)) % 9 - 4).cast("double").alias("score"))


#: The letter of each of the 32 tokens; the last two are special.
VOCABULARY = [AMINO_ACIDS[t % 20] if t < 30 else None for t in range(32)]


def packed_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, pos, layer, logits: every vector read as two layers of 32 tokens."""
    size = len(VOCABULARY)
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("pos"), "embedding")
    places = references(spark, sf_dir).select("dataset", F.explode(F.sequence(F.lit(1), F.col("seq_len"))).alias("pos"))
    layers = F.explode(F.array(*[
        F.struct(F.lit(l).alias("layer"), F.transform(F.slice("embedding", l * size + 1, size), lambda v: v.cast("double")).alias("logits")) for l in range(2)]))
    return places.join(vectors, "pos").select("dataset", "pos", layers.alias("_l")).select("dataset", "pos", "_l.layer", "_l.logits")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, pos, layer, token_id, letter, logit: every vector read as two layers of 32 tokens."""
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("pos"), "embedding")
    places = references(spark, sf_dir).select(
        "dataset", F.explode(F.sequence(F.lit(1), F.col("seq_len"))).alias("pos")
    )
    tokens = places.join(vectors, "pos").select("dataset", "pos", F.posexplode("embedding").alias("_i", "_v"))
    token = F.col("_i") % 32
    return tokens.select(
        "dataset", "pos", F.floor(F.col("_i") / 32).cast("int").alias("layer"), token.alias("token_id"),
        F.when(token < 30, F.lit(AMINO_ACIDS).substr(token % 20 + 1, F.lit(1))).alias("letter"),
        F.col("_v").cast("double").alias("logit"),
    )


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset (= vector id), plddt, iptm."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("dataset"),
        F.transform("embedding", lambda x: F.abs(x.cast("double")) * 300).alias("plddt"),
        (F.col("label") / 10.0).alias("iptm"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, i, pae_row: one error row per residue."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("dataset"), "embedding", F.explode(F.sequence(F.lit(1), F.size("embedding"))).alias("i")
    ).select(
        "dataset", "i",
        F.transform("embedding", lambda x, k: F.abs(x.cast("double")) * 30 + F.abs(F.col("i") - 1 - k) / 8.0).alias("pae_row"),
    )


def confidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset (= vector id), row_id, pos: line items as places on those structures, some beyond the end."""
    n = vector_count(spark, sf_dir)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % n).alias("dataset"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("row_id"),
        (F.col("l_suppkey") % 70 + 1).cast("int").alias("pos"),
    )
