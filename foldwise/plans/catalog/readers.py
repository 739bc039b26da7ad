"""File readers on files that Spark has written, and operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.substitutions import feature_set
from foldwise.operators import paired
from foldwise.operators import variants as V
from foldwise.plans import bindings as B
from foldwise.plans.catalog.curves import _r
from foldwise.plans.catalog.views import LETTERS, RESULTS, sql
from foldwise.session import scratch_path
from foldwise.sources import text as T

SETS = ("combined", "embedding_only", "auxiliary_only", "seq_struct", "struct")


def fasta_file(spark, d):
    """Documents written as aligned records over several files and read back by record."""
    docs = B.table(spark, d, "documents").select("doc_id", B.letters("text").alias("seq")).filter(F.length("seq") > 0)
    path = scratch_path(spark, "fasta")
    docs.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.text(path)
    read = T.read_fasta(spark, path)
    return read.select("name", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


def key_list_source(spark, d):
    """A written list of names, blank lines among them, chooses customers."""
    people = B.table(spark, d, "customer")
    path = scratch_path(spark, "names")
    people.filter("c_nationkey < 10").select(
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("\n")))
        .otherwise(F.col("c_name"))).write.text(path)
    names = T.read_names(spark, path)
    return people.select(F.col("c_name").alias("dataset"), "c_custkey").join(names, "dataset", "left_semi")


def metric_file(spark, d):
    """A written table of correlations, bad cells among them, and its mean."""
    path = scratch_path(spark, "metric")
    cells = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise((F.col("l_discount") * 100).cast("int").cast("string"))
    B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), cells.alias("spearman")).write.option(
        "header", True).option("sep", "\t").csv(path)
    return T.read_metric_mean(spark, path).select(*_r("mean"), "n")


def length_gate(spark, d):
    """References (the letters of documents) long enough for position sampling."""
    refs = B.table(spark, d, "documents").select(F.col("doc_id").alias("dataset"), F.length(B.letters("text")).alias("seq_len"))
    return V.long_enough(refs, 60, 50)


def feature_sets(spark, d):
    """Every named feature set of every vector: its width and its sum by place."""
    x = B.table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("emb"),
        F.array(F.col("label").cast("double"), F.lit(1.0)).alias("aux"), F.array((F.col("vec_id") % 7).cast("double")).alias("struct"))
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("featset"), feature_set(s, F.col("emb"), F.col("aux"), F.col("struct")).alias("x")) for s in SETS]))
    total = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return x.select("vec_id", named.alias("_f")).select("vec_id", "_f.featset", "_f.x").select(
        "vec_id", "featset", F.size("x").alias("width"), F.round(total, 6).alias("placed"))


def readout_deltas(spark, d):
    """One readout against another on the same dataset, model and split."""
    res = B.results(spark, d).groupBy("dataset", "model", "split", F.when(F.col("layer") < 2, F.lit("ridge")).otherwise(F.lit("forest")).alias("readout")).agg(
        F.max("rho").alias("rho"))
    pairs = paired.paired_conditions(res, ["dataset", "model", "split"], "readout", "ridge", "forest")
    return paired.delta_summary(pairs, ["model", "split"]).select("model", "split", "n", *_r("mean", "sd", "se"))


QUERIES = {f.__name__: f for f in (fasta_file, key_list_source, metric_file, length_gate, feature_sets, readout_deltas)}

SQL = {
    "fasta_file": sql(f"t as (select doc_id, {LETTERS} seq from documents)", """
select 'd' || doc_id "name", length(seq) n, md5(seq) digest from t where length(seq) > 0"""),
    "key_list_source": "select c_name dataset, c_custkey from customer where c_nationkey < 10",
    "metric_file": """
select round(avg(cast(round(l_discount * 100) as int)) filter (l_linenumber <> 7), 9) mean, count(*) filter (l_linenumber <> 7) n from lineitem""",
    "length_gate": sql(f"t as (select doc_id dataset, cast(length({LETTERS}) as int) seq_len from documents)", "select * from t where seq_len >= 60 and seq_len - 3 >= 50"),
    "feature_sets": """
with e as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) emb, [cast(label as double), 1.0] aux, [cast(vec_id % 7 as double)] st from embeddings),
x as (select vec_id, 'combined' featset, emb || aux x from e union all select vec_id, 'embedding_only', emb from e union all
      select vec_id, 'auxiliary_only', aux from e union all select vec_id, 'seq_struct', emb || st || aux from e union all select vec_id, 'struct', st || aux from e)
select vec_id, featset, cast(len(x) as int) width, round(list_sum(list_transform(x, lambda v, i: v * i)), 6) placed from x""",
    "readout_deltas": sql(RESULTS, """
, m as (select dataset, model, split, max(rho) filter (layer < 2) a, max(rho) filter (layer >= 2) b from res group by 1, 2, 3),
p as (select *, a - b d from m where a is not null and b is not null)
select model, split, count(*) n, round(avg(d), 9) mean, round(stddev_samp(d), 9) sd, round(stddev_samp(d) / sqrt(count(*)), 9) se from p group by 1, 2"""),
}
