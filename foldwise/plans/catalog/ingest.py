"""Sources, sinks and incremental ingest, fed with text that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.alphabet import THREE_LETTER
from foldwise.operators import correlation
from foldwise.operators import variants as V
from foldwise.operators.keyed import completeness
from foldwise.plans import bindings as B
from foldwise.plans.catalog.curves import BY, FINAL, SPLITS, _r
from foldwise.plans.catalog.views import RESULTS, ROWS, sql
from foldwise.session import scratch_path
from foldwise.sources import results as R
from foldwise.sources import text as T
from foldwise.sources import variants as S
from foldwise.streaming import ingest as I

KEYS = ["dataset", "model", "split", "layer"]


def record_source(spark, d):
    """Variants and references written as key-value records and read back into rows."""
    variants = B.variants(spark, d).select(
        "dataset", F.col("variant_id").alias("key"), F.to_json(F.struct("mut_info", "fitness", "seq")).alias("value"))
    refs = B.references(spark, d).select("dataset", F.lit("wild_type").alias("key"), F.concat(F.lit('"'), "wt", F.lit('"')).alias("value"))
    noise = variants.select("dataset", F.concat(F.lit("x"), "key").alias("key"), "value")
    parsed, references = S.split_records(variants.unionByName(refs).unionByName(noise))
    return V.substitution_rows(parsed, references, None, None).groupBy("dataset", "seq_len").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("pos").alias("pos_sum"))


def csv_source(spark, d):
    """Line items as CSV lines: repeated mutants keep the last, the first sequence sets the length."""
    items = B.table(spark, d, "lineitem")
    pos = (F.col("l_partkey") % 120 + 1).cast("string")
    lines = items.select(
        F.col("l_returnflag").alias("dataset"), F.concat(F.lit("A"), pos, F.lit("C")).alias("mutant"),
        F.when(F.col("l_discount") == 0.05, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("DMS_score"),
        F.when(F.col("l_tax") < 0.02, "").when(F.col("l_tax") < 0.04, F.repeat(F.lit("M"), F.lit(90)))
        .otherwise(F.repeat(F.lit("M"), F.lit(100))).alias("mutated_sequence"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax", "l_partkey")
    variants, refs = S.csv_variants(lines, ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax", "l_partkey"])
    return variants.join(refs, "dataset").select(
        "dataset", "seq_len", "variant_id", F.round(F.col("fitness").cast("double"), 2).alias("fitness"), F.length("seq").alias("width"))


def _documents(res):
    """Nested JSON documents named by condition, one per dataset, layers as keys."""
    node = F.to_json(F.struct(F.col("rho").alias("spearman"), F.col("n")))
    layers = res.groupBy("model", "split", "dataset").agg(
        F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("layer", node.alias("j")))),
                                      lambda s: F.concat(F.lit('"'), s["layer"].cast("string"), F.lit('": '), s["j"]))).alias("j"))
    return layers.select(
        F.concat(F.lit("/in/v4__"), "model", F.lit("__combined__"), "split", F.lit(".json")).alias("file"),
        F.concat(F.lit('{"'), "dataset", F.lit('": {"n_rows": 10, "n_variants": 9, "capped": false, "result": {'), "j", F.lit("}}}")).alias("value"))


def nested_results(spark, d):
    return R.parse_results(_documents(B.results(spark, d))).select(
        "arm", "featset", "split", "dataset", "layer", "n", "n_rows", "capped", *_r("rho"))


def flat_results(spark, d):
    """The single-score payload, with undefined scores."""
    means = B.results(spark, d).groupBy(*BY, "dataset").agg(F.max("rho").alias("rho"), F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("n") == 1, "NaN").otherwise(F.format_string("%.9f", "rho"))
    entry = F.concat(F.lit('{"'), "dataset", F.lit('": {"n_rows": 5, "capped": true, "result": {"spearman": '), score,
                     F.lit(', "n": '), F.col("n").cast("string"), F.lit(', "alphas": [1.0, 10.0]}}}'))
    files = means.withColumn("value", entry).select(F.concat(F.lit("v4__"), "model", F.lit("__auxiliary_only__"), "split", F.lit("__shard2.json")).alias("file"), "value")
    return R.parse_results(files).select("arm", "featset", "split", "shard", "dataset", "layer", "n", *_r("rho"))


def pooling_flatten(spark, d):
    """Pooling documents, one per dataset; layer 3 plays the strategy whose scores sit one level deeper."""
    res = B.results(spark, d)
    node = F.concat(F.lit('{"ridge": {"spearman": '), F.format_string("%.9f", "rho"), F.lit(', "n": '), F.col("n").cast("string"), F.lit("}}"))
    deep = F.concat(F.lit('{"rho": '), node, F.lit(', "layer_weights_per_fold": [[0.5, 0.5]]}'))
    cell = F.concat(F.lit('"s'), F.col("layer").cast("string"), F.lit('__combined": '), F.when(F.col("layer") == 3, deep).otherwise(node))
    splits = res.groupBy("dataset", "model", "split").agg(F.concat_ws(", ", F.collect_list(cell)).alias("j"))
    arms = splits.groupBy("dataset", "model").agg(
        F.concat_ws(", ", F.collect_list(F.concat(F.lit('"'), "split", F.lit('": {'), "j", F.lit("}")))).alias("j"))
    docs = arms.groupBy("dataset").agg(
        F.concat_ws(", ", F.collect_list(F.concat(F.lit('"'), "model", F.lit('": {'), "j", F.lit("}")))).alias("j"))
    files = docs.select(F.lit("pooling.json").alias("file"), F.concat(
        F.lit('{"'), "dataset", F.lit('": {"n_rows": 1, "capped": false, "arms": {'), "j", F.lit("}}}")).alias("value"))
    return R.parse_pooling(files).select("dataset", "arm", "split", "strategy", "featset", "readout", "n", *_r("rho"))


def fasta_source(spark, d):
    """Documents as records: a header, then the text; line breaks and insertions go."""
    docs = B.table(spark, d, "documents").select(
        F.lit("all.a2m").alias("file"), F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("value"))
    return T.parse_fasta(docs).select("name", F.length("seq").alias("width"), F.md5("seq").alias("digest"))


def structure_tokens(spark, d):
    refs = B.references(spark, d)
    line = F.lower("wt")
    own = refs.filter(F.col("dataset") < "4").select(
        F.concat(F.lit("/t/"), "dataset", F.lit(".3di.txt")).alias("file"),
        F.concat(F.lit(">h\n#\n"), line, F.lit("\n"), F.reverse(line), F.lit("\nshort\n")).alias("value"))
    folder = refs.filter(F.col("dataset") >= "3").select(
        F.concat(F.lit("/t/"), "dataset", F.lit("/query.3di")).alias("file"), F.concat(line, F.lit("\n")).alias("value"))
    return T.parse_structure_tokens(own.unionByName(folder), refs).select("dataset", F.md5("tokens").alias("digest"))


def ca_residues(spark, d):
    """Orders as structure files, line items as fixed-width atom records."""
    names = list(THREE_LETTER)
    kind = F.get(F.array(*[F.lit(n) for n in [*names, "UNK"]]), (F.col("l_suppkey") % 21).cast("int"))
    atom = F.when(F.col("l_returnflag") == "N", F.lit(" CA ")).otherwise(F.lit(" CB "))
    alt = F.when(F.col("l_tax") > 0.06, F.lit("B")).otherwise(F.lit(" "))
    record = F.concat(F.lit("ATOM  "), F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit(" "), atom, alt, kind, F.lit(" A"))
    files = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", record.alias("r")))), lambda s: s["r"]), "\n").alias("value"))
    return T.parse_ca_residues(files)


def anchor_unpivot(spark, d):
    """Two prediction columns scored per dataset, then averaged per method."""
    wide = B.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_extendedprice").alias("DMS_score"),
        F.col("l_quantity").cast("string").alias("a_predictions"),
        F.when(F.col("l_tax") > 0.07, "bad").otherwise(F.col("l_discount").cast("string")).alias("b_predictions"))
    scores = correlation.spearman(S.anchors(wide, ["dataset"]), ["dataset", "method"], "DMS_score", "pred")
    return scores.groupBy("method").agg(F.round(F.avg("rho"), 9).alias("mean"), F.count("rho").alias("n"))


def metric_mean(spark, d):
    table = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_tax") > 0.07, "-").otherwise(F.col("l_discount").cast("string")).alias("Spearman_rho"),
        F.col("l_tax").alias("rho_2"))
    return T.metric_mean(table).select(*_r("mean"), "n")


def report_cells(spark, d):
    return R.report_cells(B.results(spark, d), BY, FINAL)


def report_lines(spark, d):
    return R.markdown(R.report_cells(B.results(spark, d), BY, FINAL), ["model"], "split", SPLITS)


def _arriving_files(spark, d):
    """Results as files that arrive newest first: those with n >= 3, then n >= 2, then all, each older and lower than the one before."""
    res = B.results(spark, d).withColumn("n", F.col("n").cast("long"))
    path = scratch_path(spark, "arriving")
    for v in (2, 1, 0):
        res.filter(F.col("n") > v).select(*KEYS, (F.col("rho") + v).alias("rho"), "n", F.lit(v).alias("version")).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def incremental_results(spark, d):
    """Whatever the order of arrival, every key has its highest version."""
    source, schema = _arriving_files(spark, d)
    target = scratch_path(spark, "scores")
    I.ingest_changes(spark, source, schema, target, scratch_path(spark, "progress"), KEYS, files_per_trigger=4).awaitTermination()
    return I.current_results(spark, target, schema, KEYS).select(*KEYS, "n", "version", *_r("rho"))


def streaming_monitor(spark, d):
    """Conditions followed until they have fifty datasets."""
    source, schema = _arriving_files(spark, d)
    target = scratch_path(spark, "counts")
    I.monitor_completeness(spark, source, schema, target, scratch_path(spark, "progress"), BY, 50, files_per_trigger=4).awaitTermination()
    return I.completeness_so_far(spark, target, BY, 50)


def streaming_completeness(spark, d):
    source, schema = _arriving_files(spark, d)
    target = scratch_path(spark, "pairs")
    query = I.completed_keys(spark, source, schema, target, scratch_path(spark, "progress"), BY)
    query.awaitTermination()
    return completeness(spark.read.parquet(target), BY, 100)


def result_upsert(spark, d):
    res = B.results(spark, d)
    path = scratch_path(spark, "scores")
    R.upsert_results(res, path, KEYS, BY)
    R.upsert_results(res.filter("split = 'random' and n > 1").withColumn("rho", F.col("rho") + 5), path, KEYS, BY)
    return spark.read.schema(res.schema).parquet(path).select(*KEYS, "n", *_r("rho"))


QUERIES = {
    f.__name__: f
    for f in (
        record_source, csv_source, nested_results, flat_results, pooling_flatten, fasta_source, structure_tokens,
        ca_residues, anchor_unpivot, metric_mean, report_cells, report_lines, incremental_results,
        streaming_completeness, streaming_monitor, result_upsert,
    )
}

_CELLS = RESULTS + f""",
lc as (select model, split, layer, avg(rho) rho from res group by 1, 2, 3),
bl as (select * from (select *, row_number() over (partition by model, split order by rho desc, layer) i from lc) where i = 1),
cl as (select b.model, b.split, printf('%+.3f (L%d→%+.3f) n=%d', b.rho, b.layer, f.rho, n) cell
       from bl b join lc f on f.model = b.model and f.split = b.split and f.layer = {FINAL}
       join (select model, split, count(distinct dataset) n from res group by 1, 2) k on k.model = b.model and k.split = b.split)"""

_NAMES = ", ".join(f"'{v}'" for v in THREE_LETTER.values())

SQL = {
    "record_source": sql(ROWS, "select dataset, seq_len, count(*) n_rows, cast(sum(pos) as bigint) pos_sum from rws group by 1, 2"),
    "csv_source": """
with l as (select l_returnflag dataset, 'A' || (l_partkey % 120 + 1) || 'C' mutant, l_partkey % 120 + 1 pos, l_extendedprice f,
                  case when l_tax < 0.02 then 0 when l_tax < 0.04 then 90 else 100 end w,
                  row_number() over (order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax, l_partkey) o
           from lineitem where l_discount <> 0.05),
r as (select dataset, min_by(w, o) seq_len from l where w > 0 group by 1),
k as (select *, row_number() over (partition by dataset, mutant order by o desc) i
      from l join r using (dataset) where pos <= seq_len and (w = 0 or w = seq_len))
select dataset, cast(seq_len as int) seq_len, mutant variant_id, round(f, 2) fitness, cast(nullif(w, 0) as int) width from k where i = 1""",
    "nested_results": sql(RESULTS, """
select model arm, 'combined' featset, split, dataset, layer, cast(n as int) n, 10 n_rows, false capped, round(rho, 9) rho from res"""),
    "flat_results": sql(RESULTS, """
, m as (select model, split, dataset, max(rho) rho, count(*) n from res group by 1, 2, 3)
select model arm, 'auxiliary_only' featset, split, 2 shard, dataset, cast(null as int) layer, cast(n as int) n,
       case when n > 1 then round(rho, 9) end rho from m"""),
    "pooling_flatten": sql(RESULTS, """
select dataset, model arm, split, 's' || layer strategy, 'combined' featset, 'ridge' readout, cast(n as int) n, round(rho, 9) rho from res"""),
    "fasta_source": """
with s as (select 'doc' || doc_id as "name", replace(regexp_replace(text, '[^A-Z.\\-]', '', 'g'), '.', '-') s, text from documents)
select "name", cast(length(s) as int) width, md5(s) digest from s where length(trim(text)) > 0""",
    "structure_tokens": "with recursive " + ROWS.split("tok as (")[0].strip().rstrip(",") + """
select dataset, md5(case when dataset < '4' then reverse(lower(wt)) else lower(wt) end) digest from wts""",
    "ca_residues": f"""
with a as (select cast(l_orderkey as varchar) file, l_linenumber, l_suppkey % 21 k, l_returnflag = 'N' and l_tax <= 0.06 ok, l_returnflag, l_tax, l_suppkey from lineitem),
x as (select file, l_linenumber, ok, coalesce([{_NAMES}][k + 1], '') c,
             lpad(cast(l_linenumber as varchar), 5, ' ') || case when l_returnflag = 'N' then ' CA ' else ' CB ' end ||
             case when l_tax > 0.06 then 'B' else ' ' end || ([{', '.join(f"'{k}'" for k in THREE_LETTER)}, 'UNK'])[k + 1] r from a)
select file, coalesce(string_agg(case when ok then c else '' end, '' order by l_linenumber, r), '') seq from x group by 1""",
    "anchor_unpivot": """
with u as (select l_returnflag dataset, 'a' m, l_extendedprice y, l_quantity p from lineitem union all
           select l_returnflag, 'b', l_extendedprice, l_discount from lineitem where l_tax <= 0.07),
r as (select dataset, m, rank() over (partition by dataset, m order by y) + (count(*) over (partition by dataset, m, y) - 1) / 2.0 a,
             rank() over (partition by dataset, m order by p) + (count(*) over (partition by dataset, m, p) - 1) / 2.0 b from u),
s as (select dataset, m, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) rho from r group by 1, 2)
select m "method", round(avg(rho), 9) mean, count(rho) n from s group by 1""",
    "metric_mean": "select round(avg(l_discount), 9) mean, count(*) n from lineitem where l_tax <= 0.07",
    "report_cells": sql(_CELLS, "select model, split, cell from cl"),
    "report_lines": sql(_CELLS, "select '| ' || model || ' | ' || " + " || ' | ' || ".join(
        f"coalesce(max(cell) filter (split = '{s}'), '—')" for s in SPLITS) + " || ' |' as \"value\" from cl group by model"),
    "incremental_results": sql(RESULTS, """
select dataset, model, split, layer, n, cast(least(n - 1, 2) as int) "version", round(rho + least(n - 1, 2), 9) rho from res"""),
    "streaming_completeness": sql(RESULTS, """
select model, split, count(distinct dataset) n_datasets, count(distinct dataset) >= 100 complete from res group by 1, 2"""),
    "streaming_monitor": sql(RESULTS, """
select model, split, cast(least(count(distinct dataset), 50) as bigint) n_datasets, count(distinct dataset) >= 50 complete from res group by 1, 2"""),
    "result_upsert": sql(RESULTS, """
select dataset, model, split, layer, n, round(case when split = 'random' and n > 1 then rho + 5 else rho end, 9) rho from res"""),
}
