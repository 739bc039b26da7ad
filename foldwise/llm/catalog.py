"""Registered queries of this package and, where SQL can say it, their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, fingerprints, jaccard, lm, merkle, mixing, quality, quotes, rendezvous, rules, token_files, token_links, urls
from foldwise.llm.text import word_count
from foldwise.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"),
                                 end_id=2, vocabulary=49_408)
    return token_files.digest(manifest)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN, keep=["doc_id"]).drop("ids")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations")).orderBy("conv_id", "reply_path")


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model)
    return out.select("doc_id", "content_odds", "metadata_odds", "quality_probability", "accepted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(rules.measure(table(spark, sf_dir, "documents")).select("doc_id", "source", *rules.MEASURES), "rules")
    return rules.judge(measured, rules.host_rates(measured)).select("doc_id", *rules.MEASURES, "kept", "host_rate", "host_bound")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = mixing.copies(slim, mixing.targets(slim))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return merkle.audit(table(spark, sf_dir, "documents"), tampered).drop("lang")


def op13_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.assign(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)


QUERIES = {
    "op1_elias_fano_lm": op1_elias_fano_lm,
    "op2_token_files": op2_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_cotraining": op6_cotraining,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_fingerprints": op8_fingerprints,
    "op9_host_rules": op9_host_rules,
    "op10_systematic_mix": op10_systematic_mix,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_rendezvous": op13_rendezvous,
}

#: crc32 of a list of bytes, as DuckDB can say it: 256 values from eight steps each, then one look-up a byte.
_CRC = """
crc_table as (select list(v order by i) as t from (
  select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda x: x::ubigint)),
    lambda a, b: case when a & 1 = 1 then xor(3988292384::ubigint, a >> 1) else a >> 1 end) as v from range(256) r(i)) x),
"""


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::ubigint)"
    step = "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::int + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {octets}), {step}), 4294967295::ubigint)::bigint"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _shard(n: int) -> str:
    u = "((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/' || i), 1, 13))::bigint::double + 0.5) / 16::double ** 13)"
    scores = f"list_transform(range({n}), lambda i: 1.0::double / -ln({u}))"
    return f"list_position({scores}, list_max({scores})) - 1"


SQL: dict[str, str] = {
    "op12_merkle_manifest": f"""
with recursive {_CRC}
leaves as (
  select doc_id, lang, {_leaf()} as leaf,
    case when {_crc("doc_id::varchar")} % 7 = 0 and n_chars is not null then {_leaf("(n_chars + 1)")} end as changed from documents, crc_table),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from leaves),
nodes as (
  select lang, 0 as level, place as i, n, leaf as h from placed
  union all
  select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by lang, level, i // 2, n),
subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
crown as (
  select 0 as level, place as i, n, h from subroots
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from crown where n > 1 group by level, i // 2, n),
steps as (
  select p.lang, p.place, a.level as step, case when b.i < a.i then 'L' else 'R' end || b.h as sibling
  from placed p join nodes a on a.lang is not distinct from p.lang and a.i = p.place >> a.level and a.n > 1
  join nodes b on b.lang is not distinct from a.lang and b.level = a.level and b.i = xor(a.i, 1)),
crown_steps as (
  select s.lang, a.level + 1000 as step, case when b.i < a.i then 'L' else 'R' end || b.h as sibling
  from subroots s join crown a on a.i = s.place >> a.level and a.n > 1 join crown b on b.level = a.level and b.i = xor(a.i, 1)),
lone as (  -- levels on which a node has no sibling: it is hashed alone
  select p.lang, p.place, a.level as step from placed p join nodes a on a.lang is not distinct from p.lang and a.i = p.place >> a.level
  where a.n > 1 and xor(a.i, 1) >= a.n),
crown_lone as (select s.lang, a.level + 1000 as step from subroots s join crown a on a.i = s.place >> a.level where a.n > 1 and xor(a.i, 1) >= a.n),
paths as (
  select lang, place, list(sibling order by step) as path from (
    select * from steps union all select lang, place, step, '-' from lone
    union all select p.lang, p.place, c.step, c.sibling from placed p join crown_steps c on c.lang is not distinct from p.lang
    union all select p.lang, p.place, c.step, '-' from placed p join crown_lone c on c.lang is not distinct from p.lang) x group by lang, place),
folded as (
  select p.doc_id, p.leaf, s.h as subroot, (select h from crown where n = 1) as root, coalesce(q.path, []) as path, coalesce(p.changed, p.leaf) as start
  from placed p join subroots s on s.lang is not distinct from p.lang left join paths q on q.lang is not distinct from p.lang and q.place = p.place),
done as (
  select *, list_reduce(list_prepend(start, path), lambda a, x: sha256(case x[1] when 'L' then x[2:] || a when 'R' then a || x[2:] else a end)) as folded_root from folded)
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x[2:])), 'string_agg', '')) as proof_sha256,
  folded_root, folded_root = root as verified from done""",
    "op13_rendezvous": f"""
with {_CRC}
sized as (
  select doc_id, coalesce(strlen(text), 0) + 1 as size, coalesce({_crc("text")}, 0) as text_crc32, ({_shard(8)})::int as shard, ({_shard(9)})::int as grown_shard from documents, crc_table)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
from sized""",
}
