"""Row features, profiles, structure confidence, pooling, lens scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import sequences as S
from foldwise.functions import substitutions as U
from foldwise.operators import alignment, confidence, lens, pooling, profile
from foldwise.plans import bindings as B
from foldwise.plans.catalog.curves import _r
from foldwise.plans.catalog.rows import all_rows, valid
from foldwise.plans.catalog.views import (
    AA, ALIGNED, CONFIDENCE, LABELLED, LETTERS, LOGITS, REFS, RESULTS, ROWS, VECTORS, letter, sql,
)

CONCAT = (1, 3, 7)
MEAN = (4, 5, 6, 7)
SPOTS = 512  # positions of a reference that are masked together


def _aux(order):
    def run(spark, d):
        rows = all_rows(spark, d)
        a = U.aux_features(rows, B.scores(rows), order)
        return a.select(
            "row_id", F.size("aux").alias("width"),
            F.array_position(F.slice("aux", 1, 20), F.lit(1.0)).alias("from_i"),
            F.array_position(F.slice("aux", 21, 20), F.lit(1.0)).alias("to_i"),
            F.get("aux", F.lit(40)).alias("score"), F.round(F.get("aux", F.lit(41)), 9).alias("dist"),
        )
    return run


def lenient_parse(spark, d):
    """Tokens kept by the strict and by the lenient rule."""
    v = B.variants(spark, d)
    return v.select(
        "variant_id", F.size(U.parse_substitutions(F.col("mut_info"))).alias("n_strict"),
        F.size(U.parse_substitutions(F.col("mut_info"), strict=False)).alias("n_lenient"),
    )


def apply_substitutions(spark, d):
    refs = B.references(spark, d).select("dataset", "wt", U.single_bytes(F.col("wt")).alias("single"))
    v = valid(spark, d).join(refs, "dataset")
    return v.select("dataset", "variant_id", F.md5(U.apply_substitutions(F.col("wt"), F.col("subs"), F.col("single"))).alias("digest"))


def model_input_tokens(spark, d):
    """Masked, structure-paired input of every position of every reference."""
    starts = F.sequence(F.lit(1), F.col("seq_len"), F.lit(SPOTS))
    refs = B.references(spark, d).select("*", F.explode(starts).alias("from"))
    # a count is given, else the few bytes of the texts would be read by one task that has all positions to do
    blocks = refs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dataset", "from")
    tokens = blocks.select(
        "dataset", "seq_len", "from", U.model_input(F.col("wt")).alias("plain"),
        U.model_input(F.col("wt"), F.lower(F.reverse("wt")), paired=True).alias("paired"))
    last = F.least(F.col("from") + (SPOTS - 1), F.col("seq_len"))
    spots = tokens.select("*", F.explode(F.sequence(F.col("from"), last)).alias("pos"))
    return spots.select(
        "dataset", "pos", F.md5(U.masked_input(F.col("plain"), F.col("pos"))).alias("plain"),
        F.md5(U.masked_input(F.col("paired"), F.col("pos"), paired=True)).alias("paired"))


def strip_insertions(spark, d):
    docs = B.table(spark, d, "documents")
    s = S.strip_insertions(F.col("text"))
    return docs.select("doc_id", F.length(s).alias("kept"), F.md5(s).alias("digest"))


def token_inventory(spark, d):
    pages = B.table(spark, d, "pages")
    return pages.select("page_id", F.length("html").alias("length"), S.gap_count(F.col("html")).alias("gaps"))


def offset_alignment(spark, d):
    """The middle of every message, slightly changed, placed back on the whole message."""
    msgs = B.table(spark, d, "conversations").select("conv_id", "turn", B.letters("text").alias("long"))
    n = F.length("long")
    pairs = msgs.withColumn(
        "short", F.translate(F.col("long").substr(F.floor(n / 4).cast("int") + 1, F.floor(n / 2).cast("int")), "W", "C")
    )
    placed = alignment.best_offset(pairs, 0.9)
    padded = S.gap_pad(F.lower("short"), F.col("start"), F.length("long"))
    return placed.select("conv_id", "turn", "start", F.round("identity", 9).alias("identity"), F.md5(padded).alias("padded"))


def corpus_alignment(spark, d):
    """Every message against the changed middles of all messages: where each is held."""
    msgs = B.table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("long_id"), B.letters("text").alias("long"))
    n = F.length("long")
    middles = msgs.select(F.col("long_id").alias("short_id"), F.translate(F.col("long").substr(F.floor(n / 4).cast("int") + 1, F.floor(n / 2).cast("int")), "W", "C").alias("short"))
    return alignment.place_everywhere(msgs, middles).select("long_id", "short_id", "start", *_r("identity"))


def pssm(spark, d):
    p = profile.position_profile(B.alignments(spark, d), B.alignment_refs(spark, d))
    return p.select("dataset", "pos", "letter", "count", *_r("logodds"))


def msa_coverage(spark, d):
    p = profile.position_profile(B.alignments(spark, d), B.alignment_refs(spark, d))
    return profile.profile_rows(p).select("dataset", "pos", *_r("coverage"))


def msa_admission(spark, d):
    """References of 61 letters have no exact match, so the near ones are taken."""
    refs = B.alignment_refs(spark, d).withColumn("seq_len", F.lit(61))
    return profile.admitted(B.alignments(spark, d), refs).groupBy("dataset", "n_seqs").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.length("seq")).alias("shortest")
    )


_LANG = {"1-URGENT": "en", "2-HIGH": "fr", "3-MEDIUM": "de", "4-NOT SPECIFIED": "es"}


def lang_rows(spark, d):
    rows = all_rows(spark, d)
    name = F.coalesce(*[F.when(F.col("dataset") == k, F.lit(v)) for k, v in _LANG.items()], F.lit("none"))
    return rows.withColumn("dataset", name).withColumn("pos", (F.col("pos") - 1) % 60 + 1).withColumn("seq_len", F.lit(60))


def profile_features(spark, d):
    rows = lang_rows(spark, d)
    p = profile.position_profile(B.alignments(spark, d), B.alignment_refs(spark, d))
    x = profile.profile_features(rows, p, B.scores(rows))
    return x.select(
        "dataset", "row_id", F.size("x").alias("width"), "with_profile", F.round(F.get("x", F.lit(42)), 9).alias("rel_pos"),
        F.round(F.get("x", F.lit(43)), 9).alias("first"), F.round(F.get("x", F.lit(63)), 9).alias("coverage"),
    )


def _pooled(strategy, layers, weights=False):
    def run(spark, d):
        hidden = B.label_vectors(spark, d)
        w = None
        if weights:
            w = hidden.groupBy("layer").agg(F.avg(F.get("vec", F.lit(0))).alias("logit"))
        e = pooling.pool_layers(hidden, ["dataset", "pos"], strategy, layers, w)
        return e.select("dataset", "pos", F.posexplode("emb").alias("dim", "v")).select(
            "dataset", "pos", "dim", F.round("v", 9).alias("v")
        )
    return run


def mutant_units(spark, d):
    v = pooling.variant_vectors(all_rows(spark, d), B.position_vectors(spark, d))
    return v.select("dataset", "variant_id", "layer", F.round(F.get("vec", F.lit(0)), 9).alias("v0"),
                    F.round(F.get("vec", F.lit(7)), 9).alias("v7"))


def attach_units(spark, d):
    j = pooling.attach_units(all_rows(spark, d), B.position_vectors(spark, d), "pos")
    return j.groupBy("dataset", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("vec", F.lit(0))), 9).alias("m")
    )


def confidence_window(spark, d):
    x = confidence.confidence_features(B.confidence_rows(spark, d), B.confidence(spark, d), B.errors(spark, d))
    return x.select("dataset", "row_id", "pos", *[F.round(F.get("struct", F.lit(i)), 6).alias(f"f{i}") for i in range(12)])


def error_statistics(spark, d):
    rows = B.confidence_rows(spark, d)
    x = confidence.error_statistics(rows, B.errors(spark, d), radius=3)
    return x.select("row_id", *_r("pae_mean", "pae_max", "pae_min", digits=6))


def exposure_and_distance(spark, d):
    c = B.confidence(spark, d).select("dataset", F.posexplode(confidence.exposure(F.col("plddt"))).alias("k", "exposure"))
    e = B.errors(spark, d).select(
        "dataset", F.posexplode(confidence.distance_proxy(F.col("pae_row"))).alias("k", "_distance")
    ).groupBy("dataset", "k").agg(F.avg("_distance").alias("distance"), F.max("_distance").alias("farthest"))
    return c.join(e, ["dataset", "k"]).select("dataset", "k", *_r("exposure", "distance", "farthest", digits=6))


def neighbour_window(spark, d):
    res = B.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("dataset"), F.posexplode("embedding").alias("_k", "value")
    ).select("dataset", (F.col("_k") + 1).alias("pos"), F.col("value").cast("double").alias("value"))
    w = confidence.neighbour_window(res)
    return w.select("dataset", "pos", *[F.round(F.get("near", F.lit(i)), 9).alias(f"w{i}") for i in range(5)])


def _letters(direct):
    def run(spark, d):
        spots = lens.letter_arrays(B.packed_logits(spark, d), B.VOCABULARY, direct)
        letters = spots.select("dataset", "pos", "layer", F.posexplode("logp").alias("_i", "logp")).filter(F.col("logp").isNotNull())
        return letters.select("dataset", "pos", "layer", F.lit(AA).substr(F.col("_i") + 1, F.lit(1)).alias("letter"), *_r("logp"))
    return run


def _lens(spark, d):
    return lens.packed_lens_scores(all_rows(spark, d), B.packed_logits(spark, d), B.VOCABULARY)


def log_ratio(spark, d):
    s = lens.packed_log_ratio(all_rows(spark, d), lens.letter_arrays(B.packed_logits(spark, d), B.VOCABULARY))
    return s.select("row_id", "layer", *_r("score"))


def token_lens(spark, d):
    """Mean log ratios of every layer from logits with a row for each token: the form for vocabularies that differ by spot."""
    s = lens.log_ratio(all_rows(spark, d), lens.letter_log_probs(B.logits(spark, d)))
    return s.groupBy("dataset", "layer").agg(F.round(F.avg("score"), 9).alias("mean"), F.count("score").alias("n"))


def lens_spearman(spark, d):
    return _lens(spark, d).select("dataset", "layer", *_r("rho", digits=6), "n")


def lens_summary(spark, d):
    gate = all_rows(spark, d).groupBy("dataset").agg((F.max("fitness") > F.avg("fitness") * 1.99).alias("gate_pass"))
    return lens.lens_summary(_lens(spark, d), gate).select("layer", "n", *_r("mean", "sd", digits=6))


def condition_names(spark, d):
    res = B.results(spark, d)
    name = F.concat(F.lit("v4__"), "model", F.lit("__combined__"), "split", F.lit("__shard"), F.col("layer").cast("string"), F.lit(".json"))
    parts = S.condition_parts(name)
    return res.select(*[v.alias(k) for k, v in parts.items()]).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "aux_features": _aux("ncbi"),
    "aux_features_as_published": _aux("as_published"),
    "lenient_parse": lenient_parse,
    "apply_substitutions": apply_substitutions,
    "model_input_tokens": model_input_tokens,
    "strip_insertions": strip_insertions,
    "token_inventory": token_inventory,
    "offset_alignment": offset_alignment,
    "corpus_alignment": corpus_alignment,
    "pssm": pssm,
    "msa_coverage": msa_coverage,
    "msa_admission": msa_admission,
    "profile_features": profile_features,
    "pool_last": _pooled("last", (7,)),
    "pool_mean": _pooled("mean", MEAN),
    "pool_concat": _pooled("concat", CONCAT),
    "pool_weighted": _pooled("weighted", None, True),
    "mutant_units": mutant_units,
    "attach_units": attach_units,
    "confidence_window": confidence_window,
    "error_statistics": error_statistics,
    "exposure_and_distance": exposure_and_distance,
    "neighbour_window": neighbour_window,
    "logsumexp_lens": _letters(False),
    "direct_token_lens": _letters(True),
    "log_ratio": log_ratio,
    "token_lens": token_lens,
    "lens_spearman": lens_spearman,
    "lens_summary": lens_summary,
    "condition_names": condition_names,
}

_SC = ROWS + ", sc as (select from_aa, to_aa, cast(count(*) % 9 - 4 as double) score from rws group by 1, 2)"


def _aux_sql(target):
    return sql(_SC, f"""
select row_id, 42 width, instr('{AA}', r.from_aa) from_i, instr('{AA}', r.to_aa) to_i, coalesce(s.score, 0.0) score,
       round(abs(instr('{AA}', r.from_aa) - instr('{AA}', r.to_aa)) / 19.0, 9) dist
from rws r left join sc s on r.from_aa = s.from_aa and r.to_aa = {target}""")


_VALIDV = ROWS + """,
sub as (select dataset, variant_id, pos, to_aa, row_number() over (
          partition by variant_id, pos order by line_no desc, from_aa || cast(pos as varchar) || to_aa desc) i from rws)"""

_PROFILE = ALIGNED + f""",
ok as (select * from msa where length(seq) = 60),
nn as (select dataset, count(*) n_seqs from ok group by 1 having count(*) >= 5),
cn as (select dataset, p pos, substr(seq, cast(p as int), 1) letter, count(*) c
       from ok, (select unnest(range(1, 61)) p) group by 1, 2, 3),
tt as (select dataset, pos, sum(c) t from cn group by 1, 2),
pf as (select n.dataset, cast(p.p as int) pos, a.letter, coalesce(c.c, 0) count,
              ln((coalesce(c.c, 0) + 0.05) / (coalesce(t.t, 0) + 1.0) / 0.05) logodds, coalesce(t.t, 0) / n.n_seqs coverage
       from nn n cross join (select unnest(range(1, 61)) p) p
       cross join (select unnest(string_split('{AA}', '')) letter) a
       left join cn c on c.dataset = n.dataset and c.pos = p.p and c.letter = a.letter
       left join tt t on t.dataset = n.dataset and t.pos = p.p)"""

_LREXP = LOGITS + """,
tp as (select dataset, pos, layer, max(logit) m from lg group by 1, 2, 3),
al as materialized (select dataset, pos, layer, m, ln(sum(exp(logit - m))) + m total from lg join tp using (dataset, pos, layer) group by 1, 2, 3, 4),
ll as materialized (select dataset, pos, layer, letter, ln(sum(exp(logit - m))) + m - total logp,
              min_by(logit, token_id) - total direct
       from lg join al using (dataset, pos, layer) where letter is not null group by dataset, pos, layer, letter, m, total)"""



def _with_rows(views: str) -> str:
    """Add the row views to a list that already starts with the reference views."""
    return views + ROWS[len(REFS):]


_LENS = _with_rows(_LREXP) + """,
sr as (select r.dataset, r.row_id, r.fitness, a.layer, a.logp - b.logp score
       from rws r join ll a on a.dataset = r.dataset and a.pos = r.pos and a.letter = r.to_aa
       join ll b on b.dataset = r.dataset and b.pos = r.pos and b.letter = r.from_aa and b.layer = a.layer),
rk as (select dataset, layer,
         rank() over (partition by dataset, layer order by score) + (count(*) over (partition by dataset, layer, score) - 1) / 2.0 rx,
         rank() over (partition by dataset, layer order by fitness) + (count(*) over (partition by dataset, layer, fitness) - 1) / 2.0 ry
       from (select dataset, layer, round(score, 12) score, fitness from sr)),
ls as (select dataset, layer, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) rho, count(*) n from rk group by 1, 2)"""

# one row per spot before the rows come in: DuckDB then joins them once
_PACKED = _with_rows(_LREXP) + """,
pk as materialized (select dataset, pos, map_from_entries(list((layer::varchar || letter, logp))) m from ll group by 1, 2),
rm as materialized (select dataset, row_id, pos, from_aa, to_aa from rws),
sr as (select r.dataset, row_id, layer, m[layer::varchar || to_aa] - m[layer::varchar || from_aa] score
       from rm r join pk using (dataset, pos) cross join (select unnest([0, 1])::int layer) l)"""

_POOL = "select dataset, pos, cast(dim as int) dim, round(v, 9) v from "

SQL = {
    "aux_features": _aux_sql("s.to_aa"),
    "aux_features_as_published": _aux_sql(f"translate(s.to_aa, 'ARNDCQEGHILKMFPSTWYV', '{AA}')"),
    "lenient_parse": sql(ROWS, """
select cast(l_orderkey as varchar) variant_id,
       cast(count(*) filter (not (l_suppkey % 20 = 7 and l_tax >= 0.07)) as int) n_strict, cast(count(*) as int) n_lenient
from lineitem join orders on l_orderkey = o_orderkey group by 1"""),
    "apply_substitutions": sql(_VALIDV, f"""
, vs as (select distinct dataset, variant_id from rws),
ch as (select v.dataset, v.variant_id, p.p, coalesce(s.to_aa, {letter('p.p')}) c
       from vs v join (select dataset, unnest(range(1, seq_len + 1)) p from refs) p using (dataset)
       left join sub s on s.variant_id = v.variant_id and s.pos = p.p and s.i = 1)
select dataset, variant_id, md5(string_agg(c, '' order by p)) digest from ch group by 1, 2"""),
    "model_input_tokens": sql(ROWS, """
, w as (select dataset, seq_len, string_split(wt, '') a, string_split(lower(reverse(wt)), '') s from wts),
q as (select *, unnest(range(1, seq_len + 1)) pos from w)
select dataset, cast(pos as int) pos,
       md5(array_to_string(list_transform(a, lambda c, i: case when i = pos then '<mask>' else c end), ' ')) plain,
       md5(array_to_string(list_transform(a, lambda c, i: case when i = pos then '<mask>' else c || s[i] end), ' ')) paired
from q"""),
    "strip_insertions": """
with s as (select doc_id, replace(regexp_replace(text, '[^A-Z.\\-]', '', 'g'), '.', '-') s from documents)
select doc_id, cast(length(s) as int) kept, md5(s) digest from s""",
    "token_inventory": """
select page_id, cast(length(html) as int) length, cast(length(html) - length(replace(html, '#', '')) as int) gaps from pages""",
    "offset_alignment": f"""
with m as (select conv_id, turn, {LETTERS} long from conversations),
p as (select *, length(long) n, replace(substr(long, cast(length(long) // 4 + 1 as int), cast(length(long) // 2 as int)), 'W', 'C') short from m),
s as (select *, unnest(range(0, n - length(short) + 1)) st from p where length(short) > 0),
c as (select conv_id, turn, long, short, n, st, list_sum(list_transform(range(1, length(short) + 1),
        lambda i: case when short[i] = long[st + i] then 1 else 0 end)) / length(short) ident from s),
b as (select *, row_number() over (partition by conv_id, turn order by ident desc, st) k from c)
select conv_id, turn, cast(st as int) "start", round(ident, 9) identity,
       md5(rpad(repeat('#', st) || lower(short), cast(n as int), '#')) padded from b where k = 1 and ident >= 0.9""",
    "pssm": sql(_PROFILE, "select dataset, pos, letter, count, round(logodds, 9) logodds from pf"),
    "msa_coverage": sql(_PROFILE, "select dataset, pos, round(max(coverage), 9) coverage from pf group by 1, 2"),
    "msa_admission": sql(ALIGNED, """
select dataset, count(*) n_seqs, count(*) n, cast(min(length(seq)) as int) shortest
from msa where abs(length(seq) - 61) <= 2 group by 1 having count(*) >= 5"""),
    "profile_features": "with recursive " + ROWS.strip() + "," + _PROFILE.strip() + """,
pr as (select *, case dataset when '1-URGENT' then 'en' when '2-HIGH' then 'fr' when '3-MEDIUM' then 'de'
              when '4-NOT SPECIFIED' then 'es' else 'none' end lang, (pos - 1) % 60 + 1 p60 from rws)
select lang dataset, row_id, cast(case when f.pos is not null then 64 else 43 end as int) width, f.pos is not null with_profile,
       round(p60 / 60.0, 9) rel_pos, round(f.logodds, 9) "first", round(f.coverage, 9) coverage
from pr left join (select * from pf where letter = 'A') f on f.dataset = lang and f.pos = p60""",
    "pool_last": sql(LABELLED, _POOL + "(select dataset, pos, unnest(range(0, 8)) dim, unnest(vec) v from lv where layer = 7)"),
    "pool_mean": sql(LABELLED, _POOL + """(select dataset, pos, dim, avg(v) v from (
select dataset, pos, unnest(range(0, 8)) dim, unnest(vec) v from lv where layer in (4, 5, 6, 7)) group by 1, 2, 3)"""),
    "pool_concat": sql(LABELLED, _POOL + """(select dataset, pos, i + 8 * case layer when 1 then 0 when 3 then 1 else 2 end dim, v from (
select dataset, pos, layer, unnest(range(0, 8)) i, unnest(vec) v from lv where layer in (1, 3, 7)))"""),
    "pool_weighted": sql(LABELLED, """
, w as (select layer, avg(vec[1]) logit from lv group by 1),
x as (select layer, exp(logit - (select max(logit) from w)) e from w),
y as (select layer, e / (select sum(e) from x) w from x)
""" + _POOL + """(select dataset, pos, dim, sum(w * v) v from (
select dataset, pos, layer, unnest(range(0, 8)) dim, unnest(vec) v from lv) join y using (layer) group by 1, 2, 3)"""),
    "mutant_units": sql(_with_rows(VECTORS), """
select dataset, variant_id, cast(layer as int) layer, round(avg(cast(vec[1] as double)), 9) v0, round(avg(cast(vec[8] as double)), 9) v7
from (select distinct dataset, variant_id, pos from rws) join pv using (dataset, pos) group by 1, 2, 3"""),
    "attach_units": sql(_with_rows(VECTORS), """
select dataset, cast(layer as int) layer, count(*) n, round(avg(cast(vec[1] as double)), 9) m
from rws join pv using (dataset, pos) group by 1, 2"""),
    "confidence_window": sql(CONFIDENCE, """
, j as (select r.*, c.plddt, c.iptm, p.pae_row,
          [plddt[greatest(1, least(r.i + o, 64))] for o in [-2, -1, 0, 1, 2]] near
       from cr r join cf c using (dataset) join pe p on p.dataset = r.dataset and p.i = r.i)
select dataset, row_id, pos, round(plddt[i], 6) f0, round(near[1], 6) f1, round(near[2], 6) f2, round(near[3], 6) f3,
       round(near[4], 6) f4, round(near[5], 6) f5, round(list_avg(pae_row), 6) f6, round(list_max(pae_row), 6) f7,
       round(plddt[i] - list_avg(plddt), 6) f8, round(list_stddev_pop(near), 6) f9, round(list_avg(plddt), 6) f10,
       round(iptm, 6) f11 from j"""),
    "error_statistics": sql(CONFIDENCE, """
, j as (select r.row_id, pae_row[greatest(1, r.i - 3) : least(64, r.i + 3)] b
       from cr r join pe p on p.dataset = r.dataset and p.i = r.i)
select row_id, round(list_avg(b), 6) pae_mean, round(list_max(b), 6) pae_max, round(list_min(b), 6) pae_min from j"""),
    "exposure_and_distance": sql(CONFIDENCE, """
, x as (select c.dataset, unnest(range(0, 64)) k, unnest(plddt) p, unnest(pae_row) e from cf c join pe on pe.dataset = c.dataset)
select dataset, cast(k as int) k, round((100 - least(greatest(max(p), 40), 100)) / 60, 6) exposure, round(avg(e * 0.5), 6) distance, round(max(e * 0.5), 6) farthest from x group by dataset, k"""),
    "neighbour_window": """
with e as (select vec_id dataset, unnest(range(1, 65)) pos, embedding v from embeddings)
select dataset, cast(pos as int) pos, round(cast(v[greatest(1, pos - 2)] as double), 9) w0, round(cast(v[greatest(1, pos - 1)] as double), 9) w1,
       round(cast(v[pos] as double), 9) w2, round(cast(v[least(64, pos + 1)] as double), 9) w3, round(cast(v[least(64, pos + 2)] as double), 9) w4 from e""",
    "logsumexp_lens": sql(_LREXP, "select dataset, pos, layer, letter, round(logp, 9) logp from ll"),
    "direct_token_lens": sql(_LREXP, "select dataset, pos, layer, letter, round(direct, 9) logp from ll"),
    "log_ratio": sql(_PACKED, "select row_id, layer, round(score, 9) score from sr where score is not null"),
    "token_lens": sql(_PACKED, "select dataset, layer, round(avg(score), 9) mean, count(score) n from sr where score is not null group by 1, 2"),
    "lens_spearman": sql(_LENS, "select dataset, layer, round(rho, 6) rho, n from ls"),
    "lens_summary": sql(_LENS, """
, g as (select dataset from rws group by 1 having max(fitness) > avg(fitness) * 1.99)
select layer, count(rho) n, round(avg(rho), 6) mean, round(stddev_pop(rho), 6) sd from ls semi join g using (dataset) group by 1"""),
    "condition_names": sql(RESULTS, """
select model arm, 'combined' featset, split, layer shard, count(*) n from res group by all"""),
}
