"""The bindings once more, as SQL common table expressions for the checks."""

AA = "ACDEFGHIKLMNPQRSTVWY"


def letter(pos: str) -> str:
    return f"substr('{AA}', cast(({pos} * 7) % 20 + 1 as int), 1)"


REFS = f"""
nv as (select cast(count(*) as int) nvec from embeddings),
refs as (
  select dataset, cast(nvec - 5 * cast(substr(dataset, 1, 1) as int) as int) seq_len
  from (select distinct o_orderpriority dataset from orders), nv),
wts as (
  select dataset, seq_len, string_agg({letter('p')}, '' order by p) wt
  from (select dataset, seq_len, unnest(range(1, seq_len + 1)) p from refs) group by 1, 2)
"""

# every token, then the ones a valid variant keeps
ROWS = REFS + f""",
tok as (
  select o_orderpriority dataset, cast(l_orderkey as varchar) variant_id, l_linenumber line_no,
         cast(l_partkey % nvec + 1 as int) pos,
         case when l_suppkey % 20 = 7 and l_tax >= 0.07 then 'X'
              else substr('{AA}', cast(l_suppkey % 20 + 1 as int), 1) end to_aa,
         o_totalprice fitness
  from lineitem join orders on l_orderkey = o_orderkey, nv
  where not (o_orderstatus = 'P' and o_custkey % 10 = 0) and o_custkey % 50 <> 1),
parsed as (
  select t.*, {letter('t.pos')} from_aa, r.seq_len,
         cast(count(*) over (partition by variant_id) as int) n_parsed
  from tok t join refs r using (dataset) where to_aa <> 'X'),
rws as (
  select *, variant_id || ':' || cast(row_number() over (
             partition by variant_id order by line_no, from_aa || cast(pos as varchar) || to_aa) as varchar) row_id
  from parsed where pos <= seq_len)
"""

VECTORS = REFS + """,
pv as (
  select r.dataset, e.pos, l.layer, e.embedding[l.layer * 8 + 1 : l.layer * 8 + 8] vec
  from refs r
  join (select cast(vec_id + 1 as int) pos, embedding from embeddings) e on e.pos <= r.seq_len
  cross join (select unnest(range(0, 8)) layer) l)
"""

LABELLED = """
lv as (
  select cast(label as varchar) dataset, cast(vec_id + 1 as int) pos, cast(l.layer as int) layer,
         cast(embedding[l.layer * 8 + 1 : l.layer * 8 + 8] as double[]) vec
  from embeddings cross join (select unnest(range(0, 8)) layer) l)
"""

RESULTS = """
res as (
  select cast(user_id as varchar) dataset,
         case when event_id % 2 = 0 then 'base' else 'real' end model,
         case event_type when 'click' then 'random' when 'view' then 'modulo' when 'purchase' then 'contiguous'
              when 'signup' then 'position_groupkfold' when 'error' then 'legacy' end split,
         cast(cast(json_extract(props, '$.k') as int) % 4 as int) layer,
         cast(sum(cast(round(value * 100) as bigint)) as double) / (count(*) * 100000.0) rho,
         count(*) n
  from events group by 1, 2, 3, 4)
"""

# foreign letters are removed before upper(): some of them have two-letter capitals
LETTERS = f"upper(regexp_replace(text, '[^{AA}{AA.lower()}]', '', 'g'))"

ALIGNED = f"""
lt as (select lang dataset, doc_id seq_no, {LETTERS} t from documents),
msa as (select dataset, seq_no, part, substr(t, cast(part * 60 + 1 as int), 60) seq
        from (select *, unnest(range(0, greatest(cast(ceil(length(t) / 60.0) as int), 1))) part from lt))
"""

LOGITS = REFS + f"""
, lg as (
  select r.dataset, e.pos, cast(i // 32 as int) layer, cast(i % 32 as int) token_id,
         case when i % 32 < 30 then substr('{AA}', cast(i % 32 % 20 + 1 as int), 1) end letter,
         cast(e.embedding[i + 1] as double) logit
  from refs r join (select cast(vec_id + 1 as int) pos, embedding, unnest(range(0, 64)) i from embeddings) e
    on e.pos <= r.seq_len)
"""

CONFIDENCE = """
nv as (select count(*) nvec from embeddings),
cf as (select vec_id dataset, list_transform(embedding, lambda x: abs(cast(x as double)) * 300) plddt, label / 10.0 iptm from embeddings),
pe as (select vec_id dataset, i, list_transform(embedding, lambda x, k: abs(cast(x as double)) * 30 + abs(i - k) / 8.0) pae_row
       from (select *, unnest(range(1, 65)) i from embeddings)),
cr as (select l_partkey % nvec dataset, l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_partkey row_id,
              cast(l_suppkey % 70 + 1 as int) pos, greatest(1, least(cast(l_suppkey % 70 + 1 as int), 64)) i
       from lineitem, nv)
"""


def md5_int(expr: str, start: int = 1, digits: int = 8) -> str:
    return f"cast(('0x' || substr(md5({expr}), {start}, {digits})) as bigint)"


def sql(views: str, body: str) -> str:
    return f"with recursive {views.strip()} {body.strip()}"
