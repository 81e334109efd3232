"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, langid, linededup, mixing, packing, pii, repair, simhash, suffix, topk, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(_table(spark, sf_dir, "pages"))
    return warc.digest(warc.read_records(bundles))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.digest(langid.identify(docs, langid.fit(docs)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = linededup.LineIndex.build(docs)
    return linededup.digest(index.drop_lines(docs, keep_columns=["doc_id"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score(docs, model))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.plan_mix(_table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damage(rows)), rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


OP1_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages
), g as (
  select *, max(page_id) over (partition by d) as last from p
)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when n >= 1000 and last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and last is not null and page_id is distinct from last then last end as refers_to
from g
"""

OP2_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.r <> q.r
), r as (
  select *, row_number() over (partition by r order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""

#: The words of a text and all windows of ten, or of an item's length if it is shorter.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
with b as (select coalesce(item_id::varchar, 'null') as item, {_WORDS} as w from benchmark),
bw as (
  select item, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0
), windows as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as t from bw),
sizes as (select distinct m from windows),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
dw as (
  select r, m, unnest(range(1, (len(w) - m + 2)::bigint)) as i, w from d, sizes where len(w) >= m
), hits as (
  select r, i, dw.m, item from dw join windows on dw.m = windows.m and array_to_string(w[i:i + dw.m - 1], ' ') = t
), words as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hits) group by r
), items as (
  select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

OP6_SQL = """
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
s as (select r, string_split(text, chr(10)) as ls from d),
l as (
  select r, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from s
), k as (
  select r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l
), often as (
  select k from k where length(k) >= 1 group by k having count(distinct r) >= 10
), m as (
  select k.*, often.k is not null as gone from k left join often using (k)
), g as (
  select r, count(*) as n_lines, sum(gone::int) as n_dropped, string_agg(line, chr(10) order by i) filter (not gone) as kept from m group by r
)
select doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from d join g using (r)
"""

#: The states of the pattern are 0 start, 1 s, 2 u, 3 a.  A path is its cost in twelve digits and its letters, so that
#: the least string is the cheapest and then the ASCII-least path.  The crc32 is taken bit by bit.
OP11_SQL = r"""
with recursive t as (
  select dense_rank() over (order by conv_id) as c, row_number() over () as own, *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations
), h as (
  select *, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::bigint), lambda crc, byte: list_reduce(range(8), lambda v, i:
    case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(crc, byte)), 4294967295), 4294967295) % 20 as kind from t
), d as (
  select c, own, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role, unnest(case when kind = 3 then [1, 2] else [1] end) as copy,
    case when kind = 1 then '' when kind = 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text
  from h where kind <> 0
), f as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by c, role, text order by turn nulls first, own, copy) > 1 as again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as cut, left(role, 1) as ini,
    row_number() over (partition by c order by turn nulls first, role, sha256(length(role) || ':' || role || text), own, copy) as i
  from d
), r as (
  select *, case when blank then 'b' when again then 'd' when cut then 't' else 'k' end as fault, lag(ini) over (partition by c order by i) || ini as pair from f
), stats as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from r group by c
), ins(p, q, w, l) as (
  values (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')
), edit(ini, p, q, w, l) as (
  values ('', 0, 0, 4, 'D'), ('', 1, 1, 4, 'D'), ('', 2, 2, 4, 'D'), ('', 3, 3, 4, 'D'), ('', 0, 2, 3, 'R'), ('', 1, 2, 3, 'R'), ('', 2, 3, 3, 'R'), ('', 3, 2, 3, 'R'),
    ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('a', 2, 3, 0, 'K')
), dp as (
  select c, 0::bigint as i, 0 as s, '000000000000' as v from stats
  union all
  select dp.c, dp.i + 1 as i, edit.q as s, min(printf('%012d', dp.v[:12]::bigint + ins.w + edit.w + case when r.cut and edit.l <> 'D' then 3 else 0 end) || dp.v[13:] || ins.l || edit.l) as v
  from dp join r on r.c = dp.c and r.i = dp.i + 1 join ins on ins.p = dp.s join edit on edit.p = ins.q and (edit.l = 'D' or r.fault in ('t', 'k') and (edit.l = 'R' or edit.ini = r.ini))
  group by dp.c, dp.i + 1, edit.q
), best as (
  select c, min(printf('%012d', v[:12]::bigint + w) || v[13:] || l) as v
  from dp join stats using (c) join ins on p = s where i = n and q in (0, 3) group by c
), letters as (
  select c, unnest(string_split(v[13:], '')) as l, unnest(range(1, length(v) - 11)) as k from best
), placed as (
  select *, count(*) filter (l <> 'I') over w as i, count(*) filter (l <> 'D') over w as pos from letters window w as (partition by c order by k)
), lines as (
  select placed.c, k, case when l = 'K' then role when (pos - max(case when l = 'K' and ini = 's' then 1 else 0 end) over (partition by placed.c)) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when l = 'I' then '' else text end as line
  from placed join r on r.c = placed.c and r.i = greatest(placed.i, 1) where l <> 'D'
), hashes as (
  select c, sha256(string_agg(line, chr(10) order by k)) as h from lines group by c
)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(v[:12]::bigint, 0) as cost, coalesce(v[13:], '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct c, conv_id from t) ids left join stats using (c) left join best using (c) left join hashes using (c)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_topk": op2_topk,
        "op3_language": op3_language,
        "op4_pii": op4_pii,
        "op5_decontamination": op5_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_suffix": op10_suffix,
        "op11_repair": op11_repair,
        "op12_whitening": op12_whitening,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op2_topk": OP2_SQL,
        "op5_decontamination": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op11_repair": OP11_SQL,
    }
