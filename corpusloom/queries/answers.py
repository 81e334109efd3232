"""Queries over whole answers: the orchestrated plan and the metrics of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.queries.corpus import _BM25, _DENSE, _WS, _bench, _docs, _vecs
from corpusloom.queries.registry import query
from corpusloom.queries.text import _BOUNDED, _EN, _HINT, _HOP

#: Words, their counts and document frequencies in the corpus, from the SQL of BM25.
_CORPUS = _BM25.split("qt as")[0].rstrip().rstrip(",")


def searched(p: str, asked: str) -> str:
    """CTEs with the prefix ``p`` that end in ``{p}top`` (query_id, id, rank, score, text): the five best
    of a hybrid search for the table ``asked`` (query_id, text, e, k)."""
    return rf"""{p}ds as (select query_id, c.vec_id as id, list_inner_product(q.e, c.embedding::double[]) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.embedding::double[], c.embedding::double[]))) as s
  from {asked} q, embeddings c where q.e is not null and c.vec_id in (select doc_id from documents)),
{p}dense as (select query_id, id, row_number() over (partition by query_id order by round(s, 6) desc, id) as rank from {p}ds qualify rank <= 50),
{p}qt as (select distinct query_id, unnest({_WS}) as term from {asked}),
{p}bs as (select query_id, id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * l / avgdl))) as s
  from {p}qt join tf using (term) join df using (term), st group by query_id, id),
{p}bm as (select query_id, id, row_number() over (partition by query_id order by round(s, 6) desc, id) as rank from {p}bs qualify rank <= 50),
{p}f as (select query_id, id, sum(1.0::double / (k + rank)) as rrf from (select * from {p}dense union all select * from {p}bm) join {asked} using (query_id) group by query_id, id),
{p}hy as (select query_id, id, rrf from {p}f qualify row_number() over (partition by query_id order by round(rrf, 9) desc, id) <= 50),
{p}cand as (select query_id, id, d.text, list_distinct(regexp_extract_all(lower(substr(d.text, 1, 2000)), '[\p{{L}}\p{{N}}]+')) as ws from {p}hy join documents d on d.doc_id = id),
{p}cd as (select term, count(*) as df from (select unnest(ws) as term from {p}cand) group by term),
{p}wt as (select query_id, term, ln(1 + (select count(*) from {p}cand) / (coalesce(df, 0) + 1.0::double)) as w from {p}qt left join {p}cd using (term)),
{p}rr as (select query_id, id, any_value(text) as text, coalesce(sum(w) filter (list_contains(ws, term)), 0) / sum(w) as score from {p}cand join {p}wt using (query_id) group by query_id, id),
{p}top as (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from {p}rr qualify rank <= 5)"""


_ASKED = """e as (select vec_id, label % 5 as tenant, embedding::double[] as e, timestamp '2024-01-01' + to_hours((vec_id % 400)::int) as created from embeddings),
q as (select item_id as query_id, case when item_id % 7 = 0 then text || ' compare' when item_id % 5 = 1 then left(text, 12) else text end as text, e.e, tenant, item_id % 20 as session from benchmark left join e on vec_id = item_id)"""
_BRANCHES = rf"""near as (select query_id, vec_id as hit, round(list_inner_product(q.e, e.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(e.e, e.e))), 6) as s
  from q join e on e.tenant = q.tenant and vec_id <> query_id and created <= timestamp '2024-01-12' and created > timestamp '2024-01-12' - interval 7 days),
hits as (select query_id, hit from near where s >= 0.3 qualify row_number() over (partition by query_id order by s desc, hit) = 1),
miss as (select *, (regexp_matches(lower(text), '\b(i|you|he|she|it|we|they|this|that|these|those|what|which)\b') or (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 6 and length(text) < 30))
  and length(text) % 2 = 0 and session in (select conv_id from conversations) as again from q anti join hits using (query_id)),
shown as (select query_id, e, again, case when again then text || ' again' else text end as q from miss),
marked as (select query_id, e, again, q, regexp_matches(b, '(?i)\b({_EN})\b') as has_pronoun, regexp_matches(q, '(?i)({_HOP})') as is_multi_hop,
  len(list_distinct(regexp_extract_all(b, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}\b')))::int as entity_count, length(q)::int as query_length from (select *, {_BOUNDED} as b from shown)),
routed as (select query_id, e, again, q as text, case length(q) % 6 when 5 then 'beyond_kb' when 4 then 'simple' else {_HINT} end as complexity, case length(q) % 6 when 5 then 0.95::double when 4 then 0.9 else 0.5 end as score from marked),
direct as (select query_id, text, e, 30 as k from routed where complexity = 'simple'),
first as (select query_id, text, e, case complexity when 'complex' then 90 else 60 end as k from routed where complexity in ('moderate', 'complex'))"""
_SECOND = rf"""second as (select query_id, first.text || ' ' || array_to_string((regexp_extract_all(lower(a_top.text), '[\p{{L}}\p{{N}}]+'))[1:10], ' ') as text, e, k from first join a_top using (query_id) where k = 90 and a_top.rank = 1)"""


@query(
    "orchestrated",
    f"""with {_ASKED}, {_BRANCHES}, {_CORPUS}, {searched("d_", "direct")}, {searched("a_", "first")}, {_SECOND}, {searched("b_", "second")},
cited as (select query_id, 0 as round, rank, id from d_top union all select query_id, 0, rank, id from a_top union all select query_id, 1, rank, id from b_top),
lists as (select query_id, string_agg(id, ',' order by round, rank) as citations from cited group by query_id)
select query_id, 'cache' as branch, hit::varchar as hit, null as complexity, false as was_rewritten, 'cached ' || hit as citations, 'medium' as confidence, 0 as rounds from hits
union all select query_id, case complexity when 'simple' then 'direct' when 'beyond_kb' then 'beyond_kb' else 'agent' end, null, complexity, again, coalesce(citations, ''),
  case complexity when 'beyond_kb' then 'high' when 'simple' then case when score >= 0.85 then 'high' else 'low' end else 'medium' end,
  case complexity when 'simple' then 1 when 'beyond_kb' then 0 when 'complex' then case when query_id in (select query_id from second) then 2 else 1 end else 1 end
from routed left join lists using (query_id)""",
)
def _(t):
    from corpusloom.plans import orchestrate

    at = F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(vec_id % 400 as int))")
    known = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") % 5).alias("tenant_id"), F.col("embedding").alias("vec"), at.alias("created_at"))
    quote = F.array(F.struct(F.concat(F.lit("cached "), F.col("id")).alias("doc_id"), F.lit("").alias("chunk_id"), F.lit("").alias("quote"), F.lit(0.0).alias("score")))
    cache = known.withColumns({"answer": F.concat(F.lit("answer "), F.col("id")), "citations": quote, "confidence": F.lit("medium")})
    item = F.col("item_id")
    text = F.when(item % 7 == 0, F.concat("text", F.lit(" compare"))).when(item % 5 == 1, F.left("text", F.lit(12))).otherwise(F.col("text"))
    asked = t.benchmark.join(known.drop("created_at"), item == F.col("id"), "left").select(item.alias("query_id"), text.alias("text"), "vec", "tenant_id", (item % 20).alias("session_id"), F.expr("timestamp'2024-01-12'").alias("asked_at"))
    size = lambda c: F.length(c) % 6
    route = lambda c: F.when(size(c) == 5, '{"complexity": "beyond_kb", "confidence": 0.95}').when(size(c) == 4, '{"complexity": "simple", "confidence": 0.9}')
    again = lambda c, past: F.to_json(F.struct(F.concat(c, F.lit(" again")).alias("rewritten"), F.when(F.length(c) % 2 == 0, 0.9).otherwise(0.5).alias("confidence")))
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "source")
    corpus = known.select("id", "vec").join(docs.select("id"), "id", "left_semi")
    out = orchestrate.orchestrate(asked, orchestrate.searching(docs, corpus), cache=cache, history=t.conversations, models=orchestrate.Models(rewrite=again, route=route), least=0.3)
    cited = F.array_join(F.transform("citations", lambda c: c["doc_id"]), ",")
    return out.select("query_id", "branch", "hit", "complexity", "was_rewritten", cited.alias("citations"), "confidence", "rounds")


#: Cases: each item's five best documents by BM25 are its contexts, cut as in a prompt; the answer is their beginning or
#: the item's; the truth is the item's text, which some cases lack.
_CASES = f"""{_BM25}, c0 as (select query_id, rank, left(text, 500) as text from bm25 join documents on doc_id = id where rank <= 5),
cases as (select item_id as case_id, split_part(b.text, '.', 1) as question, case when item_id % 3 = 0 then left(b.text, 120) else left((select text from c0 where query_id = item_id and rank = 1), 160) end as answer,
  (select list(text order by rank) from c0 where query_id = item_id) as contexts, case when item_id % 8 <> 7 then b.text end as truth from benchmark b)"""
_WORDS_OF = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_ALIGNED = rf"""ctx as (select case_id, unnest(range(0, len(contexts))) as pos, unnest(contexts) as text from cases),
parts as (select case_id, 'context' as part, pos, {_WORDS_OF.format("text")} as ws from ctx
  union all select case_id, 'answer', -1, {_WORDS_OF.format("coalesce(answer, '')")} from cases union all select case_id, 'truth', -1, {_WORDS_OF.format("coalesce(truth, '')")} from cases),
sent as (select case_id, 'answer' as sd, unnest(regexp_split_to_array(coalesce(answer, ''), '[.!?\n。！？]+')) as s from cases union all select case_id, 'truth', unnest(regexp_split_to_array(coalesce(truth, ''), '[.!?\n。！？]+')) from cases),
claims as (select case_id, sd, row_number() over () as claim, {_WORDS_OF.format("s")} as cw from sent where regexp_matches(s, '[\p{{L}}\p{{N}}]') union all select case_id, 'question', 0, {_WORDS_OF.format("question")} from cases),
pdf as (select term, count(*) as df from (select unnest(list_distinct(ws)) as term from parts where part = 'context') group by term),
ct as (select case_id, sd, claim, unnest(list_distinct(cw)) as term from claims),
cwt as (select case_id, sd, claim, list(struct_pack(t := term, w := ln(1 + (select count(*) from parts where part = 'context') / (1.0::double + coalesce(df, 0))))) as terms from ct left join pdf using (term) group by all),
pairs0 as (select *, list_sum(list_transform(list_filter(terms, lambda x: list_contains(ws, x.t)), lambda x: x.w)) as hit, list_sum(list_transform(terms, lambda x: x.w)) as al
  from claims join parts using (case_id) left join cwt using (case_id, sd, claim) where (sd <> 'question' and part <> sd) or (sd = 'question' and part = 'answer')),
pairs as (select *, coalesce(coalesce(hit, 0) / al, 0) as held, case when sd = 'question' then 0 else list_reduce(list_transform(cw, lambda w: list_transform(ws, lambda y: (w = y)::int)),
  lambda above, m: list_transform([list_transform(range(1, len(m) + 1), lambda j: greatest(above[j + 1], case when m[j] = 1 then above[j] + 1 else 0 end))], lambda c: list_prepend(0, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))))[1],
  list_transform(range(0, len(ws) + 1), lambda z: 0))[-1] / len(cw)::double end as inorder from pairs0),
lev as (select *, case when sd = 'question' then held else (held + inorder) / 2 end as level from pairs),
bst as (select case_id, sd, part, claim, max(level) as level from lev where sd <> 'question' group by all),
shr as (select case_id, sd, part, avg((round(level, 9) >= 0.5::double)::int) as share from bst group by all),
sh as (select case_id, max(share) filter (sd = 'answer' and part = 'context') as faithful, max(share) filter (sd = 'truth' and part = 'context') as recall, max(share) filter (sd = 'answer' and part = 'truth') as p, max(share) filter (sd = 'truth' and part = 'answer') as r from shr group by case_id),
fit as (select case_id, pos, (round(max(level), 9) >= 0.5::double)::int as fits from lev join cases using (case_id) where part = 'context' and sd = case when trim(coalesce(truth, '')) <> '' then 'truth' else 'answer' end group by all),
cum as (select *, sum(fits) over (partition by case_id order by pos) as hits, row_number() over (partition by case_id order by pos) as k from fit),
prec as (select case_id, sum(fits * hits / k::double) / nullif(sum(fits), 0) as prec from cum group by case_id),
m as (select case_id, case when exists (select 1 from claims c where c.case_id = cases.case_id and sd = 'answer') then coalesce(faithful, 0) end as faithfulness,
  coalesce((select held from lev where sd = 'question' and lev.case_id = cases.case_id), 0) as answer_relevancy, coalesce(prec, 0) as context_precision,
  case when trim(coalesce(truth, '')) <> '' then coalesce(recall, 0) end as context_recall, case when trim(coalesce(truth, '')) <> '' then coalesce(2 * p * r / nullif(p + r, 0), 0) end as answer_correctness
  from cases left join sh using (case_id) left join prec using (case_id)),
s as (unpivot m on faithfulness, answer_relevancy, context_precision, context_recall, answer_correctness into name metric value score)"""
_LIMITS = "(values ('faithfulness', 0.85::double), ('answer_relevancy', 0.75), ('context_precision', 0.70), ('context_recall', 0.70), ('answer_correctness', 0.80)) l(metric, threshold)"
_REPORTED = f"""c as (select case_id, bool_and(round(score, 9) >= threshold) as passed, avg(score) as mean, arg_min(metric, (round(score, 9), metric)) as weakest from s join {_LIMITS} using (metric) group by case_id),
g as (select metric, any_value(threshold) as threshold, avg(score) as mean from s join {_LIMITS} using (metric) group by metric)"""


def _aligned(t):
    from corpusloom.operators import alignment, retrieve

    best = retrieve.bm25(_bench(t).select("query_id", "text"), _docs(t), 5).select("query_id", "id", "rank")
    found = best.join(_docs(t).select("id", F.left("text", F.lit(500)).alias("text")), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("f"))
    rows = t.benchmark.join(found, F.col("item_id") == F.col("query_id"), "left")
    item, contexts = F.col("item_id"), F.transform("f", lambda x: x["text"])
    first = F.filter("f", lambda x: x["rank"] == 1)[0]["text"]
    answer = F.when(item % 3 == 0, F.left("text", F.lit(120))).otherwise(F.left(first, F.lit(160)))
    cases = rows.select(item.alias("case_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("question"), answer.alias("answer"), contexts.alias("contexts"), F.when(item % 8 != 7, F.col("text")).alias("truth"))
    return alignment.scores(cases)


def _rounded(t):
    from corpusloom.operators import alignment

    rows = alignment.long(_aligned(t)).where("score is not null")
    return rows.withColumn("score", F.round("score", 9))


@query("answer_metrics", f"with {_CASES}, {_ALIGNED} select case_id, round(faithfulness, 5) as faithfulness, round(answer_relevancy, 5) as answer_relevancy, round(context_precision, 5) as context_precision, round(context_recall, 5) as context_recall, round(answer_correctness, 5) as answer_correctness from m")
def _(t):
    from corpusloom.operators import alignment

    return _aligned(t).select("case_id", *[F.round(c, 5).alias(c) for c in alignment.METRICS])


@query("answer_case_report", f"with {_CASES}, {_ALIGNED}, {_REPORTED} select case_id, passed, round(mean, 5) as mean, weakest from c")
def _(t):
    from corpusloom.operators import evaluate

    return evaluate.case_report(_rounded(t)).withColumn("mean", F.round("mean", 5))


@query("answer_report", f"""with {_CASES}, {_ALIGNED}, {_REPORTED} select (select count(*) from c) as total, (select count(*) from c where passed) as passed, (select count(*) filter (passed) / count(*) from c) as pass_rate,
  round((select avg(mean) from c), 5) as mean, (select bool_or(mean < threshold) from g) as regression, (select arg_min(metric, mean) from g) as weakest""")
def _(t):
    from corpusloom.operators import evaluate

    return evaluate.batch_report(_rounded(t)).withColumn("mean", F.round("mean", 5))


@query("bm25_indexed", f"with {_BM25} select query_id, id, round(score, 4) as score, rank::int as rank from bm25")
def _(t):
    from corpusloom.operators import inverted

    index = inverted.Index.build(_docs(t))
    return index.search(_bench(t).select("query_id", "text")).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query("dense_indexed", f"with {_DENSE} select query_id, id, round(score, 4) as score, rank::int as rank from dense")
def _(t):
    from corpusloom.operators import cells

    return cells.Cells.build(_vecs(t)).search(_bench(t)).select("query_id", "id", F.round("score", 4).alias("score"), "rank")
