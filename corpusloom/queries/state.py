"""Queries over the registry, chat, cache, evaluation, metrics and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import calc
from corpusloom.operators import evaluate, metrics, registry
from corpusloom.queries.corpus import _BM25, _bench, _docs
from corpusloom.queries.registry import query
from corpusloom.streaming import state, windows

#: Versions of registry records: one for each event, by user.
_VERSIONS = """v as (select user_id as file_id, 't' || user_id % 5 as tenant_id, ts as version, event_id, case event_type when 'error' then 'failed' when 'purchase' then 'indexed' when 'signup' then 'queued' else 'processing' end as status, value as size from events),
r as (select * from v qualify row_number() over (partition by file_id order by version desc, event_id desc) = 1)"""


def _versions(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "signup", "queued").otherwise("processing")
    return t.events.select(F.col("user_id").alias("file_id"), F.expr("'t' || user_id % 5").alias("tenant_id"), F.col("ts").alias("version"), "event_id", status.alias("status"), F.col("value").alias("size"))


def _records(t):
    return registry.latest(_versions(t), ["file_id"], "version", "event_id")


@query("registry_latest", f"with {_VERSIONS} select file_id, tenant_id, event_id, status, size from r")
def _(t):
    return _records(t).select("file_id", "tenant_id", "event_id", "status", "size")


@query("registry_update", f"with {_VERSIONS}, u as (select c_custkey as id, case when c_custkey % 3 = 0 then 'indexed' end as status, case when c_custkey % 2 = 0 then null else c_acctbal end as size from customer) select file_id, coalesce(u.status, r.status) as status, coalesce(u.size, r.size) as size from r left join u on id = file_id")
def _(t):
    ups = t.customer.select(F.col("c_custkey").alias("file_id"), F.when(F.col("c_custkey") % 3 == 0, "indexed").alias("status"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal")).alias("size"))
    return registry.updated(_records(t), ups, "file_id", ["status", "size"]).select("file_id", "status", "size")


@query("registry_get", f"with {_VERSIONS} select file_id, status from r where file_id = 42")
def _(t):
    return _records(t).where("file_id = 42").select("file_id", "status")


@query("registry_list", f"with {_VERSIONS} select file_id, tenant_id from r where tenant_id = 't2' and status = 'processing' order by file_id limit 10")
def _(t):
    return registry.of_tenant(_records(t), "t2", "file_id", "processing", limit=10).select("file_id", "tenant_id")


@query("registry_page", f"with {_VERSIONS} select file_id, status from r where tenant_id = 't1' order by file_id limit 10 offset 5")
def _(t):
    return registry.of_tenant(_records(t), "t1", "file_id", skip=5, limit=10).select("file_id", "status")


@query("chat_last_n", "with m as (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) select conv_id, turn, role, (row_number() over (partition by conv_id order by turn))::int as pos from m where rn between 2 and 5")
def _(t):
    return registry.last_messages(t.conversations, 4, 1).select("conv_id", "turn", "role", F.col("at").alias("pos"))


_PAST = "list(text) over (partition by conv_id order by turn rows between {} preceding and 1 preceding)"


@query("history_context", f"select conv_id, turn, md5(coalesce(array_to_string({_PAST.format(3)}, '|'), '')) as rewrite, md5(coalesce(array_to_string({_PAST.format(2)}, '|'), '')) as route from conversations")
def _(t):
    h = lambda c: F.md5(F.array_join(c, "|").cast("binary"))
    return registry.history(t.conversations).select("conv_id", "turn", h("for_rewrite").alias("rewrite"), h("for_route").alias("route"))


@query("rewrite_cache_key", f"with h as (select conv_id, turn, text, coalesce({_PAST.format(3)}, []) as h from conversations) select conv_id, turn, md5(text || '|' || coalesce(array_to_string(list_transform(h, lambda x: x || '|'), ''), '')) as cache_key from h")
def _(t):
    return registry.history(t.conversations).select("conv_id", "turn", "cache_key")


_CACHE = """e as (select vec_id, label % 5 as tenant, embedding::double[] as e, timestamp '2024-01-01' + to_hours((vec_id % 400)::int) as created from embeddings),
q as (select vec_id as query_id, tenant, e as v, timestamp '2024-01-12' as asked from e where vec_id % 20 = 0),
s as (select query_id, vec_id as id, round(list_inner_product(v, e) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(e, e))), 6) as s from q join e on e.tenant = q.tenant and vec_id <> query_id and created <= asked and created > asked - interval 7 days)"""


@query("semantic_cache_lookup", f"with {_CACHE} select query_id, id as hit, round(s, 4) as similarity from s where s >= 0.3 qualify row_number() over (partition by query_id order by s desc, id) = 1")
def _(t):
    at = F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(vec_id % 400 as int))")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") % 5).alias("tenant_id"), F.col("embedding").alias("vec"), at.alias("created_at"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "tenant_id", F.transform("vec", lambda x: x).alias("vec"), F.expr("timestamp'2024-01-12'").alias("asked_at"))
    found = registry.cache_lookup(asked, rows, 0.3, others=True)
    return found.select("query_id", "hit", F.round("similarity", 4).alias("similarity"))


@query("cache_stats", "select event_type, count(*) filter (value > 50) as hits, count(*) filter (value <= 50) as misses, round(coalesce(count(*) filter (value > 50) / nullif(count(*), 0), 0), 6) as hit_rate from events group by event_type")
def _(t):
    rows = t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count_if(F.col("value") <= 50).alias("misses"))
    return rows.withColumn("hit_rate", F.round(metrics.hit_rate(F.col("hits"), F.col("misses")), 6))


@query("ttl_valid", "select event_id, ts > timestamp '2024-01-20' - interval 7 days as cached, ts > timestamp '2024-01-20' - interval 30 days as kept from events")
def _(t):
    now = F.expr("timestamp_ntz'2024-01-20'")
    return t.events.select("event_id", registry.alive(F.col("ts"), now, 7).alias("cached"), registry.alive(F.col("ts"), now, 30).alias("kept"))


_GOLD = "g as (select item_id, case item_id % 3 when 0 then 'factual' when 1 then 'multi_hop' else 'summary' end as category, case item_id % 2 when 0 then 'simple' else 'complex' end as query_type, text from benchmark)"


def _golden(t):
    category = F.element_at(F.array(F.lit("factual"), F.lit("multi_hop"), F.lit("summary")), (F.col("item_id") % 3 + 1).cast("int"))
    return t.benchmark.select("item_id", category.alias("category"), F.when(F.col("item_id") % 2 == 0, "simple").otherwise("complex").alias("query_type"), "text")


@query("golden_by_category", f"with {_GOLD} select item_id, query_type, text from g where category = 'multi_hop'")
def _(t):
    return _golden(t).where("category = 'multi_hop'").select("item_id", "query_type", "text")


@query("golden_summary", f"with {_GOLD} select category, query_type, count(*) as n from g group by grouping sets ((category), (query_type), ())")
def _(t):
    rows = _golden(t)
    return rows.groupingSets([["category"], ["query_type"], []], "category", "query_type").agg(F.count("*").alias("n"))


_REL = "rel as (select distinct b.item_id as query_id, d.doc_id as id from benchmark b join documents d on contains(d.text, b.text))"
_IR = f"""with {_BM25}, {_REL}, n as (select query_id, count(*) as n from rel group by query_id),
h as (select query_id, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from bm25 semi join rel using (query_id, id) where rank <= 10 group by query_id)
select query_id, $columns from n left join h using (query_id)"""


def _ir(t):
    rel = evaluate.containing(_docs(t), t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")))
    from corpusloom.operators import retrieve

    ranked = retrieve.bm25(_bench(t).select("query_id", "text"), _docs(t)).select("query_id", "id", "rank")
    return evaluate.ir_metrics(ranked, rel)


@query("ir_metrics", _IR.replace("$columns", "coalesce(hits, 0) / 10.0::double as precision, coalesce(hits, 0) / n as recall, round(coalesce(1.0::double / first, 0), 6) as mrr"))
def _(t):
    return _ir(t).select("query_id", "precision", "recall", F.round("mrr", 6).alias("mrr"))


@query("ndcg_at_10", _IR.replace("$columns", "round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg"))
def _(t):
    return _ir(t).select("query_id", F.round("ndcg", 6).alias("ndcg"))


_NAMES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
_SCORES = """s as (select e.user_id as case_id, m.metric, m.threshold, case when m.k >= 4 and e.user_id % 3 = 0 then null else round(avg((e.event_id * m.k % 37 + 63) / 100.0::double), 6) end as score
from events e, (values (1, 'faithfulness', 0.85), (2, 'answer_relevancy', 0.75), (3, 'context_precision', 0.70), (4, 'context_recall', 0.70), (5, 'answer_correctness', 0.80)) m(k, metric, threshold) group by e.user_id, m.k, m.metric, m.threshold),
c as (select case_id, coalesce(bool_and(score >= threshold), false) as passed, avg(score) as mean, min(struct_pack(s := score, m := metric)) filter (score is not null) as w from s group by case_id),
m as (select metric, any_value(threshold) as threshold, avg(score) as mean from s group by metric)"""


def _scores(t):
    # sums in the order of the events, so that they don't depend on the partitions; the last row has the whole sum
    order = Window.partitionBy("user_id").orderBy("event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum((F.col("event_id") * k % 37 + 63) / F.lit(100.0)).over(upto).alias(f"s{k}") for k in range(1, len(_NAMES) + 1)]
    rows = t.events.select("user_id", *sums, F.count("event_id").over(upto).alias("n"), F.lead(F.lit(1)).over(order).isNull().alias("last"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("metric"), F.col(f"s{k}").alias("s")) for k, m in enumerate(_NAMES, 1)])
    out = rows.where("last").select(F.col("user_id").alias("case_id"), "n", F.explode(parts).alias("m")).select("case_id", "n", "m.*")
    score = calc.rounded(F.try_divide("s", "n"), 6)
    return out.select("case_id", "metric", F.when((F.col("k") >= 4) & (F.col("case_id") % 3 == 0), F.lit(None)).otherwise(score).alias("score"))


@query("eval_case_report", f"with {_SCORES} select case_id, passed, round(mean, 4) as mean, w.m as weakest from c")
def _(t):
    return evaluate.case_report(_scores(t)).withColumn("mean", calc.rounded(F.col("mean"), 4))


_REPORT = "select (select count(*) from c) as total, (select count(*) from c where passed) as passed, (select count(*) filter (passed) / count(*) from c) as pass_rate, round((select avg(mean) from c), 5) as mean, (select bool_or(mean < threshold) from m) as regression, (select arg_min(metric, mean) from m) as weakest"


@query("eval_report", f"with {_SCORES} {_REPORT}")
def _(t):
    return evaluate.batch_report(_scores(t)).withColumn("mean", F.round("mean", 5))


@query("ci_verdict", f"with {_SCORES}, r as ({_REPORT}) select pass_rate, regression, pass_rate < 0.8 or regression as fails from r")
def _(t):
    return evaluate.ci_fails(evaluate.batch_report(_scores(t))).select("pass_rate", "regression", "fails")


#: Evaluation runs: one for each day and type of events.
_RUNS = "r as (select event_type || '@' || strftime(ts, '%Y-%m-%d') as run_id, event_type as prompt_hash, min(ts) as started_at, round(avg(value) / 100, 6) as avg_faithfulness, round(avg(value % 10) / 10, 6) as avg_answer_relevancy, round(count(*) filter (value > 20) / count(*), 6) as pass_rate from events group by event_type, strftime(ts, '%Y-%m-%d'))"


def _runs(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.groupBy("event_type", day.alias("day")).agg(F.min("ts").alias("started_at"), F.round(F.avg("value") / 100, 6).alias("avg_faithfulness"), F.round(F.avg(F.col("value") % 10) / 10, 6).alias("avg_answer_relevancy"), F.round(F.count_if(F.col("value") > 20) / F.count("*"), 6).alias("pass_rate")).select(F.concat_ws("@", "event_type", "day").alias("run_id"), F.col("event_type").alias("prompt_hash"), "started_at", "avg_faithfulness", "avg_answer_relevancy", "pass_rate")


_METRICS = ["avg_faithfulness", "avg_answer_relevancy", "pass_rate"]


@query("eval_diff_gate", f"with {_RUNS}, p as (select *, lag(run_id) over w as previous_id, lag(avg_faithfulness) over w - avg_faithfulness > 0.05::double as a, lag(avg_answer_relevancy) over w - avg_answer_relevancy > 0.05::double as b, lag(pass_rate) over w - pass_rate > 0.05::double as c from r window w as (partition by prompt_hash order by started_at, run_id)) select run_id, previous_id, not (coalesce(a, false) or coalesce(b, false) or coalesce(c, false)) as passed, concat_ws(',', case when a then 'avg_faithfulness' end, case when b then 'avg_answer_relevancy' end, case when c then 'pass_rate' end) as failed from p")
def _(t):
    return evaluate.diff_gate(_runs(t), _METRICS).withColumn("failed", F.array_join("failed", ","))


@query("eval_samples_norm", "select event_id, substr(repeat(event_type, 600), 1, 2000) = left(repeat(event_type, 600), 2000) as same, length(substr(repeat(event_type, 600), 1, 2000)) as n, coalesce(case when event_id % 4 = 0 then null else value end, 0) as score from events")
def _(t):
    rows = t.events.select("event_id", F.repeat("event_type", F.lit(600)).alias("query"), F.col("event_type").alias("answer"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("score"), "event_type")
    out = evaluate.normalized_samples(rows, ["score"])
    return out.select("event_id", (F.col("query") == F.left(F.repeat("event_type", F.lit(600)), F.lit(2000))).alias("same"), F.length("query").cast("long").alias("n"), "score")


@query("run_samples", f"with {_RUNS} select run_id, count(*) as n, round(sum(value), 2) as total from r join events e on r.run_id = e.event_type || '@' || strftime(e.ts, '%Y-%m-%d') group by run_id")
def _(t):
    key = F.concat_ws("@", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    rows = _runs(t).select("run_id").join(t.events.select(key.alias("run_id"), "value"), "run_id")
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("latest_runs", f"with {_RUNS} select run_id, started_at from r order by started_at desc, run_id limit 10")
def _(t):
    return _runs(t).orderBy(F.col("started_at").desc(), "run_id").limit(10).select("run_id", "started_at")


@query("run_delta", f"with {_RUNS} select run_id, round(pass_rate - lag(pass_rate) over (partition by prompt_hash order by started_at), 5) as delta, first_value(run_id) over (partition by prompt_hash order by started_at) as first_run from r")
def _(t):
    by = Window.partitionBy("prompt_hash").orderBy("started_at")
    return _runs(t).select("run_id", F.round(F.col("pass_rate") - F.lag("pass_rate").over(by), 5).alias("delta"), F.first("run_id").over(by).alias("first_run"))


@query("samples_since", "select event_id, ts from events where ts >= timestamp '2024-01-20' order by ts, event_id limit 500")
def _(t):
    return t.events.where("ts >= timestamp_ntz'2024-01-20'").orderBy("ts", "event_id").limit(500).select("event_id", "ts")


@query("online_averages", "select count(*) as n, round(avg(a), 4) as a, round(avg(b), 4) as b from (select case when event_id % 3 = 0 then null else value end as a, case when event_id % 5 = 0 then null else value * 2 end as b from events order by ts desc, event_id desc limit 1000)")
def _(t):
    rows = t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event_id") % 3 != 0, F.col("value"))), 4).alias("a"), F.round(F.avg(F.when(F.col("event_id") % 5 != 0, F.col("value") * 2)), 4).alias("b"))


@query("online_sample", "select event_id from events where ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint % 100 < 5")
def _(t):
    return evaluate.sampled(t.events, "event_id", 5).select("event_id")


_LES = "(values ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1), ('2.0', 2), ('5.0', 5), ('10.0', 10), ('20.0', 20), ('30.0', 30), ('+Inf', 'inf'::double)) b(le, bound)"


@query("latency_histogram", f"select event_type, le, count(*) filter (value <= bound) as n from events, {_LES} group by event_type, le")
def _(t):
    return metrics.histogram(t.events, "value", ["event_type"], metrics.LATENCY_BUCKETS)


@query("counter_by_label", "select event_type, user_id % 3 as shard, count(*) as n from events group by all")
def _(t):
    return metrics.counters(t.events.withColumn("shard", F.col("user_id") % 3), ["event_type", "shard"])


@query("latency_quantiles", "select time_bucket(interval 1 day, ts) as start, count(*) as n, round(quantile_cont(value, 0.5), 5) as p50, round(quantile_cont(value, 0.95), 5) as p95, round(quantile_cont(value, 0.99), 5) as p99 from events group by 1")
def _(t):
    out = metrics.quantiles(t.events, "value", "ts", "1 day", exact=True)
    return out.select("start", "n", *[F.round(c, 5).alias(c) for c in ("p50", "p95", "p99")])


_COUNT_LES = "(values (1), (2), (5), (10), (20), (50), (100), ('inf'::double)) b(le)"


def _interpolated(q):
    return f"""round(case when list_filter(b, lambda x: x.n >= {q} * total)[1].le = 'inf'::double then 100 else coalesce(list_filter(b, lambda x: x.n < {q} * total)[-1].le, 0)
  + (list_filter(b, lambda x: x.n >= {q} * total)[1].le - coalesce(list_filter(b, lambda x: x.n < {q} * total)[-1].le, 0)) * ({q} * total - coalesce(list_filter(b, lambda x: x.n < {q} * total)[-1].n, 0))
  / (list_filter(b, lambda x: x.n >= {q} * total)[1].n - coalesce(list_filter(b, lambda x: x.n < {q} * total)[-1].n, 0)) end, 5)"""


@query("latency_quantiles_buckets", f"""with h as (select strftime(ts, '%Y-%m-%d') as day, event_type, le, count(*) filter (value / 3 <= le) as n from events, {_COUNT_LES} group by 1, 2, le),
g as (select day, event_type, max(n) as total, list(struct_pack(le := le::double, n := n::double) order by le) as b from h group by 1, 2)
select day, event_type, total as n, {_interpolated("0.5::double")} as p50, {_interpolated("0.95::double")} as p95, {_interpolated("0.99::double")} as p99 from g""")
def _(t):
    rows = t.events.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "third": F.col("value") / 3})
    out = metrics.bucket_quantiles(metrics.histogram(rows, "third", ["day", "event_type"], metrics.COUNT_BUCKETS), ["day", "event_type"])
    return out.select("day", "event_type", "n", *[F.round(c, 5).alias(c) for c in ("p50", "p95", "p99")])


@query("error_rate_5m", "select time_bucket(interval 5 minutes, ts) as start, event_type, count(*) as n, round(count(*) / 300.0::double, 8) as per_second from events where event_type = 'error' group by 1, 2")
def _(t):
    return metrics.rates(t.events.where("event_type = 'error'"), "ts", ["event_type"])


@query("failure_streaks", "with e as (select *, event_type in ('error', 'view') as bad, sum(case when event_type in ('error', 'view') then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events) select user_id, min(ts) as start, count(*) as length from e where bad group by user_id, island")
def _(t):
    return windows.failure_streaks(t.events, "user_id", F.col("event_type").isin("error", "view"))


@query("rate_window", "select event_id, count(*) over (partition by user_id order by ts range between interval 60 minutes preceding and current row) as in_window from events")
def _(t):
    return windows.rate(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 3600).select("event_id", "in_window")


@query("win_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(t):
    return windows.tumbling(t.events, "1 hour", "event_type")


@query("win_sliding", "select b - to_hours(h::int) as start, count(*) as n from (select time_bucket(interval 1 hour, ts) as b from events), range(0, 3) r(h) group by 1")
def _(t):
    return windows.sliding(t.events, "3 hours", "1 hour")


@query("win_session", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, s")
def _(t):
    return windows.sessions(t.events, "30 minutes", "user_id")


@query("rate_limit_fold", """with recursive e as (select user_id, event_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, rn, t, true as ok, [t] as held from e where rn = 1 union all
select e.user_id, e.rn, e.t, len(list_filter(f.held, lambda x: x > e.t - 86400)) < 3, case when len(list_filter(f.held, lambda x: x > e.t - 86400)) < 3 then list_append(list_filter(f.held, lambda x: x > e.t - 86400), e.t) else list_filter(f.held, lambda x: x > e.t - 86400) end from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
select user_id, count(*) filter (ok) as accepted, count(*) as n from f group by user_id""")
def _(t):
    rows = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"))
    out = state.rate_limited(rows, "user_id", most=3, seconds=86400)
    return out.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count("*").alias("n"))


@query("stream_dedup", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def _(t):
    return windows.deduplicated(t.events, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("breaker_states", """with recursive e as (select user_id, event_id, floor(epoch(ts)) as t0, event_type = 'error' as failed, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as rn from events),
b as (select user_id, 0::bigint as rn, null::bigint as event_id, null::boolean as allowed, 'closed' as state, 0 as bad, 0 as good, 0 as tried, 0.0::double as since from (select distinct user_id from events) union all
select user_id, rn, event_id, not blocked, case when blocked then s when s = 'half_open' then case when failed then 'open' when g + 1 >= 2 then 'closed' else s end when failed and bad + 1 >= 2 then 'open' else s end,
  case when blocked then bad when s = 'half_open' then case when not failed and g + 1 >= 2 then 0 else bad end when failed and bad + 1 < 2 then bad + 1 else 0 end,
  case when blocked or s <> 'half_open' or failed then g else g + 1 end, case when blocked or s <> 'half_open' then t else t + 1 end,
  case when not blocked and failed and (s = 'half_open' or bad + 1 >= 2) then t0 else since end
from (select *, s = 'open' or s = 'half_open' and t >= 3 as blocked from (select e.user_id, e.rn, e.event_id, e.t0, e.failed, b.bad, b.since, case when b.state = 'open' and e.t0 - b.since >= 86400 then 'half_open' else b.state end as s,
  case when b.state = 'open' and e.t0 - b.since >= 86400 then 0 else b.good end as g, case when b.state = 'open' and e.t0 - b.since >= 86400 then 0 else b.tried end as t from b join e on e.user_id = b.user_id and e.rn = b.rn + 1)))
select user_id, event_id, allowed, state from b where rn > 0""")
def _(t):
    rows = t.events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return state.breaker_states(rows, "user_id", failures=2, recovery=86400)


@query("late_drop", "with m as (select event_id, ts, max(ts) over (order by event_id rows between unbounded preceding and 1 preceding) as seen from events) select event_id from m where ts >= seen - interval 10 days or seen is null")
def _(t):
    rows = windows.running_max(t.events, "event_id", "ts", "seen")
    return rows.where(F.col("seen").isNull() | (F.col("ts") >= F.col("seen") - F.expr("interval 10 days"))).select("event_id")


@query("sse_encode", "select 'data: ' || json_object('stage', event_type, 'id', event_id)::varchar || chr(10) || chr(10) as event from events")
def _(t):
    return windows.encoded(t.events.select(F.col("event_type").alias("stage"), F.col("event_id").alias("id")))


@query("run_upsert", """with o as (select user_id as run_id, min(event_id) as started, map {'origin': 'old'} as metadata from events group by user_id),
n as (select c_custkey as run_id, c_custkey * 10 as started, case when c_custkey % 3 = 0 then map {'prompt_hash': 'own'} else map {'origin': 'new'} end as metadata, 'h' || c_custkey as prompt_hash, case when c_custkey % 2 = 0 then '' else c_mktsegment end as git_commit from customer),
a as (select run_id, started, 'old' as origin, null as prompt_hash, null as git_commit from o where run_id not in (select run_id from n)
union all select run_id, started, case when run_id % 3 = 0 then null else 'new' end, case when run_id % 3 = 0 then 'own' else prompt_hash end, nullif(git_commit, '') from n)
select run_id, started, origin, prompt_hash, git_commit from a""")
def _(t):
    text = F.lit(None).cast("string")
    old = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("event_id").alias("started")).withColumns({"metadata": F.create_map(F.lit("origin"), F.lit("old")), "prompt_hash": text, "git_commit": text})
    key = F.col("c_custkey")
    meta = F.when(key % 3 == 0, F.create_map(F.lit("prompt_hash"), F.lit("own"))).otherwise(F.create_map(F.lit("origin"), F.lit("new")))
    new = t.customer.select(key.alias("run_id"), (key * 10).alias("started"), meta.alias("metadata"), F.concat(F.lit("h"), key).alias("prompt_hash"), F.when(key % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("git_commit"))
    rows = evaluate.stored_runs(old, new, ("prompt_hash", "git_commit"))
    return rows.select("run_id", "started", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("origin", "prompt_hash", "git_commit")])
