"""Queries over text functions, sources and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import calc, signals, text
from corpusloom.queries.registry import query

D, P, E = "documents", "pages", "events"


@query("token_count", r"""select doc_id, floor(length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) * 0.5::double
  + length(regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g')) * 0.25::double)::bigint as n_tokens from documents""")
def _(t):
    return t.documents.select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("doc_title", r"""with m as (select page_id, '## ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || 'x' as md, url from pages)
select page_id, case when page_id % 3 = 0 then url else regexp_extract(md, '^#+\s+([^\n]+)', 1) end as title from m""")
def _(t):
    md = F.concat(F.lit("## "), F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("\nx"))
    return t.pages.select("page_id", text.title(F.when(F.col("page_id") % 3 == 0, F.lit("plain\n# later")).otherwise(md), F.col("url")).alias("title"))


_MD = r"""regexp_replace(regexp_replace(html, '(?s)<h([1-6])[^>]*>([^<]*)</h[1-6]>', chr(10) || '@\1 \2' || chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"""


@query("doc_headings", rf"""with l as (select page_id, unnest(string_split({_MD}, chr(10))) as line, unnest(range(1, len(string_split({_MD}, chr(10))) + 1)) as pos from pages),
h as (select page_id, pos, regexp_extract(line, '^@([1-6])\s', 1)::int as level, regexp_extract(line, '^@[1-6]\s+(.+)$', 1) as txt from l where regexp_matches(line, '^@[1-6]\s+.+$'))
select page_id, count(*)::bigint as n_headings, string_agg(level || ':' || txt, '|' order by pos) as headings from h group by page_id""")
def _(t):
    md = F.col("html")
    for k in range(1, 7):
        md = F.regexp_replace(md, rf"(?s)<h{k}[^>]*>([^<]*)</h[1-6]>", "\n" + "#" * k + " $1\n")
    md = F.regexp_replace(md, r"(?s)<[^>]*>", "")
    rows = t.pages.select("page_id", text.headings(md).alias("h")).where(F.size("h") > 0)
    return rows.select("page_id", F.size("h").cast("long").alias("n_headings"), F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["level"], x["text"])), "|").alias("headings"))


@query("md_text_units", r"""with u as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') as u from documents)
select doc_id, len(u)::bigint as n_units, md5(array_to_string(u, '|')) as units from u""")
def _(t):
    rows = t.documents.select("doc_id", text.text_units(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("u"))
    return rows.select("doc_id", F.size("u").cast("long").alias("n_units"), F.md5(F.array_join("u", "|").cast("binary")).alias("units"))


@query("html_to_text", r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as txt from pages""")
def _(t):
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("txt"))


_URL = "case page_id % 4 when 0 then url || '.PDF' when 1 then url || '.md' when 2 then url || '.html' else url || '/x' end"


@query("ext_dispatch", rf"""with u as (select page_id, {_URL} as p from pages), e as (select page_id, lower(regexp_extract(p, '(\.[A-Za-z0-9]+)$', 1)) as ext from u)
select page_id, ext, case ext when '.pdf' then 'pdf' when '.md' then 'markdown' when '.html' then 'html' end as parser from e""")
def _(t):
    p = t.pages.select("page_id", F.expr(_URL).alias("p"))
    return p.select("page_id", text.extension(F.col("p")).alias("ext"), text.parser_of(F.col("p")).alias("parser"))


@query("char_ngrams", r"""with b as (select doc_id, regexp_replace(text, '\s+', '', 'g') as b from documents),
g as (select doc_id, case when length(b) >= 3 then list_transform(range(1, length(b) - 1), lambda i: b[i:i + 2]) else [] end as g from b)
select doc_id, len(g)::bigint as n_grams, len(list_distinct(g))::bigint as n_distinct from g""")
def _(t):
    rows = t.documents.select("doc_id", text.char_ngrams(F.col("text")).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_grams"), F.size(F.array_distinct("g")).cast("long").alias("n_distinct"))


@query("doc_id", "select doc_id, 'doc_' || substr(md5(source || ':' || doc_id), 1, 8) as doc_key from documents")
def _(t):
    return t.documents.select("doc_id", text.document_key(F.col("source"), F.col("doc_id").cast("string")).alias("doc_key"))


@query("content_hash", "select doc_id, sha256(text) as content_hash, substr(sha256(lang || '|' || source), 1, 12) as prompt_hash from documents")
def _(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.substring(text.content_hash(F.concat_ws("|", "lang", "source")), 1, 12).alias("prompt_hash"))


@query("uuid5", r"""with h as (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id::varchar)) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from h""")
def _(t):
    return t.documents.select("doc_id", text.uuid5(F.col("doc_id").cast("string")).alias("id"))


@query("size_category", "select doc_id, case when n_chars // 4 < 150 then 'tiny' when n_chars // 4 < 350 then 'small' when n_chars // 4 < 600 then 'medium' else 'large' end as category, nullif(n_chars % 5, 0) as elapsed from documents")
def _(t):
    return t.documents.select("doc_id", text.size_category(F.floor(F.col("n_chars") / 4)).alias("category"), text.status_or_null(F.col("n_chars") % 5).alias("elapsed"))


@query("url_parts", r"""select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) as path,
coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/:]+:([0-9]+)', 1), ''), '6379') as port from pages""")
def _(t):
    u = lambda part: F.coalesce(F.try_parse_url("url", F.lit(part)), F.lit(""))
    port = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/:]+:([0-9]+)", 1), F.lit("")), F.lit("6379"))
    return t.pages.select("page_id", u("PROTOCOL").alias("scheme"), u("HOST").alias("host"), u("PATH").alias("path"), port.alias("port"))


@query("date_parts", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:%M:%S') as clock,
floor(epoch(ts))::bigint as seconds, strftime(ts + interval 8 hour, '%Y-%m-%dT%H:%M:%S') as shanghai from events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    day = F.from_utc_timestamp(ts, "Asia/Shanghai")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "HH:mm:ss").alias("clock"), F.unix_timestamp(ts).alias("seconds"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("shanghai"))


@query("json_props", """select event_id, (props::json ->> '$.k')::bigint as k, json_object('type', event_type, 'id', event_id)::varchar as out from events""")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id"))).alias("out"))


_TENANT = "case doc_id % 5 when 0 then null when 1 then '  ' when 2 then ' ' || source else source end"


@query("tenant_norm", f"with t as (select doc_id, {_TENANT} as t from documents) select doc_id, case when trim(coalesce(t, '')) = '' then 'default' else t end as tenant, coalesce(nullif(trim(t), ''), 'default') as injected from t")
def _(t):
    rows = t.documents.select("doc_id", F.expr(_TENANT).alias("t"))
    return rows.select("doc_id", text.tenant_norm(F.col("t")).alias("tenant"), F.trim(text.tenant_norm(F.col("t"))).alias("injected"))


@query("tenant_sanitize", r"select doc_id, '_t' || coalesce(nullif(regexp_replace(source || case doc_id % 3 when 0 then '/é x-' when 1 then '_!' else '' end, '[^\p{L}\p{N}_-]', '', 'g'), ''), 'default') as suffix from documents")
def _(t):
    odd = F.when(F.col("doc_id") % 3 == 0, "/é x-").when(F.col("doc_id") % 3 == 1, "_!").otherwise("")
    return t.documents.select("doc_id", text.tenant_sanitized(F.concat("source", odd)).alias("suffix"))


@query("doc_summary_lead", r"select doc_id, trim(array_to_string(string_split(substr(text, 1, 8000), '. ')[1:2], '. ')) as summary from documents")
def _(t):
    return t.documents.select("doc_id", text.lead(F.col("text")).alias("summary"))


#: A word's bounds count letters of all scripts: other ones stand for them where bounds matter.
_BOUNDED = r"regexp_replace(regexp_replace(q, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_EN = "I|you|he|she|it|they|we|this|that|these|those|such|said"
_HOP = "and then|after|afterward|combine|compare|contrast|impact|relationship|cross|merge|synthesize"
_SIGNALS = rf"""s as (select doc_id, q, regexp_matches(b, '(?i)\b({_EN})\b') as has_pronoun, regexp_matches(q, '(?i)({_HOP})') as is_multi_hop,
  contains(q, '"') or contains(q, chr(39)) as has_quote, len(list_distinct(regexp_extract_all(b, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}\b')))::int as entity_count, length(q)::int as query_length
  from (select doc_id, q, {_BOUNDED} as b from (select doc_id, text || case doc_id % 7 when 0 then ' compare' when 1 then ' "x"' else '' end as q from documents)))"""
_HINT = "case when is_multi_hop and (entity_count >= 2 or query_length >= 30) then 'complex' when has_pronoun and query_length < 30 then 'moderate' when query_length <= 15 and entity_count <= 1 then 'simple' else 'moderate' end"


def _questions(t):
    q = F.concat("text", F.when(F.col("doc_id") % 7 == 0, " compare").when(F.col("doc_id") % 7 == 1, ' "x"').otherwise(""))
    rows = t.documents.select("doc_id", q.alias("q"))
    return rows.withColumns(signals.signals(F.col("q")))


@query("query_signals", f"with {_SIGNALS} select doc_id, has_pronoun, is_multi_hop, has_quote, entity_count, query_length from s")
def _(t):
    return _questions(t).drop("q")


def _hint():
    return signals.complexity_hint(*[F.col(c) for c in ("has_pronoun", "is_multi_hop", "entity_count", "query_length")])


@query("complexity_hint", f"with {_SIGNALS} select doc_id, {_HINT} as hint from s")
def _(t):
    return _questions(t).select("doc_id", _hint().alias("hint"))


@query("complexity_label", "select event_id, case when score is null then 'unknown' when score < 0.3 then 'simple' when score < 0.6 then 'moderate' else 'complex' end as label from (select event_id, case when event_id % 9 = 0 then null else (event_id % 100) / 100.0::double end as score from events)")
def _(t):
    score = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 100) / F.lit(100.0))
    return t.events.select("event_id", signals.complexity_label(score).alias("label"))


@query("confidence_map", "select event_id, case when s >= 0.85 then 'high' when s >= 0.6 then 'medium' when s >= 0.3 then 'low' else 'insufficient' end as level from (select event_id, (event_id % 100) / 100.0::double as s from events)")
def _(t):
    return t.events.select("event_id", signals.confidence_level((F.col("event_id") % 100) / F.lit(100.0)).alias("level"))


@query("needs_rewrite", r"""select conv_id, turn, regexp_matches(lower(text), '\b(i|you|he|she|it|we|they|this|that|these|those|what|which)\b')
  or (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 6 and length(text) < 30) as needs from conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", signals.needs_rewrite(F.col("text")).alias("needs"))


_REPLY = """case doc_id % 6 when 0 then null when 1 then 'no json' when 2 then '{"rewritten": "new", "confidence": 0.9}' when 3 then '{"rewritten": "new", "confidence": 0.5}' when 4 then '{"rewritten": "new"}' else '{"confidence": 0.95}' end"""


@query("rewrite_accept", f"""with r as (select doc_id, text as q, {_REPLY} as reply from documents),
p as (select *, case when reply is null or not json_valid(reply) then 0.0::double else coalesce((reply::json ->> '$.confidence')::double, 0.8) end as confidence from r),
o as (select doc_id, q, confidence, case when confidence < 0.7 then q else coalesce(reply::json ->> '$.rewritten', q) end as rewritten from p)
select doc_id, rewritten, rewritten <> q as was_rewritten, confidence from o""")
def _(t):
    return t.documents.select("doc_id", signals.rewrite_accepted(F.col("text"), F.expr(_REPLY)).alias("r")).select("doc_id", "r.*")


_ROUTE = """case doc_id % 6 when 0 then null when 1 then 'no json' when 2 then '{"complexity": "simple", "confidence": 0.4}' when 3 then '{"complexity": "moderate", "confidence": 0.3}' when 4 then '{"complexity": "odd", "confidence": 0.9}' else '{"complexity": "beyond_kb", "confidence": 0.2}' end"""


@query("route_escalate", f"""with {_SIGNALS}, r as (select doc_id, {_HINT} as hint, {_ROUTE} as reply from s),
p as (select *, reply::json ->> '$.complexity' as c, (reply::json ->> '$.confidence')::double as f from r where reply is not null and json_valid(reply)),
l as (select *, case when c in ('simple', 'moderate', 'complex', 'beyond_kb') then c else 'moderate' end as k from p)
select doc_id, hint as complexity, 0.5::double as confidence from r where reply is null
union all select doc_id, 'moderate', 0.0 from r where reply is not null and not json_valid(reply)
union all select doc_id, case when f < 0.6 and k = 'simple' then 'moderate' when f < 0.6 and k = 'moderate' then 'complex' else k end, f from l""")
def _(t):
    return _questions(t).select("doc_id", signals.route(F.expr(_ROUTE), _hint()).alias("r")).select("doc_id", "r.*")


_ERROR = "case event_id % 6 when 0 then 'HTTP 429 Too Many Requests' when 1 then 'Unauthorized: invalid API key' when 2 then 'read timed out' when 3 then 'schema mismatch' when 4 then null else 'odd ' || event_type end"


@query("error_class", f"""with m as (select event_id, lower({_ERROR}) as m from events)
select event_id, coalesce(regexp_matches(m, 'rate limit|rate_limit|ratelimit|too many requests|timeout|timed out|connection reset|temporarily|service unavailable|503|429'), false) as transient,
coalesce(regexp_matches(m, 'unauthorized|401|403|forbidden|invalid api key|invalid_api_key|bad request|400|valueerror|typeerror|validation error|schema'), false) as permanent from m""")
def _(t):
    return t.events.select("event_id", signals.error_class(F.expr(_ERROR)).alias("e")).select("event_id", "e.*")


@query("retry_bounds", "select event_id, least(2.0::double ** (event_id % 6), 10) * 0.5 as low, least(2.0::double ** (event_id % 6), 10) as mid, least(2.0::double ** (event_id % 6), 10) * 1.5 as high from events")
def _(t):
    return t.events.select("event_id", signals.retry_bounds(F.col("event_id") % 6).alias("b")).select("event_id", "b.*")


_ACTION = "case event_id % 5 when 0 then 'finish' when 1 then 'retrieve' when 2 then 'tool_call' when 3 then 'think' else 'odd' end"


@query("react_transition", f"""with a as (select event_id, {_ACTION} as action, (event_id % 20) / 20.0::double as conf, event_id % 7 as n, event_id % 2 = 0 as tools from events)
select event_id, case when action = 'finish' or conf >= 0.85 then 'finish' when n >= 5 then 'max_iter' when action = 'tool_call' and tools then 'tool' when action in ('retrieve', 'tool_call') then 'retrieve' else 'think' end as node from a""")
def _(t):
    e = F.col("event_id")
    return t.events.select("event_id", signals.react_next(F.expr(_ACTION), (e % 20) / F.lit(20.0), e % 7, e % 2 == 0).alias("node"))


_V = "case event_id % 3 when 0 then 'correct' when 1 then 'incorrect' else 'ambiguous' end"


@query("self_rag_verdict", f"""with a as (select event_id, {_V} as v, (event_id % 20) / 20.0::double as c, 'correct' as v2, case when event_id % 4 = 0 then null else (event_id % 11) / 11.0::double end as c2 from events),
r as (select *, not (v = 'correct' and c >= 0.85 or v = 'ambiguous') and coalesce(c2 > c, false) as refined from a)
select event_id, case when refined then v2 else v end as verdict, case when refined then c2 else c end as confidence, v = 'ambiguous' as hint, refined from r""")
def _(t):
    e = F.col("event_id")
    second = F.when(e % 4 != 0, (e % 11) / F.lit(11.0))
    return t.events.select("event_id", signals.self_rag(F.expr(_V), (e % 20) / F.lit(20.0), F.lit("correct"), second).alias("r")).select("event_id", "r.*")


@query("docx_text", r"""with l as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as units from documents)
select doc_id, len(units)::int as n_units, md5(array_to_string(units, chr(10) || chr(10))) as h from l""")
def _(t):
    from corpusloom.sources import docx

    files_ = t.documents.select("doc_id", docx.written("text").alias("content"))
    rows = files_.select("doc_id", docx.parsed(F.col("content")).alias("content"))
    return rows.select("doc_id", F.size(text.text_units(F.col("content"))).alias("n_units"), F.md5(F.col("content").cast("binary")).alias("h"))


@query("calc", "select event_id, (value + 3) * 2 - greatest(value, 5) / 4 + 2.0::double ** 3 as result, sqrt(abs(value)) as root from events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", calc.compiled("(value + 3) * 2 - max(value, 5) / 4 + 2 ** 3", value=v).alias("result"), calc.compiled("math.sqrt(abs(value))", value=v).alias("root"))


_SAID = """case conv_id % 5 when 0 then '{"answer": "' || turn || '", "citations": [1, 2], "confidence": "high"}' when 1 then '{"answer": "a", "confidence": "sure"}' when 2 then 'no json' when 3 then null else '{"answer": "b", "confidence": "low"}' end"""


@query("model_answer", f"""with r as (select conv_id, turn, text, {_SAID} as reply from conversations),
o as (select *, case when reply is not null and json_valid(reply) then reply end as j from r),
k as (select *, coalesce(trim(j::json ->> '$.answer') <> '' and (j::json ->> '$.confidence') in ('high', 'medium', 'low', 'insufficient'), false) as ok from o)
select conv_id, turn, case when ok then j::json ->> '$.answer' else text end as answer, case when ok and conv_id % 5 = 0 then 2 else 0 end as cited, case when ok then j::json ->> '$.confidence' else 'insufficient' end as confidence, ok from k""")
def _(t):
    from corpusloom.plans import model

    rows = model.asked(t.conversations.withColumn("reply_in", F.expr(_SAID)), "reply_in", lambda prompt: prompt, F.col("text"))
    return rows.select("conv_id", "turn", "reply.answer", F.size("reply.citations").alias("cited"), "reply.confidence", "reply.ok")


_THOUGHT = """case event_id % 5 when 0 then '{"action": "retrieve", "confidence": 0.7}' when 1 then '{"confidence": 0.9}' when 2 then 'no json' when 3 then null else '{"action": "finish"}' end"""


@query("think_step", f"""with r as (select event_id, {_THOUGHT} as reply, case event_id % 4 when 0 then 'retrieve' when 1 then 'calculator' end as called from events)
select event_id, case when reply is null or not json_valid(reply) then 'finish' else coalesce(reply::json ->> '$.action', 'think') end as action, case when reply is null or not json_valid(reply) then 0.0::double else coalesce((reply::json ->> '$.confidence')::double, 0.5) end as confidence,
case when called is null then 'finish' when called = 'retrieve' then 'retrieve' else 'tool_call' end as native_action, case when called is null then 0.8::double else 0.6::double end as native_confidence from r""")
def _(t):
    from corpusloom.plans import model

    called = F.when(F.col("event_id") % 4 == 0, "retrieve").when(F.col("event_id") % 4 == 1, "calculator")
    rows = t.events.select("event_id", model.thought(F.expr(_THOUGHT)).alias("a"), model.thought(F.lit(None), called).alias("b"))
    return rows.select("event_id", "a.action", "a.confidence", F.col("b.action").alias("native_action"), F.col("b.confidence").alias("native_confidence"))


@query("tool_call", """select event_id, case event_id % 4 when 0 then (event_id + user_id)::double::varchar when 1 then (event_id * 2)::double::varchar when 2 then strftime(ts, '%Y-%m-%d %A') else '未找到工具: odd' end as result from events""")
def _(t):
    from corpusloom.operators import tools

    k = F.col("event_id") % 4
    name = F.when(k <= 1, "calculator").when(k == 2, "datetime").otherwise("odd")
    argument = F.when(k == 0, F.concat_ws(" + ", "event_id", "user_id")).when(k == 1, F.concat(F.col("event_id"), F.lit("*2"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", tools.standard().call(name, argument).alias("result"))


@query("step_type", "select event_id, case event_type when 'view' then 'thought' when 'click' then 'action' when 'signup' then 'action' when 'purchase' then 'final' else 'thought' end as step from events")
def _(t):
    from corpusloom.operators import agent

    node = F.when(F.col("event_type") == "view", "think").when(F.col("event_type") == "click", "act").when(F.col("event_type") == "signup", "retrieve").when(F.col("event_type") == "purchase", "finish").otherwise(F.col("event_type"))
    return t.events.select("event_id", agent.step_type(node).alias("step"))


@query("retry_rule", "select event_id, event_id % 5 not in (0, 1, 2) and event_id % 4 < 2 as again, substr(repeat(event_type, 200), 1, 500) as error from events")
def _(t):
    from corpusloom.plans import model

    kind = F.element_at(F.array(*[F.lit(x) for x in ("ValueError", "TypeError", "KeyError", "TimeoutError", "ConnectionError")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", model.retries(kind, F.col("event_id") % 4).alias("again"), model.error_text(F.repeat("event_type", 200)).alias("error"))
