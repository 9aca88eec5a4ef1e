"""Queries: message mapping, segmentation, threads, participants, markers."""

from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.functions import textfn as tx
from threadloom.operators import conversations as cv
from threadloom.operators import mapping as mp
from threadloom.plans.catalog import query
from threadloom.plans.shared import MESSAGES_CTE, messages

_F = "yyyy-MM-dd HH:mm:ss"
_S = "'%Y-%m-%d %H:%M:%S'"


def _stream(t):
    """Events as messages: user = platform, event type = topic."""
    return t.events.select(F.col("event_id").alias("message_id"), F.col("user_id").cast("string").alias("platform"), "ts",
                           F.col("event_type").alias("topic"), "value")


_SEG = """m as (select event_id as message_id, user_id::varchar as platform, ts, event_type as topic, value from events),
l as (select *, lag(ts) over w as pts, lag(topic) over w as pt from m window w as (partition by platform order by ts, message_id)),
r as (select *, case when pts is null then 'first_message' when epoch_us(ts) - epoch_us(pts) > 7200000000 then 'time_gap' when topic <> pt then 'entity_change' end as reason from l),
s as (select *, reason is not null as is_new, sum((reason is not null)::int) over (partition by platform order by ts, message_id)::bigint as segment_no from r)"""


@query("event_segments", "WN-02", f"with {_SEG} select message_id, platform, segment_no, is_new, reason, 1.0 as similarity from s")
def _(t):
    s = cv.segment_messages(_stream(t), ["platform"])
    return s.select("message_id", "platform", "segment_no", "is_new", "reason", "similarity")


@query("cluster_summary", "AG-09 JN-02", f"""with {_SEG} select platform, segment_no, strftime(min(ts), {_S}) as start_ts, strftime(max(ts), {_S}) as end_ts, count(*) as message_count, arg_min(topic, ts) as topic from s group by all""")
def _(t):
    c = cv.cluster_summary(cv.segment_messages(_stream(t), ["platform"]), ["platform"])
    return c.withColumns({k: F.date_format(k, _F) for k in ("start_ts", "end_ts")})


@query("cluster_ids", "WN-03 TX-17", f"""with {_SEG}, c as (select platform, segment_no, min(ts) as st, arg_min(topic, ts) as topic from s group by all),
n as (select *, row_number() over (partition by substring(platform, 1, 4), strftime(st, '%y%m') order by st, platform, segment_no) as seq from c)
select platform, segment_no, upper(substring(platform, 1, 4)) || '_' || strftime(st, '%y%m') || '_' || rpad(substring(upper(topic), 1, 6), 6, 'X') || '_' ||
 repeat('0', greatest(3 - length(seq::varchar), 0)) || seq as cluster_id from n""")
def _(t):
    c = cv.cluster_summary(cv.segment_messages(_stream(t), ["platform"]), ["platform"])
    return cv.number_clusters(c, "platform").select("platform", "segment_no", "cluster_id")


@query("cluster_messages", "JN-02", f"with {_SEG} select message_id, value, segment_no, is_new, reason from s")
def _(t):
    m = _stream(t)
    return cv.assign_clusters(m.select("message_id", "value"), cv.segment_messages(m, ["platform"]))


@query("vector_segments", "WN-01 WN-02 WN-08", """with m as (select vec_id, label, embedding, timestamp '2024-01-01' + to_seconds(vec_id * 60) as ts from embeddings),
l as (select *, lag(embedding) over w as pe from m window w as (partition by label order by vec_id)),
r as (select *, case when pe is null then 1.0 else list_cosine_similarity(embedding::double[], pe::double[]) end as sim from l),
q as (select *, case when pe is null then 'first_message' when sim < 0.6 then 'topic_change' end as reason from r)
select vec_id as message_id, label, round(sim, 6) as similarity, reason, sum((reason is not null)::int) over (partition by label order by vec_id)::bigint as segment_no from q
where true""")
def _(t):
    m = t.embeddings.select(F.col("vec_id").alias("message_id"), "label", "embedding",
                            F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60).cast("timestamp_ntz").alias("ts"))
    s = cv.segment_messages(m, ["label"], topic=None, embedding="embedding", gap_seconds=10**9)
    return s.select("message_id", "label", F.round("similarity", 6).alias("similarity"), "reason", "segment_no")


@query("close_segments", "WN-08 WN-02", """with m as (select event_id as message_id, user_id, ts, [value, 20.0, (event_id % 7) * 10.0] as e from events),
l as (select *, lag(ts) over w as p, lag(e) over w as pe from m window w as (partition by user_id order by ts, message_id)),
d as (select *, case when p is null or epoch_us(ts) - epoch_us(p) > 14400000000 then 1.0 else list_cosine_similarity(e, pe) end as sim from l),
r as (select *, case when p is null then 'first_message' when epoch_us(ts) - epoch_us(p) > 14400000000 then 'time_gap' when sim < 0.85 then 'topic_change' end as reason from d)
select message_id, user_id, round(sim, 6) as similarity, reason, sum((reason is not null)::int) over (partition by user_id order by ts, message_id)::bigint as segment_no from r""")
def _(t):
    m = t.events.select(F.col("event_id").alias("message_id"), "user_id", "ts", F.array("value", F.lit(20.0), (F.col("event_id") % 7) * 10.0).alias("e"))
    s = cv.segment_messages(m, ["user_id"], topic=None, embedding="e", gap_seconds=4 * 3600, min_similarity=0.85)
    return s.select("message_id", "user_id", F.round("similarity", 6).alias("similarity"), "reason", "segment_no")


@query("turn_links", "WN-04 WN-05", f"""with {MESSAGES_CTE} select message_id, lag(message_id) over w as prev_id, lead(message_id) over w as next_id,
 epoch(ts)::bigint - epoch(lag(ts) over w)::bigint as seconds_since_prev, row_number() over w as serial_number from messages window w as (partition by conv_id order by turn)""")
def _(t):
    out = cv.turn_links(messages(t), ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000))
    return out.select("message_id", "prev_id", "next_id", "seconds_since_prev", "serial_number")


@query("thread_summary", "AG-10 TX-16", """with m as (select case when c_mktsegment <= o_orderpriority then c_mktsegment || '_' || o_orderpriority else o_orderpriority || '_' || c_mktsegment end as k, o_orderdate as ts from orders join customer on c_custkey = o_custkey)
select k as thread_key, count(*) as message_count, strftime(min(ts), '%Y-%m-%d') as start_ts, strftime(max(ts), '%Y-%m-%d') as end_ts from m group by 1""")
def _(t):
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("sender"), F.col("o_orderpriority").alias("recipient"), F.col("o_orderdate").alias("ts"))
    return cv.thread_summary(m).withColumns({k: F.date_format(k, "yyyy-MM-dd") for k in ("start_ts", "end_ts")})


@query("participants", "AG-11", f"with {MESSAGES_CTE} select distinct conv_id, sender as participant from messages")
def _(t):
    return cv.participants(messages(t), ["conv_id"], ["sender"])


@query("date_ranges", "AG-11 AG-30", f"with {MESSAGES_CTE} select conv_id, strftime(min(ts), {_S}) as start_ts, strftime(max(ts), {_S}) as end_ts from messages group by 1")
def _(t):
    return cv.date_range(messages(t), ["conv_id"]).withColumns({k: F.date_format(k, _F) for k in ("start_ts", "end_ts")})


@query("conversation_groups", "AG-12", "select event_type, user_id, count(*) as message_count from events group by all")
def _(t):
    return cv.conversation_groups(t.events, ["event_type", "user_id"]).select("event_type", "user_id", "message_count")


@query("conversations_by_participants", "JN-09", "select user_id from events where event_type in ('signup', 'purchase', 'error') group by 1 having count(distinct event_type) = 3")
def _(t):
    members = cv.participants(t.events, ["user_id"], ["event_type"])
    return cv.with_all_participants(members, "user_id", ["signup", "purchase", "error"])


@query("cross_platform_links", "JN-10 WN-02", """with m as (select event_id, ts, event_type as platform, case when user_id % 2 = 0 then '(555) 010-' || lpad(user_id::varchar, 4, '0') else ' User ' || user_id end as a, 'ME' as b from events),
n as (select *, case when length(regexp_replace(a, '[^0-9+]', '', 'g')) >= 7 then regexp_replace(a, '[^0-9+]', '', 'g') else lower(trim(a)) end as na from m),
k as (select *, case when na <= 'me' then na || '_me' else 'me_' || na end as pair from n),
l as (select *, lag(ts) over (partition by pair order by ts, event_id) as p from k),
s as (select *, sum((p is null or epoch_us(ts) - epoch_us(p) > 3600000000)::int) over (partition by pair order by ts, event_id) as seg from l)
select pair, seg::bigint as segment_no, count(*) as n, count(distinct platform) as n_platforms from s group by all""")
def _(t):
    who = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("(555) 010-"), F.lpad(F.col("user_id").cast("string"), 4, "0"))).otherwise(F.concat(F.lit(" User "), "user_id"))
    m = t.events.select(F.col("event_id").alias("message_id"), "ts", F.col("event_type").alias("platform"), who.alias("sender"), F.lit("ME").alias("recipient"))
    return cv.link_across_platforms(m).groupBy("pair", "segment_no").agg(F.count("*").alias("n"), F.count_distinct("platform").alias("n_platforms"))


@query("formatted_lines", "TX-19", f"with {MESSAGES_CTE} select conv_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || sender || ': ' || text as line from messages")
def _(t):
    return cv.format_messages(messages(t), ["conv_id"]).select("conv_id", "line")


# --- mapping ----------------------------------------------------------------------------------


@query("normalized_messages", "PF-01", """select sha256(concat_ws('|', turn::varchar, role, 'unknown', text)) as message_id, turn::varchar as ts, role as sender, 'unknown' as recipient, text,
 case when role = 'user' then 'sent' else 'received' end as type from conversations""")
def _(t):
    raw = t.conversations.select(F.col("turn").alias("time"), F.col("role").alias("from"), F.col("text").alias("body"), (F.col("role") == "user").alias("is_from_me"))
    return mp.normalize_messages(raw)


@query("message_columns", "PF-02 PF-03", f"""with {MESSAGES_CTE} select message_id, md5(lower(text)) as body_lower, len(regexp_split_to_array(text, '\\s+')) as word_count, length(text) as character_count,
 sha256(text) as content_hash, strftime(ts, '%m/%d/%Y') as date_us, strftime(ts, '%I:%M %p') as time_12h from messages""")
def _(t):
    out = mp.message_columns(messages(t)).withColumn("body_lower", F.md5("body_lower"))
    return out.select("message_id", "body_lower", "word_count", "character_count", "content_hash", "date_us", "time_12h")


@query("export_rows", "PF-03", f"""with {MESSAGES_CTE} select message_id, sender as platform, sender, text, 'neutral' as preliminary_sentiment, length(text) % 10 as preliminary_severity, 0.5 as preliminary_confidence from messages""")
def _(t):
    m = messages(t).withColumns({"platform": F.col("sender"), "label": F.lit("neutral"), "severity": F.length("text") % 10, "confidence": F.lit(0.5)})
    return mp.export_row(m).drop("ts")


@query("inferred_schema", "PF-04", """select 'event_id' as field, 'number' as type, count(event_id) = count(*) as required, min(event_id::varchar) as example, 0.9 as confidence from events
union all select 'user_id', 'number', count(user_id) = count(*), min(user_id::varchar), 0.9 from events union all select 'event_type', 'string', count(event_type) = count(*), min(event_type), 0.9 from events
union all select 'props', 'string', count(props) = count(*), min(props), 0.9 from events""")
def _(t):
    return mp.infer_schema(t.events.select("event_id", "user_id", "event_type", "props"))


@query("resolved_schema", "PF-05 PF-06", """select text as body, 'P' || conv_id as "_orig_conv", turn as "date", role as "contactName" from conversations""")
def _(t):
    raw = t.conversations.select(F.col("text").alias("Text"), F.concat(F.lit("P"), "conv_id").alias("conv"), F.col("turn").alias("sent_at"), F.col("role").alias("author"))
    return mp.apply_mapping(raw, mp.resolve_schema(raw))


@query("schema_fingerprints", "PF-07", """select 's' || p_size as source, substring(md5(array_to_string(list_sort([lower(p_brand), lower(p_type), 'name']), '|')), 1, 12) as fingerprint, count(*) as used_count from part group by all""")
def _(t):
    f = mp.schema_fingerprint(F.array("p_brand", "p_type", F.lit("Name")))
    used = t.part.select(F.concat(F.lit("s"), "p_size").alias("source"), f.alias("fingerprint"))
    return used.groupBy("source", "fingerprint").agg(F.count("*").alias("used_count"))


@query("schema_coverage", "PF-08", """select count(*) as message_count, count(*) filter (text <> '') as body, 0 as date, 0 as "readableDate", count(*) filter (role <> '') as "contactName", 0 as address,
 count(*) filter (text <> '') > 0 as valid, concat_ws('; ', case when count(*) > count(*) filter (text <> '') then 'Missing body in ' || (count(*) - count(*) filter (text <> '')) || ' messages' end, 'No dates found') as warnings
from (select case when turn = 3 then '' else text end as text, role from conversations)""")
def _(t):
    return mp.field_coverage(t.conversations.select(F.when(F.col("turn") == 3, "").otherwise(F.col("text")).alias("text"), "role"))


@query("validation_errors", "PF-12 TX-21", """select conv_id, turn, array_to_string(list_filter([case when text is null or text = '' then 'missing text' end, case when role not in ('user', 'assistant') then 'invalid role: ' || role end], lambda x: x is not null), '; ') as errors
from (select conv_id, turn, role, case when turn % 4 = 3 then null else text end as text from conversations) where text is null or role not in ('user', 'assistant')""")
def _(t):
    raw = t.conversations.withColumn("text", F.when(F.col("turn") % 4 != 3, F.col("text")))
    _good, bad = mp.split_valid(raw, ["text"], {"role": ["user", "assistant"]})
    return bad.select("conv_id", "turn", F.array_join("errors", "; ").alias("errors"))


# --- markers ----------------------------------------------------------------------------------


@query("role_ratio", "DS-01", f"""with {MESSAGES_CTE}, w as (select message_id, regexp_extract_all(lower(text), '[a-z'']+') as w from messages),
c as (select message_id, len(w) as n_words, len(list_filter(w, lambda x: x in ('the', 'and', 'of'))) as n_first, len(list_filter(w, lambda x: x in ('que', 'der', 'de'))) as n_second from w)
select *, round(case when n_words = 0 then 0 else n_first / n_words end, 6) as first_ratio, round(case when n_words = 0 then 0 else n_second / n_words end, 6) as second_ratio,
 n_words > 0 and n_first / nullif(n_words, 0) > 0.08 as self_focus, n_words > 0 and n_second / nullif(n_words, 0) > 0.12 as blame_focus from c""")
def _(t):
    out = cv.pronoun_ratio(messages(t), ["the", "and", "of"], ["que", "der", "de"], "message_id")
    return out.withColumns({c: F.round(c, 6) for c in ("first_ratio", "second_ratio")})


@query("marker_counts", "DS-02", r"""select doc_id, len(regexp_extract_all(lower(text), '\b(?:that|was|on the)\b')) as certain, len(regexp_extract_all(lower(text), '\b(?:nicht|que la|for)\b')) as hedge from documents""")
def _(t):
    return cv.marker_counts(t.documents, {"certain": ["that", "was", "on the"], "hedge": ["nicht", "que la", "for"]})


@query("escalation", "DS-03", """select user_id, count(*) as n, round(regr_slope(value, epoch(date_trunc('second', ts)) / 86400.0), 4) as slope_per_day, round(avg(value), 4) as mean_severity, regr_slope(value, epoch(date_trunc('second', ts)) / 86400.0) > 0 as escalating from events group by 1""")
def _(t):
    out = cv.escalation(t.events, "user_id", "ts", "value")
    return out.withColumns({c: F.round(c, 4) for c in ("slope_per_day", "mean_severity")})


@query("phase_transitions", "DS-04", """with p as (select user_id, ts, event_id, case event_type when 'error' then 'incident' when 'purchase' then 'reconciliation' when 'click' then 'tension' else 'calm' end as phase from events),
n as (select *, lead(phase) over (partition by user_id order by ts, event_id) as next_phase from p) select phase, next_phase, count(*) as n from n where next_phase is not null group by all""")
def _(t):
    phase = (F.when(F.col("event_type") == "error", "incident").when(F.col("event_type") == "purchase", "reconciliation")
             .when(F.col("event_type") == "click", "tension").otherwise("calm"))
    return cv.phase_transitions(t.events.withColumn("phase", phase), "user_id", ["ts", "event_id"], "phase", F.date_trunc("day", "ts"))


@query("denial_contradictions", "DS-05", """with m as (select user_id, props as term, min(ts) as f, count(*) as n from events where event_type = 'view' group by all)
select e.event_id, e.user_id, e.props as term, n as n_mentions from events e join m on m.user_id = e.user_id and m.term = e.props where e.event_type = 'error' and f < e.ts""")
def _(t):
    e = t.events.select("event_id", "user_id", F.col("props").alias("term"), "ts", "event_type")
    out = cv.denial_contradictions(e.where("event_type = 'view'"), e.where("event_type = 'error'"), ["user_id", "term"])
    return out.select("event_id", "user_id", "term", "n_mentions")


@query("overelaboration", "DS-06", r"""with c as (select doc_id, len(regexp_extract_all(lower(text), '\b(?:from the|to the)\b')) as place, len(regexp_extract_all(lower(text), '\b(?:for|weil)\b')) as reason,
 list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s) <> ''), lambda s: len(regexp_split_to_array(trim(s), '\s+'))) as l from documents)
select doc_id, place, reason, round(case when len(l) = 0 then 0 else list_sum(l) / len(l) end, 6) as avg_sentence_words, place + reason as n_markers from c""")
def _(t):
    out = cv.overelaboration(t.documents, {"place": ["from the", "to the"], "reason": ["for", "weil"]})
    return out.withColumn("avg_sentence_words", F.round("avg_sentence_words", 6))
