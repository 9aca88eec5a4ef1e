"""Queries: lexicon matching, screening, rules, roll-ups."""

from pyspark.sql import functions as F

from threadloom import lexicons as lx
from threadloom.operators import automaton
from threadloom.operators import classify as cl
from threadloom.operators import patterns as pm
from threadloom.plans.catalog import query
from threadloom.plans.shared import LEXICON_CTE, MATCHES_CTE, MESSAGES_CTE, corpus_lexicon, corpus_matches, messages

_CONTEXT = """(case when start > 100 then '...' else '' end
  || substring(text, greatest(start - 100, 0) + 1,
       least("end" + 100, length(text)) - greatest(start - 100, 0))
  || case when "end" + 100 < length(text) then '...' else '' end)"""


@query("lexicon_match", "PM-01 JN-04 TX-15", f"""with {MATCHES_CTE}
select doc_id, module, term, category, severity, 80 as confidence, start, "end", matched_text,
       {_CONTEXT} as context from matches""")
def _(t):
    return corpus_matches(t).drop("factors", "module_name")


@query("lexicon_match_keyed", "PM-01 JN-04", f"""with {MATCHES_CTE}
select module, term, count(*) as n, sum(start) as start_sum, count(distinct doc_id) as n_docs
from matches group by all""")
def _(t):
    found = pm._match_by_keys(t.documents, corpus_lexicon(t.spark), "doc_id", "text")
    return found.groupBy("module", "term").agg(
        F.count("*").alias("n"), F.sum("start").alias("start_sum"), F.count_distinct("doc_id").alias("n_docs")
    )


@query("lexicon_match_automaton", "PM-01 JN-04", f"""with {MATCHES_CTE}
select doc_id, module, term, start, start + length(term) as end_pos from matches""")
def _(t):
    lexicon = corpus_lexicon(t.spark)
    phrases = automaton.phrases_within(lexicon.select(F.lower("term").alias("term")), "term")
    found = automaton.match_phrases(t.documents, lexicon, phrases, "term", "doc_id", "text")
    return found.select("doc_id", "module", "term", "start", F.col("end").alias("end_pos"))


@query("lexicon_modules_custom", "PM-02 SO-09", f"""with {LEXICON_CTE},
custom(category, term, is_active) as (values ('Blame Shifting', 'tion the', true), ('Blame Shifting', 'zzz', false),
  ('Unknown Group', 'the', true), ('gaslighting', 'ächst', true)),
lex2 as (select module, term from lex union all
  select c.m, c.term from (select replace(lower(category), ' ', '_') as m, term, is_active from custom) c
  where is_active and m in (select module from lex)),
lex3 as (select * from lex2 where module in ('gaslighting', 'blame_shifting'))
select module, term, sum((length(low) - length(replace(low, term, ''))) // length(term)) as n,
       count(*) as n_docs
from (select lower(text) as low from documents) d join lex3 on contains(low, term) group by all""")
def _(t):
    custom = t.spark.createDataFrame(
        [("Blame Shifting", "tion the", True), ("Blame Shifting", "zzz", False),
         ("Unknown Group", "the", True), ("gaslighting", "ächst", True)],
        "category string, term string, is_active boolean",
    )
    lexicon = pm.enabled_lexicon(corpus_lexicon(t.spark), ["gaslighting", "blame_shifting"], custom)
    return pm.match_lexicon(t.documents, lexicon).groupBy("module", "term").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")
    )


_HURT = [("CDS", "worthless", "en", True), ("CDS", "stupid", "en", True), ("AN", "clown", "en", True),
         ("RE", "nicht", "de", True), ("PR", "que", "fr", False)]


@query("offensive_terms", "PM-03", """with lex(cat, term, lang, active) as (values
 ('CDS','worthless','en',true),('CDS','stupid','en',true),('AN','clown','en',true),('RE','nicht','de',true),('PR','que','fr',false)),
hits as (select doc_id, cat, term, lower(text) as low from documents join lex on contains(lower(text), term)
  where active and lex.lang in ('en','de') )
select cat as module, sum((length(low) - length(replace(low, term, ''))) // length(term)) as n,
  count(distinct doc_id) as n_docs, sum((length(low) - length(replace(low, term, ''))) // length(term) * length(term)) as matched_chars
from hits group by 1""")
def _(t):
    lexicon = t.spark.createDataFrame(_HURT, "module string, term string, lang string, active boolean")
    lexicon = lexicon.where("active and lang in ('en','de')").select(
        "module", F.col("module").alias("module_name"), "term", F.lit("negative").alias("category"),
        F.lit(5).alias("severity"), F.array().cast("array<string>").alias("factors"))
    hits = pm.match_lexicon(t.documents, lexicon, context_chars=50)
    return hits.groupBy("module").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"),
        F.sum(F.length("matched_text")).alias("matched_chars"))


@query("severity_score", "AG-03 PM-01", f"""with {MATCHES_CTE},
s as (select doc_id, count(*) as n_matches, count(*) filter (category = 'negative') as n_negative,
  count(*) filter (category = 'positive') as n_positive,
  avg(severity) filter (category = 'negative') as a from matches group by 1)
select doc_id, n_matches, n_negative, n_positive,
  case when n_negative = 0 then 0 else least(100, round(a * least(2.0, 1 + log10(n_negative + 1)))) end::int as severity_score
from s order by severity_score desc, doc_id""")
def _(t):
    return cl.severity_scores(corpus_matches(t)).orderBy(F.desc("severity_score"), "doc_id")


@query("factor_counts", "AG-04 JN-13", f"""with {MATCHES_CTE},
names(factor, name) as (values {', '.join(f"('{a}', '{b}')" for a, b in lx.FACTORS)})
select doc_id, factor, name, count(*) as n
from (select doc_id, unnest(string_split(factors, '')) as factor from matches) join names using (factor) group by all""")
def _(t):
    names = F.broadcast(t.spark.createDataFrame(lx.FACTORS, "factor string, name string"))
    return cl.factor_counts(corpus_matches(t)).join(names, "factor")


_CONTRA = f"""{MATCHES_CTE},
contra as (
  select p.doc_id, p.module as pos_module, p.matched_text as pos_text, p.start as pos_start, p.term as pos_term,
         n.module as neg_module, n.matched_text as neg_text, n.start as neg_start, n.term as neg_term,
         n.start - p.start as distance, lower(n.module_name) as neg_name
  from matches p join matches n on p.doc_id = n.doc_id and n.category = 'negative'
  where (p.module = 'love_bombing' and n.module in ('gaslighting','blame_shifting','minimization','threats_intimidation')
         and abs(n.start - p.start) < 2000)
     or (p.module = 'apologies' and n.start > p.start and n.start - p.start < 3000))"""


@query("contradiction_pairs", "JN-05", f"""with {_CONTRA}
select doc_id, pos_module, pos_text, pos_start, neg_module, neg_text, neg_start, distance,
 case when pos_module = 'love_bombing'
   then 'Love bombing ("' || pos_text || '") followed by ' || neg_name || ' ("' || neg_text || '")'
   else 'Apology ("' || pos_text || '") contradicted by subsequent ' || neg_name end as description
from contra""")
def _(t):
    return pm.contradictions(corpus_matches(t)).select(
        "doc_id", "pos_module", F.col("pos_matched_text").alias("pos_text"), "pos_start", "neg_module",
        F.col("neg_matched_text").alias("neg_text"), "neg_start", "distance", "description")


@query("match_timeline", "TK-01", f"""with {MATCHES_CTE}
select doc_id, start, "end", module, term from matches order by doc_id, start, "end", module, term""")
def _(t):
    return pm.timeline(corpus_matches(t)).select("doc_id", "start", "end", "module", "term")


@query("match_summary", "AG-05", f"""with {_CONTRA},
s as (select doc_id, count(*) filter (category = 'negative') as nn, count(*) filter (category = 'positive') as np,
  avg(severity) filter (category = 'negative') as a from matches group by 1),
sev as (select *, case when nn = 0 then 0 else least(100, round(a * least(2.0, 1 + log10(nn + 1)))) end::int as sc from s),
mc as (select doc_id, category, module_name, count(*) as n from matches group by all),
rk as (select *, row_number() over (partition by doc_id, category order by n desc, module_name) as r from mc),
top as (select doc_id, category, string_agg(module_name || ' (' || n || ')', ', ' order by r) as txt from rk where r <= 3 group by all),
cc as (select doc_id, count(*) as n from contra group by 1)
select sev.doc_id, sc as severity_score, coalesce(cc.n, 0) as n_contradictions,
 coalesce(nullif(concat_ws(' ',
  case when nn > 0 then 'Detected ' || nn || ' concerning patterns, primarily: ' || tn.txt || '.' end,
  case when np > 0 then 'Found ' || np || ' positive/affectionate patterns: ' || tp.txt || '.' end,
  case when cc.n > 0 then 'Identified ' || cc.n || ' potential contradictions between positive and negative statements.' end,
  case when sc > 0 then 'Overall severity: ' || case when sc >= 80 then 'HIGH' when sc >= 50 then 'MODERATE' else 'LOW' end || ' (' || sc || '/100).' end
 ), ''), 'No significant patterns detected.') as summary
from sev left join top tn on tn.doc_id = sev.doc_id and tn.category = 'negative'
 left join top tp on tp.doc_id = sev.doc_id and tp.category = 'positive' left join cc on cc.doc_id = sev.doc_id""")
def _(t):
    m = corpus_matches(t)
    return cl.summarise_matches(m, pm.contradictions(m))


# --- screening --------------------------------------------------------------------------------

_SCREEN = [
    dict(grp="abuse", severity=9, factor="f", type="child_reference", pattern=r"\b(stupid|worthless|clown)\b"),
    dict(grp="call", severity=10, factor="k", type="communication_blocking", pattern=r"\bthat\s+the\b"),
    dict(grp="visit", severity=10, factor="k", type="parental_alienation", pattern=r"\bnicht\s+(die|der|mit)\b"),
    dict(grp="start", severity=8, factor="a", type="custody_interference", pattern=r"\bis\s+an?\b"),
]
_SCREEN_CTE = "rules(grp, severity, factor, type, pattern) as (values " + ", ".join(
    f"('{r['grp']}', {r['severity']}, '{r['factor']}', '{r['type']}', '(?i){r['pattern']}')" for r in _SCREEN
) + "), flags as (select doc_id, r.*, unnest(regexp_extract_all(text, r.pattern)) as matched from documents, rules r where regexp_matches(text, r.pattern))"


@query("priority_flags", "PM-04", f"""with {_SCREEN_CTE}
select doc_id, grp, severity, factor, type, lower(matched) as matched, count(*) as n from flags group by all""")
def _(t):
    return pm.screen(t.documents, _SCREEN).groupBy(
        "doc_id", "grp", "severity", "factor", "type", F.lower("matched_text").alias("matched")
    ).agg(F.count("*").alias("n"))


@query("priority_screen", "PM-04", f"""with {_SCREEN_CTE},
f as (select doc_id, count(*) as n, max(severity) as s, bool_or(type = 'child_reference') as c,
 bool_or(type in ('parental_alienation','communication_blocking')) as a from flags group by 1)
select d.doc_id, coalesce(n, 0) as n_flags, coalesce(s, 5) as immediate_severity, coalesce(c, false) as child_mentioned,
 coalesce(a, false) as alienation_detected from documents d left join f using (doc_id)""")
def _(t):
    docs = t.documents
    return pm.screen_summary(docs, pm.screen(docs, _SCREEN))


@query("flag_summary", "AG-08", f"""with {_SCREEN_CTE}
select 'type' as dimension, type as value, count(*) as n, max(severity) as max_severity from flags group by all
union all select 'factor', factor, count(*), max(severity) from flags group by all""")
def _(t):
    return cl.flag_summary(pm.screen(t.documents, _SCREEN))


# --- rule sets --------------------------------------------------------------------------------

_PII = {r[1]: r for r in lx.RULES if r[3] == "regex"}


def _pii_sql(select):
    parts = [
        f"select doc_id, '{r[0]}' as ruleset_id, '{r[1]}' as rule_id, {r[5]} as priority,"
        f" unnest(regexp_extract_all(text, '(?i){r[4]}')) as matched_text from documents"
        for r in _PII.values()
    ] + [
        f"select doc_id, '{r[0]}', '{r[1]}', {r[5]}, unnest(regexp_extract_all(lower(text), '{k.lower()}')) from documents"
        for r in lx.RULES if r[3] == "keyword" for k in r[4].split(",")
    ]
    return f"with m as ({' union all '.join(parts)}) {select}"


@query("pii_rules", "PM-05 PM-10", _pii_sql(
    "select doc_id, rule_id, priority, lower(matched_text) as matched_text, count(*) as n from m group by all"))
def _(t):
    hits = pm.evaluate_rules(t.documents, lx.builtin_rules(t.spark))
    return hits.groupBy("doc_id", "rule_id", "priority", F.lower("matched_text").alias("matched_text")).agg(
        F.count("*").alias("n"))


@query("pii_spans_valid", "PM-05", _pii_sql(
    "select rule_id, count(*) as n, count(*) as n_valid from m group by 1"))
def _(t):
    hits = pm.evaluate_rules(t.documents, lx.builtin_rules(t.spark)).join(t.documents.select("doc_id", "text"), "doc_id")
    same = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("matched_text")
    return hits.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(same).alias("n_valid"))


@query("rule_priority", "PM-09 JN-12", _pii_sql(
    "select doc_id, max(priority) as top_priority, count(*) as n_matches, count(distinct rule_id) as n_rules from m group by 1"
    " order by 2 desc, 1"))
def _(t):
    hits = pm.by_priority(pm.evaluate_rules(t.documents, lx.builtin_rules(t.spark)))
    return hits.groupBy("doc_id").agg(
        F.max("priority").alias("top_priority"), F.count("*").alias("n_matches"),
        F.count_distinct("rule_id").alias("n_rules")).orderBy(F.desc("top_priority"), "doc_id")


@query("rules_mixed", "PM-06 PM-07 PM-08 PM-09", r"""
with m as (
 select doc_id, 'kw' as rule_id, unnest(regexp_extract_all(lower(text), 'hahe')) as x from documents
 union all select doc_id, 'kw', unnest(regexp_extract_all(lower(text), 'clown')) from documents
 union all select doc_id, 'path', unnest(regexp_extract_all(text, '(?i)the[^/\s]*ing[^/\s]')) from documents
 union all select doc_id, 'table', unnest(regexp_extract_all(text, '\|.+\|')) from documents
 union all select doc_id, 'heading', unnest(regexp_extract_all(text, '(?m)^#{1,6}\s+.+$')) from documents)
select rule_id, count(*) as n, count(distinct doc_id) as n_docs,
  sum(case when rule_id in ('table','heading') then least(length(x), 100) else length(x) end) as chars from m group by 1""")
def _(t):
    rules = t.spark.createDataFrame(
        [("u", "kw", "k", "keyword", "hahe, clown", 1, True, "flag"), ("u", "path", "p", "path", "the*ing?", 2, True, "flag"),
         ("u", "table", "t", "structural", "has-table", 3, True, "label"),
         ("u", "heading", "h", "structural", "has-heading", 3, True, "label"),
         ("u", "off", "o", "regex", "the", 3, False, "flag")], lx.RULE_SCHEMA)
    hits = pm.evaluate_rules(t.documents, rules)
    return hits.groupBy("rule_id").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum(F.length("matched_text")).alias("chars"))


@query("rule_set_suggestion", "PM-11", _pii_sql("""
, unused as (select 1) select doc_id, ruleset_id, n_matches, round(least(n_matches * 0.1, 1.0), 6) as score,
 row_number() over (partition by doc_id order by least(n_matches * 0.1, 1.0) desc, ruleset_id) as rank
from (select doc_id, ruleset_id, count(*) as n_matches from m group by all)
"""))
def _(t):
    docs = t.documents.select("doc_id", "text")
    out = pm.suggest_rule_sets(pm.evaluate_rules(docs, lx.builtin_rules(t.spark)))
    return out.withColumn("score", F.round("score", 6))


@query("pattern_tester", "PM-13", r"""
select doc_id, lower(unnest(regexp_extract_all(text, '(?i)\b(un|une|ein)\s+\w+'))) as found, lang from documents""")
def _(t):
    hits = pm.regex_matches(t.documents, [dict(rule="article", pattern=r"\b(un|une|ein)\s+\w+")])
    return hits.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.lower("matched_text").alias("found"), "lang")


_LINES = """lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
 unnest(generate_series(1, len(string_split(text, chr(10))))) as line_no from documents)"""


@query("line_search_context", "PM-12 AG-28", f"""with {_LINES},
x as (select *, lag(line) over w as before, lead(line) over w as after,
  sum(length(line) + 1) over (partition by doc_id order by line_no) - length(line) - 1 as st
  from lines window w as (partition by doc_id order by line_no))
select doc_id, line_no, strpos(lower(line), 'worthless') as "column", st + strpos(lower(line), 'worthless') - 1 as "offset",
 line, coalesce(before, '') as before, coalesce(after, '') as after from x where contains(lower(line), 'worthless')""")
def _(t):
    return pm.line_search(t.documents, "worthless", context=1)


@query("line_search_words", "PM-12 TK-05", f"""with {_LINES},
x as (select *, row_number() over (partition by doc_id order by line_no) as r from lines
 where regexp_matches(line, '(?i)\\b(?:nicht|avec)\\b'))
select doc_id, line_no, line from x where r <= 2""")
def _(t):
    return pm.line_search(t.documents, "nicht|avec", regex=True, whole_word=True, max_per_doc=2).select(
        "doc_id", "line_no", "line")


@query("search_stats", "AG-28", f"""with {_LINES}, h as (select * from lines where contains(lower(line), 'that the'))
select doc_id, count(*) as n_matches, min(line_no) as first_line, max(line_no) as last_line,
 (select count(*) from h) as total_matches, (select count(distinct doc_id) from h) as n_files from h group by 1""")
def _(t):
    return pm.search_stats(pm.line_search(t.documents, "that the"))


@query("catalog_search", "PM-14 AG-24", """with x as (select p_partkey, lower(p_name) as n, lower(p_type) as d, lower(p_brand) as b from part),
s as (select p_partkey,
 case when n = 'green' then 100 when contains(n, 'green') then 50 else 0 end + case when contains(b, 'green') then 25 else 0 end + case when contains(d, 'green') then 10 else 0 end
 + case when n = 'brand#1' then 100 when contains(n, 'brand#1') then 50 else 0 end + case when contains(b, 'brand#1') then 25 else 0 end + case when contains(d, 'brand#1') then 10 else 0 end
 + case when n = 'steel' then 100 when contains(n, 'steel') then 50 else 0 end + case when contains(b, 'steel') then 25 else 0 end + case when contains(d, 'steel') then 10 else 0 end as score from x)
select p_partkey, score from s where score > 0 order by score desc, p_partkey limit 25""")
def _(t):
    parts = t.part.withColumn("tags", F.array("p_brand"))
    return pm.keyword_search(parts, "green Brand#1 steel", "p_name", "p_type", "tags", 25, tie="p_partkey").select(
        "p_partkey", "score")


_ROUTES = [dict(intent="that_the", keywords=["stupid", "worthless"], target="abuse"),
           dict(intent="nicht_mit", keywords=["der", "und", "ein"], target="german"),
           dict(intent="de_la", keywords=["que", "les", "une"], target="french")]


@query("keyword_routing", "PM-15", """with s as (select doc_id, lower(text) as l from documents),
x as (select doc_id, 'abuse' as r, 0 as o, (case when contains(l,'that the') then 10 else 0 end + 2*contains(l,'stupid')::int + 2*contains(l,'worthless')::int) as s from s
union all select doc_id, 'german', 1, (case when contains(l,'nicht mit') then 10 else 0 end + 2*contains(l,'der')::int + 2*contains(l,'und')::int + 2*contains(l,'ein')::int) from s
union all select doc_id, 'french', 2, (case when contains(l,'de la') then 10 else 0 end + 2*contains(l,'que')::int + 2*contains(l,'les')::int + 2*contains(l,'une')::int) from s)
select doc_id, r as route, s as score, round(least(s / 10.0, 1.0), 6) as confidence from
 (select *, row_number() over (partition by doc_id order by s desc, o) as k from x where s > 0) where k = 1""")
def _(t):
    return pm.route(t.documents, _ROUTES).withColumn("confidence", F.round("confidence", 6))


@query("related_items", "PM-17", """with s as (select p_partkey as subject, p_brand, string_split(p_type, ' ') as st from part where p_retailprice > 1.9 * (select avg(p_retailprice) from part) or p_size = 50),
x as (select subject, p.p_partkey, p.p_brand, len(list_intersect(list_distinct(string_split(p_type, ' ')), st)) * 2 + 1 as score
 from part p join s on p.p_brand = s.p_brand and p.p_partkey <> subject)
select * from (select *, row_number() over (partition by subject order by score desc, p_partkey) as rank from x) where rank <= 5""")
def _(t):
    parts = t.part.withColumn("tags", F.split("p_type", " "))
    avg = t.part.agg(F.avg("p_retailprice").alias("a"))
    subjects = parts.crossJoin(F.broadcast(avg)).where("p_retailprice > 1.9 * a or p_size = 50").drop("a")
    return pm.related_items(parts, subjects, "p_partkey", "p_brand", "tags", 5)


# --- roll-ups ---------------------------------------------------------------------------------


@query("classification_rollup", "AG-01", """with c as (
 select user_id, event_id, case event_type when 'error' then 'hostile' when 'click' then 'negative' when 'purchase' then 'positive' else 'neutral' end as s,
  cast(least(10, floor(value / 10)) as int) as sev, (event_id % 8) / 8.0 as conf from events),
m as (select user_id, s, count(*) as n, min(event_id) as f from c group by all),
r as (select *, row_number() over (partition by user_id order by n desc, f) as k from m)
select c.user_id, count(*) as n, round(avg(sev), 6) as avg_severity, round(avg(conf), 6) as confidence_avg,
 count(*) filter (sev >= 7) as high_severity_count, any_value(r.s) as overall_sentiment
from c join r on r.user_id = c.user_id and k = 1 group by 1""")
def _(t):
    kind = (F.when(F.col("event_type") == "error", "hostile").when(F.col("event_type") == "click", "negative")
            .when(F.col("event_type") == "purchase", "positive").otherwise("neutral"))
    c = t.events.select("user_id", "event_id", kind.alias("sentiment"),
                        F.least(F.lit(10), F.floor(F.col("value") / 10)).cast("int").alias("severity"),
                        ((F.col("event_id") % 8) / 8).alias("confidence"))
    out = cl.rollup_classifications(c, ["user_id"], "event_id")
    return out.withColumns({"avg_severity": F.round("avg_severity", 6), "confidence_avg": F.round("confidence_avg", 6)})


@query("pattern_frequency", "AG-01 EV-10", f"""with {MATCHES_CTE}, p as (select distinct doc_id, module from matches)
select source, module as pattern, count(*) as n from p join documents using (doc_id) group by all""")
def _(t):
    per_doc = corpus_matches(t).groupBy("doc_id").agg(F.collect_set("module").alias("patterns"))
    joined = per_doc.join(t.documents.select("doc_id", "source"), "doc_id")
    return cl.pattern_frequency(joined, ["source"], "patterns")


_SW_POS = "('good','great','excellent','amazing','wonderful','fantastic','love','happy','best','perfect','beautiful','awesome')"
_SW_NEG = "('bad','terrible','awful','horrible','hate','worst','poor','disappointing','sad','angry','ugly','boring')"


@query("nlp_classification", "AG-06 TX-07", f"""with {MATCHES_CTE},
s as (select doc_id, count(*) filter (category = 'negative') as n, count(*) filter (category = 'positive') as p,
  avg(severity) filter (category = 'negative') as a from matches group by 1),
w as (select doc_id, list_distinct(regexp_split_to_array(lower(text), '\\s+')) as ws, text from documents),
c as (select doc_id, len(list_filter(ws, lambda x: x in {_SW_POS})) as p, len(list_filter(ws, lambda x: x in {_SW_NEG})) as n, text from w),
q as (select *, case when p + n = 0 then 0.0 else (p - n) / (p + n) end as score from c)
select q.doc_id, case when score > 0.2 then 'positive' when score < -0.2 then 'negative' else 'neutral' end as sentiment,
 coalesce(s.n, 0) as n_negative, coalesce(s.p, 0) as n_positive,
 (case when coalesce(s.n, 0) = 0 then 1 else least(round(a / 10 + least(s.n * 0.5, 3.0)), 10) end)::int as severity,
 round(case when coalesce(s.n + s.p, 0) = 0 then cf else (least((s.n + s.p) * 0.1, 0.9) + cf) / 2 end, 6) as confidence,
 len(regexp_split_to_array(text, '\\s+')) as word_count, len(regexp_split_to_array(text, '[.!?]+')) as sentence_count, length(text) as text_length
from (select *, case when p + n = 0 then 0.5 else least(0.5 + abs(score) * 0.5, 1.0) end as cf from q) q left join s using (doc_id)""")
def _(t):
    out = cl.classify_nlp(t.documents, corpus_matches(t))
    return out.withColumn("confidence", F.round("confidence", 6))


_VOCAB_POS = "(" + ",".join(f"'{w}'" for w in lx.POSITIVE_WORDS) + ")"
_VOCAB_NEG = "(" + ",".join(f"'{w}'" for w in lx.NEGATIVE_WORDS) + ")"
_NEGATIONS = " or ".join(f"contains(lower(text), '{w}')" for w in lx.NEGATION_WORDS)
_INTENS = " + ".join(f"contains(lower(text), '{w}')::int" for w in lx.INTENSIFIERS)


@query("multipass_consensus", "AG-07 TX-06 TX-14", f"""with {MATCHES_CTE}, {_SCREEN_CTE},
fl as (select doc_id, max(severity) as s from flags group by 1),
mc as (select doc_id, count(*) filter (category = 'negative') as n, count(*) filter (category = 'positive') as p from matches group by 1),
w as (select doc_id, text, list_distinct(regexp_split_to_array(lower(text), '\\s+')) as ws, regexp_extract_all(lower(text), '\\b[a-z]+\\b') as tk from documents),
c as (select doc_id, text, len(tk) as nt, len(list_filter(ws, lambda x: x in {_SW_POS})) as ap, len(list_filter(ws, lambda x: x in {_SW_NEG})) as an,
  len(list_filter(tk, lambda x: x in {_VOCAB_POS})) as bp, len(list_filter(tk, lambda x: x in {_VOCAB_NEG})) as bn from w),
q as (select *, case when ap + an = 0 then 0.0 else (ap - an) / (ap + an) end as a, case when bp + bn = 0 then 0.0 else (bp - bn) / (bp + bn) end as b from c),
j as (select q.*, coalesce(mc.n, 0) as n, coalesce(mc.p, 0) as p, coalesce(fl.s, 5) as pri, (a + b) / 2 as pol,
  case when nt = 0 then 0.0 else (bp + bn) / nt end as sub from q left join mc using (doc_id) left join fl using (doc_id)),
v as (select *, case when a > 0.2 then 'positive' when a < -0.2 then 'negative' else 'neutral' end as v1,
  case when n > p then 'negative' when p > 0 then 'positive' end as v2,
  case when b > 0.2 then 'positive' when b < -0.2 then 'negative' else 'neutral' end as v3 from j),
win as (select *, case when v1 = v2 or v1 = v3 or v2 is null then v1 when v2 = v3 then v2 else v1 end as wv,
  ({_NEGATIONS}) as neg, sub > 0.7 and n > 0 and pol > 0.2 as sarc from v),
lab as (select *, case when wv = 'negative' and n >= 5 then 'abusive' when wv = 'negative' and n >= 3 then 'hostile' else wv end as label from win)
select doc_id, label, greatest(least(round(5 + 0.8 * n + case when pol < -0.5 then 2 when pol < -0.2 then 1 else 0 end + case when sarc then 1.5 else 0 end
  + case when neg and pol > 0 then 1 else 0 end), 10), pri)::int as severity,
 round(least(1.0 + case when (n > 0 and label <> 'positive') or (p > 0 and label = 'positive') then 0.2 else 0 end, 1.0), 6) as confidence,
 round(pol, 6) as polarity, sarc as sarcasm, contains(text, '?') as question,
 regexp_matches(trim(text), '(?i)^(do|don''t|stop|give|tell|show|let)') as imperative, neg as negation, {_INTENS} as n_intensifiers,
 n as n_negative, p as n_positive from lab""")
def _(t):
    docs = t.documents
    summary = pm.screen_summary(docs, pm.screen(docs, _SCREEN))
    out = cl.classify_multipass(docs, corpus_matches(t), summary)
    return out.withColumns({"confidence": F.round("confidence", 6), "polarity": F.round("polarity", 6)})


@query("behavior_flags", "DS-07 JN-03", f"""with {LEXICON_CTE}, {MESSAGES_CTE},
hits as (select message_id, module, severity, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) as n
  from messages join lex on contains(lower(text), term)),
m as (select message_id, sum(n)::bigint as c, max(severity) as mx, bool_or(module = 'apologies') as a, bool_or(module = 'blame_shifting') as b, bool_or(module = 'minimization') as mi from hits group by 1)
select message_id, coalesce(c, 0) as behavior_count, coalesce(mx, 0) as max_severity, coalesce(a, false) as contains_apology, coalesce(b, false) as contains_blame,
 false as contains_threat, coalesce(mi, false) as contains_minimizing, c is not null as has_behaviors from messages left join m using (message_id)""")
def _(t):
    msgs = messages(t)
    hits = pm.match_lexicon(msgs, corpus_lexicon(t.spark), "message_id")
    return cl.behavior_flags(msgs.select("message_id"), hits)


@query("behavior_scores", "UD-05", """with terms(behavior, term, weight) as (values ('hard', 'nicht', 0.5), ('hard', 'der', 0.3), ('soft', 'the', 0.4), ('soft', 'and', 0.3)),
h as (select doc_id, behavior, sum(weight) as s, count(*) as n from documents join terms on contains(lower(text), term) group by all)
select doc_id, behavior, n as n_terms, round(s, 6) as score, case when s >= 0.65 then 'high' when s >= 0.45 then 'medium' when s >= 0.2 then 'low' else 'none' end as level from h""")
def _(t):
    terms = t.spark.createDataFrame([("hard", "nicht", 0.5), ("hard", "der", 0.3), ("soft", "the", 0.4), ("soft", "and", 0.3)],
                                    "behavior string, term string, weight double")
    return cl.behavior_scores(t.documents, terms, 0.2, 0.45, 0.65).withColumn("score", F.round("score", 6))
