"""Named queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.config import PipelineConfig
from tessera.functions import quality as Q
from tessera.functions import replies as R
from tessera.functions import text as T
from tessera.operators import chunking, consistency, coverage, feedback, ranking, reports, review, similarity, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WS = r"[ \t\n\x0B\f\r]+"
_WORDS = f"list_filter(string_split_regex({{}}, '{WS}'), lambda x: x <> '')"


def query(sql: str | None = None):
    """Registers a query under its name, with its oracle if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def words(c: str) -> str:
    return _WORDS.format(c)


_REQ = A.duck_select(A.REQUIREMENT)
_ENT = A.duck_select(A.ENTITY)
_BLANK = "regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''"
_OUT = "array_to_string(expected_outputs, ' ')"
_CRITERIA = [
    "contains(lower(tr_h), 'shall')",
    f"(regexp_matches(tr_h, '{Q.TRIGGER}', 'i') or regexp_matches(tr_h, '{Q.SUBJECT}', 'i'))",
    f"len({words(_OUT)}) >= 4",
    f"len(list_filter(preconditions, lambda x: {_BLANK})) > 0",
    f"len(list_filter(stimuli, lambda x: {_BLANK})) > 0",
    f"regexp_matches(tr_h || ' ' || {_OUT}, '{Q.SPECIFIC}', 'i')",
]
_FLAGS = f"""with r as ({_REQ}), c as (select *, {', '.join(f'{e} as c{i}' for i, e in enumerate(_CRITERIA))} from r),
f as (select *, {' + '.join(f'cast(c{i} as int)' for i in range(6))} as ears_score,
 len(list_filter(source_req_ids, lambda x: {_BLANK})) > 0 as traceable,
 (len(preconditions) > 0 and len(stimuli) > 0 and len(expected_outputs) > 0 and coverage_criterion <> '') as complete,
 regexp_matches(lower(tr_h), '{'|'.join(Q.UNTESTABLE)}') as untestable from c),
g as (select *, ears_score >= 5 as compliant from f) """


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return review.flags(A.requirements(spark, d))


@query(f"select lang, sum(len({words('text')})) as words, count(*) as docs from documents group by lang")
def word_count_by_lang(spark, d):
    return A.table(spark, d, "documents").groupBy("lang").agg(F.sum(T.word_count("text")).alias("words"), F.count("*").alias("docs"))


@query("select doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) as units from documents")
def sentence_units(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(T.split_units("text", F.lit("sentence"))).alias("units"))


@query(f"""with s as (select doc_id, len({words('text')}) as n, cast(substring(source, 4) as int) % 4 as k from documents),
b as (select *, case k when 2 then 256 when 3 then 384 else 512 end as most from s) select doc_id, n from b where n <= most""")
def single_chunk_filter(spark, d):
    rows = chunking.with_budget(A.sections(spark, d)).withColumn("n", T.word_count("text"))
    return rows.filter("n <= most").select(F.col("section_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"))


_RANK = f"""with e as ({_ENT}), k as (select *, trim(regexp_replace(lower(content), '{WS}', ' ', 'g')) as key from e),
g as (select source_id, entity_type, key, count(*) as freq, round(count(*) + avg(confidence_score), 6) as significance, min(ordinal) as f from k group by all),
s as (select source_id, entity_type, key, content, row_number() over (partition by source_id, entity_type, key order by length(content) desc, ordinal) as n from k),
r as (select g.*, s.content, row_number() over (partition by g.source_id, g.entity_type order by significance desc, f) as rank from g join s using (source_id, entity_type, key) where s.n = 1) """


@query(_RANK + "select source_id, entity_type, cast(rank as int) as rank, content, freq, significance from r where rank <= 10")
def rank_by_significance(spark, d):
    return ranking.rank_by_significance(A.entities(spark, d), 10)


@query(f"""with e as ({_ENT}), t as (select *, row_number() over (partition by source_id order by confidence_score desc, ordinal) as n from e where entity_type = 'function_point')
select source_id, content, cast(min(n) as int) as position from t where n <= 8 group by source_id, content""")
def objectives_top8(spark, d):
    return ranking.objectives(A.entities(spark, d))


@query(f"""with e as ({_ENT}), t as (select source_id, ordinal, case when contains(content, ':') then trim(split_part(content, ':', 1)) else substring(content, 1, 40) end as term,
case when contains(content, ':') then trim(substring(content, strpos(content, ':') + 1)) else content end as definition from e where entity_type = 'glossary_term')
select source_id, term, arg_max(definition, ordinal) as definition, min(ordinal) as position from t group by source_id, term""")
def glossary_map(spark, d):
    return ranking.glossary(A.entities(spark, d))


_PAIRS = f"""with t as (select {{keys}}, row_number() over (partition by {{part}} order by {{o}}, md5(text)) as place, list_distinct({words("lower(text)")}) as t from {{table}}),
p as (select {{out}}, a.o as i, b.o as j, len(list_intersect(a.t, b.t)) as common, len(a.t) + len(b.t) as total from t a join t b on b.place > a.place and b.place <= a.place + 19 {{on}}
 where len(a.t) > 0 and len(b.t) > 0)
select {{final}}, i, j, round(common / (total - common), 6) as similarity from p where common / (total - common) > 0.75"""


@query(_PAIRS.format(keys="'all' as source, doc_id as o", part="1", o="doc_id", table="documents", out="a.source", on="", final="source"))
def jaccard_dup_pairs(spark, d):
    rows = A.table(spark, d, "documents").select(F.lit("all").alias("source"), "doc_id", "text")
    return similarity.window_pairs(rows, "text", ["source"], "doc_id")


_TURNS = "(select conv_id, turn * 3 as turn, text from conversations union all select conv_id, turn * 3 + 1 + conv_id % 25, concat(text, ' and so on') from conversations)"


@query(_PAIRS.format(keys="conv_id, turn as o", part="conv_id", o="turn", table=_TURNS, out="a.conv_id", on="and a.conv_id = b.conv_id", final="conv_id"))
def conversation_dup_pairs(spark, d):
    """Turns and a second wording of each, some places behind."""
    c = A.table(spark, d, "conversations")
    rows = c.selectExpr("conv_id", "turn * 3 as turn", "text").unionByName(c.selectExpr("conv_id", "turn * 3 + 1 + conv_id % 25 as turn", "concat(text, ' and so on') as text"))
    return similarity.window_pairs(rows, "text", ["conv_id"], "turn")


@query(_FLAGS + "select tr_id, source_id, ears_score, compliant, traceable, complete, untestable from g")
def ears_flags(spark, d):
    return _flags(spark, d).select("tr_id", "source_id", "ears_score", "compliant", "traceable", "complete", "untestable")


_ISSUES = "list_filter([" + ", ".join(f"case when not c{i} then {{'p': {i}, 'issue': '{n}'}} end" for i, n in enumerate(Q.ISSUES)) + "], lambda x: x is not null)"


@query(_FLAGS + f""", e as (select source_id, ordinal, unnest({_ISSUES}) as x from g where not compliant),
n as (select source_id, x.issue as issue, count(*) as n, min(ordinal * 10 + x.p) as f from e group by all),
ranked as (select *, row_number() over (partition by source_id order by n desc, f) as rank from n) select source_id, cast(rank as int) as rank, issue, n from ranked where rank <= 3""")
def ears_issue_hist(spark, d):
    return review.issue_histogram(_flags(spark, d))


@query(f"""with i as (select item_id, list_slice(list_filter({words('lower(text)')}, lambda x: length(x) >= 3), 1, 3) as k from benchmark),
w as (select distinct unnest({words('lower(text)')}) as w from documents)
select item_id, exists (select 1 from w where len(list_filter(k, lambda x: contains(w.w, x))) > 0) as covered from i""")
def coverage_items(spark, d):
    items = A.table(spark, d, "benchmark").select(F.lit("all").alias("source_id"), F.col("item_id").alias("ordinal"), "text")
    texts = A.table(spark, d, "documents").select(F.lit("all").alias("source_id"), "text")
    return coverage.item_coverage(items, texts).select(F.col("ordinal").alias("item_id"), "covered")


_ITEMS = "select concat('req', event_id % 40) as source_id, concat('Handle ', event_type) as text, min(event_id) as ordinal from events group by all"
_COVER = f"""i as ({_ITEMS}), ic as (select i.*, exists (select 1 from (select distinct source_id, lower(tr_h) as h from r) q where q.source_id = i.source_id
 and len(list_filter(list_slice(list_filter({words('lower(i.text)')}, lambda x: length(x) >= 3), 1, 3), lambda x: contains(q.h, x))) > 0) as cov from i),
cs as (select source_id, count(*) as total, count(*) filter (cov) as covered, round(count(*) filter (cov) / count(*), 6) as score from ic group by source_id) """


@query(f"with r as ({_REQ}), {_COVER} select source_id, total, covered, score from cs")
def coverage_by_source(spark, d):
    texts = A.requirements(spark, d).select("source_id", F.col("tr_h").alias("text"))
    return coverage.coverage_score(A.items(spark, d), texts).select("source_id", "total", "covered", "score")


@query(f"with r as (select * from ({_REQ}) where category = 'nfr_constraint'), {_COVER} select source_id, total, covered from cs")
def constraint_coverage(spark, d):
    texts = A.requirements(spark, d).filter("category = 'nfr_constraint'").select("source_id", F.col("tr_h").alias("text"))
    return coverage.coverage_score(A.items(spark, d), texts).select("source_id", "total", "covered")


_METRICS = """m as (select source_id, count(*) as total_trs, round(count(*) filter (compliant) / count(*), 6) as q_h, round(count(*) filter (complete) / count(*), 6) as q_a,
round(count(*) filter (traceable) / count(*), 6) as traceability from g group by source_id) """


@query(_FLAGS + f""", {_COVER}, {_METRICS} select m.source_id, total_trs, q_h, q_a, traceability, coalesce(score, 1.0) as coverage,
q_h >= 0.78 and q_a >= 0.85 and traceability >= 0.9 and coalesce(score, 1.0) >= 0.95 as passed from m left join cs using (source_id)""")
def review_gate(spark, d):
    rows = A.requirements(spark, d)
    cov = coverage.coverage_score(A.items(spark, d), rows.select("source_id", F.col("tr_h").alias("text")))
    return review.metrics(review.flags(rows), rows, cov)


_FLAGGED = """fl as (select source_id, tr_id from (select *, row_number() over (partition by source_id order by tr_id, ordinal) as n from g where untestable) where n <= 10
union select source_id, tr_id from (select *, row_number() over (partition by source_id order by ordinal) as n from g where not traceable) where n <= 10
union select source_id, tr_id from (select *, row_number() over (partition by source_id order by ordinal) as n from g where not complete) where n <= 10
union select source_id, tr_id from (select *, row_number() over (partition by source_id order by ordinal) as n from g where not compliant) where n <= 5) """


@query(_FLAGS + f", {_FLAGGED} select * from fl")
def flagged_ids(spark, d):
    return review.flagged_ids(_flags(spark, d))


_TOP_ISSUES = f"""te as (select source_id, ordinal, unnest({_ISSUES}) as x from g where not compliant), tn as (select source_id, x.issue as issue, count(*) as n, min(ordinal * 10 + x.p) as f from te
 group by all),
tk as (select source_id, array_to_string(list(issue order by rank), '; ') as top from (select *, row_number() over (partition by source_id order by n desc, f) as rank from tn) where rank <= 2
 group by source_id) """
_NOTES = """list_filter([case when coverage < 0.95 then concat('Coverage ', cast(round(cast(coverage as decimal(10, 6)) * 100, 0) as int), '% < 95%. Missing: ', array_to_string(un[1:3], '; ')) end,
 case when traceability < 0.9 then concat('Traceability ', cast(round(cast(traceability as decimal(10, 6)) * 100, 0) as int), '% < 90%. Fix: ', array_to_string(list_filter(string_split(untraceable,
 ','), lambda y: y <> '')[1:3], ', ')) end,
 case when q_a < 0.85 then concat('Q_A ', cast(round(cast(q_a as decimal(10, 6)), 2) as decimal(10, 2)), ' < 0.85. Fix schema for: ', array_to_string(list_filter(string_split(invalid, ','),
 lambda y: y <> '')[1:3], ', ')) end,
 case when q_h < 0.78 then concat('Q_H ', cast(round(cast(q_h as decimal(10, 6)), 2) as decimal(10, 2)), ' < 0.78. ', non_compliant, ' TRs fail EARS. Issues: ', coalesce(top, '')) end],
 lambda y: y is not null)"""


@query(_FLAGS + f""", {_COVER}, {_METRICS}, {_TOP_ISSUES}, un as (select source_id, list(text order by ordinal) filter (not cov)[1:10] as un from ic group by source_id),
ls as (select source_id, array_to_string(list(tr_id order by ordinal) filter (not traceable)[1:10], ',') as untraceable, array_to_string(list(tr_id order by ordinal) filter (not complete)[1:10],
 ',') as invalid, count(*) filter (not compliant) as non_compliant from g group by source_id),
al as (select m.source_id, q_h, q_a, traceability, coalesce(score, 1.0) as coverage, coalesce(un, []) as un, coalesce(untraceable, '') as untraceable, coalesce(invalid, '') as invalid, non_compliant,
 top
 from m left join cs using (source_id) left join un using (source_id) left join ls using (source_id) left join tk using (source_id))
select source_id, unnest({_NOTES}) as note from al""")
def correction_notes(spark, d):
    """Every note of the whole review, one a row."""
    return review.review(A.requirements(spark, d), A.items(spark, d)).select("source_id", F.explode("correction_notes").alias("note"))


_THIRD = f"(select source_id, ordinal * 30 as ordinal, tr_h as text from ({_REQ}) where cast(substring(tr_id, 4) as bigint) % 3 <> 1)"


@query(_PAIRS.format(keys="source_id, ordinal as o", part="source_id", o="ordinal", table=_THIRD, out="a.source_id", on="and a.source_id = b.source_id", final="source_id"))
def gapped_dup_pairs(spark, d):
    """Requirements whose ordinals are further apart than the horizon, as where replies held rejects."""
    rows = A.requirements(spark, d).filter("cast(substring(tr_id, 4) as bigint) % 3 <> 1").withColumn("ordinal", F.col("ordinal") * 30)
    return review.duplicates(rows)


@query(f"with r as ({_REQ}) select source_id, " + ", ".join(f"count(*) filter (category = '{c}') as {c}" for c in ("functional", "nfr_constraint", "runtime_environment", "interface_exception", "consistency_driven")) + " from r group by source_id")
def category_pivot(spark, d):
    return reports.category_counts(A.requirements(spark, d))


_ISSUE = """select concat('intra_', user_id % 30) as comparison_id, case event_id % 4 when 0 then 'conflict' when 1 then 'omission' when 2 then 'ambiguity' else 'to_confirm' end as issue_type
 from events"""


@query(f"with i as ({_ISSUE}) select comparison_id, " + ", ".join(f"count(*) filter (issue_type = '{k}') as {c}" for k, c in (("conflict", "total_conflicts"), ("omission", "total_omissions"), ("ambiguity", "total_ambiguities"), ("to_confirm", "total_to_confirm"))) + " from i group by comparison_id")
def issue_pivot(spark, d):
    issues = A.table(spark, d, "events").selectExpr("concat('intra_', user_id % 30) as comparison_id", "case event_id % 4 when 0 then 'conflict' when 1 then 'omission' when 2 then 'ambiguity' else 'to_confirm' end as issue_type")
    return consistency.report_totals(issues.select("comparison_id").distinct(), issues)


@query(f"""with e as ({_ENT}), n as (select source_id, entity_type, count(*) as n, min(ordinal) as f from e group by all), r as (select *, row_number() over (partition by source_id order by n desc,
 f) as rank from n)
select source_id, cast(rank as int) as rank, entity_type, n from r where rank <= 3""")
def entity_top3(spark, d):
    return reports.top_types(A.entities(spark, d))


_NAMES = "case n_nationkey % 4 when 0 then 'srs_' when 1 then 'user_manual_' when 2 then 'runtime_' else 'design_' end || lower(n_name)"


def _bundled(spark, d):
    n = A.table(spark, d, "nation").selectExpr(f"{_NAMES} as source_id", "n_nationkey as ordinal", "concat('region', n_regionkey) as bundle_id")
    return consistency.bundles(n.select("source_id", "ordinal"), n.select("source_id", "bundle_id"))


_ROLE_SQL = f"""with b as (select {_NAMES} as source_id, n_nationkey as ordinal, concat('region', n_regionkey) as bundle_id from nation),
k as (select * from (values {', '.join(f"('{r}', '{w}', {i})" for r, ws in consistency.ROLES.items() for i, w in enumerate(ws))}) v(role, word, p)),
r as (select bundle_id, role, source_id, row_number() over (partition by bundle_id, role order by p, ordinal) as n from b join k on contains(source_id, word)), x as (select bundle_id, role, source_id
 from r where n = 1) """


@query(_ROLE_SQL + "select * from x")
def role_lookup(spark, d):
    return consistency.roles(_bundled(spark, d))


@query(_ROLE_SQL + """, c as (select * from (values ('srs', 'manual'), ('runtime', 'srs'), ('design', 'srs')) v(p, q))
select concat(a.bundle_id, ':', p, '_vs_', q) as comparison_id, a.bundle_id, a.source_id as source_a, z.source_id as source_b from c join x a on a.role = p join x z on z.role = q
 and z.bundle_id = a.bundle_id and a.source_id <> z.source_id
union all select concat('intra_', source_id), bundle_id, source_id, source_id from b""")
def bundle_pairs(spark, d):
    return consistency.comparisons(_bundled(spark, d))


@query(f"""with e as ({_ENT}), g as (select source_id, lower(content) as term, row_number() over (partition by source_id order by ordinal) as n from e where entity_type = 'glossary_term'),
a as (select source_id, lower(content) as term, row_number() over (partition by source_id order by ordinal) as n from e where entity_type = 'actor_role'),
t as (select source_id, term, 0 as kind, n from g where n <= 20 union all select source_id, term, 1, n from a where n <= 8), f as (select term, array_to_string(list_sort(list(distinct source_id)),
 ',') as sources, min(row(source_id, kind, n)) as place from t group by term)
select cast(row_number() over (order by place) - 1 as int) as position, term, sources from f qualify row_number() over (order by place) <= 40""")
def terminology_index(spark, d):
    e = A.entities(spark, d).withColumnRenamed("content", "text")
    t = consistency.terminology(e.filter("entity_type = 'glossary_term'"), e.filter("entity_type = 'actor_role'"))
    return t.select("position", "term", F.concat_ws(",", "sources").alias("sources"))


@query(_RANK + ", c as (select source_id, entity_type, count(*) as n from r group by all) select cap, source_id, entity_type, least(n, cap) as kept from c, (select unnest([10, 20, 30, 50]) as cap)")
def cap_sweep(spark, d):
    return ranking.cap_sweep(A.entities(spark, d), [10, 20, 30, 50])


_FEEDBACK = _FLAGS + f""", {_FLAGGED}, sel as (select g.*, row_number() over (partition by source_id order by ordinal) as n from g join fl using (source_id, tr_id)),
fixed as (select source_id, tr_id, case when n <= 8 and ordinal % 2 = 0 then concat('Fixed: ', tr_h) end as new_h, tr_h from sel) """


def _feedback(spark, d, mode):
    rows = A.requirements(spark, d)
    flagged = review.flagged_ids(review.flags(rows))
    answers = feedback.split_flagged(rows, flagged)[1].filter("ordinal % 2 = 0").select("source_id", "tr_id", F.concat(F.lit("Fixed: "), "tr_h").alias("tr_h"))
    return feedback.merge(rows, flagged, answers, PipelineConfig(feedback_mode=mode)).select("source_id", "tr_id", "tr_h")


@query(_FEEDBACK + "select source_id, tr_id, tr_h from g anti join fl using (source_id, tr_id) union all select source_id, tr_id, coalesce(new_h, tr_h) from fixed")
def feedback_keep(spark, d):
    return _feedback(spark, d, "keep")


@query(_FEEDBACK + "select source_id, tr_id, tr_h from g anti join fl using (source_id, tr_id) union all select source_id, tr_id, new_h from fixed where new_h is not null")
def feedback_reference(spark, d):
    return _feedback(spark, d, "reference")


@query("select event_id, json_extract_string(props, '$.k') as k from events where json_valid(props)")
def lenient_json(spark, d):
    reply = F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n```\ndone"))
    rows = A.table(spark, d, "events").select("event_id", F.explode(R.reply_items(reply)).alias("item"))
    return rows.select("event_id", F.try_variant_get("item", "$.k", "string").alias("k"))


_VERDICT = "case turn % 6 when 0 then 'Supported.' when 1 then 'I say UNSUPPORTED' when 2 then 'PARTIALLY_SUPPORTED, as' when 3 then 'ERROR: 500' when 4 then 'no idea' else 'SUPPORTED' end"


@query(f"""with v as (select upper({_VERDICT}) as u, {_VERDICT} as raw from conversations), k as (select case when starts_with(raw, 'ERROR:') then 'ERROR' when contains(u,
 'PARTIALLY_SUPPORTED') then 'PARTIALLY_SUPPORTED' when contains(u, 'UNSUPPORTED') then 'UNSUPPORTED'
when contains(u, 'SUPPORTED') then 'SUPPORTED' else 'UNPARSEABLE' end as kind from v), n as (select kind, count(*) as n from k group by kind)
select e.kind, coalesce(n, 0) as n, round(coalesce(n, 0) / (select count(*) from k), 6) as share from (select unnest(['SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'UNPARSEABLE',
 'ERROR']) as kind) e left join n using (kind)""")
def verdict_hist(spark, d):
    v = A.table(spark, d, "conversations").select(Q.verdict(F.expr(_VERDICT)).alias("verdict"))
    return reports.verdict_summary(v)


@query(f"with r as ({_REQ}), w as (select *, row_number() over (partition by source_id order by ordinal) as n from r) select source_id, tr_id from w where n <= 30 and ordinal % 3 <> 0")
def resume_anti(spark, d):
    rows = A.requirements(spark, d)
    done = rows.filter("ordinal % 3 = 0").select("source_id", "tr_id")
    return sinks.resume(rows, done).select("source_id", "tr_id")


@query(_FLAGS + "select cast(s.score as int) as score, count(g.tr_id) as n from (select unnest(range(7)) as score) s left join g on g.ears_score = s.score group by s.score")
def score_distribution(spark, d):
    return reports.score_distribution(_flags(spark, d), "ears_score")


@query("select count(*) as documents, sum(n_chars) as n_chars from documents")
def grand_totals(spark, d):
    return reports.totals(A.table(spark, d, "documents"), ["n_chars"])


from tessera import catalog_steps  # noqa: E402, F401  registers more queries here
