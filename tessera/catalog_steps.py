"""More named queries: loaders, chunks, reply parsing, model-backed steps with the offline client, and the whole review.

The tables they read are derived from the driver's by fixed templates, in SQL that Spark and DuckDB both read where possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera import schemas
from tessera.catalog import _COVER, _ENT, _FLAGGED, _FLAGS, _METRICS, _NAMES, _NOTES, _RANK, _REQ, _ROLE_SQL, _TOP_ISSUES, ORACLES, QUERIES, words
from tessera.functions import quality as Q
from tessera.functions import text as T
from tessera.operators import chunking, consistency, demand, feedback, judging, ranking, reports, requirements, review, similarity, sinks
from tessera.operators import model as M
from tessera.plans import pipeline
from tessera.plans.storage import scratch_path
from tessera.sources import sections as S

NAMES: list[str] = []
LINE_END = r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"
SAT = "When requested, the system shall satisfy: "


def query(sql: str):
    def add(f):
        NAMES.append(f.__name__)
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def put(e: str, x: str) -> str:
    """The expression with x in its place."""
    return e.replace("{}", x)


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(c, sep).alias(c)


# ---- texts, chunks and sections

_MODES = {
    "sentence": "string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))",
    "line": f"string_split_regex({{}}, '{LINE_END}')",
    "element": "string_split(replace({}, '[', chr(1) || '['), chr(1))",
}
_UNITS = {k: f"list_filter(list_transform({v}, lambda y: {strip('y')}), lambda y: y <> '')" for k, v in _MODES.items()}


@query("select doc_id, " + ", ".join(f"len({put(e, 'text')}) as {k}" for k, e in _UNITS.items()) + " from documents")
def units_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", *[F.size(T.split_units("text", F.lit(k))).alias(k) for k in _UNITS])


@query(f"""with r as (select event_id, concat('  ', event_type, '  ', chr(10), chr(10), chr(10), chr(10), props, case when event_id % 3 = 0 then concat(' ', chr(9), chr(10)) else '' end) as x
 from events)
select event_id, md5({strip("regexp_replace(regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\x0B\\f\\r]+(\\n|$)', '\\1', 'g')")}) as cleaned from r""")
def cleaned_texts(spark, d):
    x = "concat('  ', event_type, '  \\n\\n\\n\\n', props, case when event_id % 3 = 0 then ' \\t\\n' else '' end) as x"
    return A.table(spark, d, "events").selectExpr("event_id", x).select("event_id", F.md5(T.clean("x").cast("binary")).alias("cleaned"))


_CHUNKS = f"""with recursive s as (select source, doc_id, text, cast(substring(source, 4) as int) % 4 as k from documents where coalesce(text, '') <> ''),
b as (select *, case k when 2 then 256 when 3 then 384 else 512 end as most, case k when 2 then 26 when 3 then 38 else 51 end as over, len({words('text')}) as n from s),
u as (select source, doc_id, most, over, case k when 2 then {put(_UNITS['line'], 'text')} when 3 then {put(_UNITS['element'], 'text')} else {put(_UNITS['sentence'], 'text')} end as un from b
 where n > most),
z as (select source, doc_id, most, over, len(un) as m, list_transform(un, lambda y: len({words('y')})) as ns, list_transform(un, lambda y: length(y)) as cs from u),
p as (select source, doc_id, most, over, m, list_transform(range(0, m + 1), lambda i: coalesce(list_sum(ns[1:i]), 0)) as pn, list_transform(range(0, m + 1), lambda i: coalesce(list_sum(cs[1:i]),
 0)) as pc from z),
c(source, doc_id, most, over, m, pn, pc, i, tn, tc, idx, words, seeded, chars) as (
 select source, doc_id, most, over, m, pn, pc, cast(1 as bigint), cast(null as hugeint), cast(null as hugeint), 0, cast(null as hugeint), false, cast(null as hugeint) from p
 union all
 select source, doc_id, most, over, m, pn, pc, j + 1, case when t > j and not whole then null else pn[j + 1] - pn[t] + case when whole then tn else 0 end end,
  case when t > j and not whole then null else pc[j + 1] - pc[t] + greatest(j - t, 0) + case when whole then tc + 1 else 0 end end, idx + 1, w + pn[j + 1] - pn[i], w > 0, pc[j + 1] - pc[i] + (j - i) +
 case when w > 0 then tc + 1 else 0 end
 from (select *, t = i and w > 0 and pn[j + 1] - pn[i] + tn <= over as whole from (select *, list_min(list_filter(range(i, j + 2), lambda x: pn[j + 1] - pn[x] <= over)) as t
  from (select *, greatest(i, coalesce(list_max(list_filter(range(i, m + 1), lambda x: w + pn[x + 1] - pn[i] <= most)), i)) as j
   from (select *, case when tn is not null and tn + pn[i + 1] - pn[i] <= most then tn else 0 end as w from c where i <= m)))) as step),
chunk as (select source as source_id, doc_id as section_id, idx as chunk_index, words as token_count, seeded as overlap, chars from c where idx > 0
 union all select source, doc_id, 1, n, false, length(text) from b where n <= most) """


@query(_CHUNKS + "select printf('%s__s%04d__c%04d', source_id, section_id, chunk_index) as chunk_id, source_id, cast(chars as int) as chars, cast(section_id as int) as section_id, cast(chunk_index as int) as chunk_index, cast(token_count as int) as token_count, overlap from chunk")
def greedy_chunks(spark, d):
    return chunking.chunk(A.sections(spark, d)).select("chunk_id", "source_id", F.length("content").alias("chars"), "metadata.section_id", "metadata.chunk_index", "metadata.token_count", "metadata.overlap")


@query(_CHUNKS + """select source_id, count(*) as chunks, cast(min(token_count) as int) as min_tokens, cast(max(token_count) as int) as max_tokens,
 cast(sum(token_count) as double) / count(*) as mean_tokens,
count(*) filter (overlap) as overlapping, count(*) filter (token_count < 20) / count(*) > 0.4 as too_many_tiny from chunk group by source_id""")
def chunk_statistics(spark, d):
    return chunking.chunk_stats(chunking.chunk(A.sections(spark, d)))


_HEAD = """s <> '' and length(s) <= 100 and (regexp_matches(s, '^([0-9]+[.0-9]*|Chapter\\s+[0-9]+|Appendix\\s+[A-Z])\\s+\\S') or regexp_matches(after, '^[=\\-*]{4,}$')
 or (s = upper(s) and s <> lower(s) and length(s) between 4 and 60) or (length(s) < 60 and not regexp_matches(s, '[.,]$') and regexp_matches(s, '^[A-Z][^\\n]{3,59}$') and length(s) - length(replace(s,
 ' ', '')) < 8))"""
_SECTIONS = f"""with l as (select doc_id, i, ls[i] as line, {strip('ls[i]')} as s from (select *, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split_regex(text, '{LINE_END}') as ls
 from {{table}}))),
a as (select *, coalesce(lead(s) over (partition by doc_id order by i), '') as after from l),
h as (select *, {_HEAD} as head from a), k as (select *, sum(cast(head as int)) over (partition by doc_id order by i) as block from h),
b as (select doc_id, block, coalesce(max(s) filter (head), 'Introduction') as ref,
 {strip("regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (not head and not regexp_matches(s, '^[=\\-*]{4,}$')), ''), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\x0B\\f\\r]+(\\n|$)', '\\1', 'g')")} as t from k group by doc_id, block),
e as (select doc_id, list({{'m': [{{'ref': ref, 't': t, 'n': len({words('t')})}}]}} order by block) as es from b where t <> '' group by doc_id),
f as (select doc_id, list_reduce(es, lambda q, x: case when q.m[len(q.m)].n + x.m[1].n < 150
  then {{'m': list_append(q.m[1 : len(q.m) - 1], {{'ref': q.m[len(q.m)].ref, 't': q.m[len(q.m)].t || chr(10) || chr(10) || x.m[1].t, 'n': q.m[len(q.m)].n + x.m[1].n}})}} else {{'m': list_concat(q.m,
 x.m)}} end).m as m from e) """
_LINED = "(select doc_id, case doc_id % 3 when 0 then regexp_replace(text, '[.] ', '.' || chr(10) || chr(10) || chr(10) || '1.' || cast(doc_id as varchar) || ' Scope' || chr(10), 'g') else text end as text from documents where text is not null)"


_SMALLEST = "list_position(list_transform(range(1, len(m)), lambda q: m[q].n + m[q + 1].n), list_min(list_transform(range(1, len(m)), lambda q: m[q].n + m[q + 1].n)))"
_SHRUNK = _SECTIONS.replace("with l as", "with recursive l as", 1).replace("{table}", _LINED) + f""", j(doc_id, m) as (select doc_id, m from f union all
 select doc_id, list_concat(m[1 : k - 1], [{{'ref': m[k].ref, 't': m[k].t || chr(10) || chr(10) || m[k + 1].t, 'n': m[k].n + m[k + 1].n}}], m[k + 2 :]) from (select *, {_SMALLEST} as k from j
 where len(m) > 150)),
x as (select concat('doc', cast(doc_id as varchar)) as source_id, 'srs' as artifact_type, cast(i as int) as section_id, substring(m[i].ref, 1, 80) as section_ref, md5(m[i].t) as text from (select *,
 unnest(range(1, len(m) + 1)) as i from j where len(m) <= 150)) """


@query(_SHRUNK + "select * from x")
def text_sections(spark, d):
    """Sections of all documents; of those with more than 150 the smallest neighbours are joined."""
    lined = "case doc_id % 3 when 0 then regexp_replace(text, '[.] ', concat('.\\n\\n\\n1.', cast(doc_id as string), ' Scope\\n')) else text end as text"
    docs = A.table(spark, d, "documents").selectExpr("concat('doc', doc_id) as source_id", "'srs' as artifact_type", lined)
    return S.text_sections(docs).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(_SHRUNK + "select source_id, section_id, section_ref, text from x")
def lateral_sections(spark, d):
    """The same by the table function, in SQL."""
    S.register_functions(spark)
    A.table(spark, d, "documents").createOrReplaceTempView("documents")
    return spark.sql(r"""select concat('doc', doc_id) as source_id, s.section_id, s.section_ref, md5(cast(s.text as binary)) as text from documents,
      lateral document_sections(encode(case doc_id % 3 when 0 then regexp_replace(text, '[.] ', concat('.\n\n\n1.', cast(doc_id as string), ' Scope\n')) else text end, 'UTF-8'), 'txt') s""")


_PLAIN_LINES = "string_split(regexp_replace(text, '[^\\x20-\\x7E\\xA1-\\x{17F}\n]', '', 'g'), chr(10))"


@query(f"""with l as (select doc_id, i, trim(ls[i], ' ') as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, {_PLAIN_LINES} as ls from documents
 where text is not null)))
select concat('doc', cast(doc_id as varchar)) as source_id, 1 as page, cast(row_number() over (partition by doc_id order by i) as int) as pos, 11.0::double as size, 16 as flags, md5(line) as text
 from l where line <> ''""")
def pdf_spans(spark, d):
    """Documents as PDF files of one page, a line each, in a font with codes of two bytes; their spans."""
    lines = F.transform(F.split(F.regexp_replace("text", r"[^\x20-\x7E\xA1-\x{17F}\n]", ""), "\n"), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*")))
    head = (
        "%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 6 0 R /Resources <</Font <</F1 4 0 R>>>>>> endobj\n"
        "4 0 obj <</Type /Font /Subtype /Type0 /BaseFont /Some-Bold /Encoding /Identity-H /ToUnicode 5 0 R>> endobj\n5 0 obj <</Length 46>> stream\n1 beginbfrange <0020> <017F> <0020> endbfrange\nendstream endobj\n"
    )
    content = F.concat(F.lit("BT /F1 11 Tf 13 TL 40 800 Td\n"), F.array_join(lines, "\n"), F.lit("\nET"))
    raw = F.concat(F.lit(head + "6 0 obj <</Length "), F.length(content).cast("string"), F.lit(">> stream\n"), content, F.lit("\nendstream endobj\ntrailer <</Root 1 0 R>>"))
    docs = A.table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("doc"), "doc_id").alias("source_id"), F.lit("srs").alias("artifact_type"), F.lit("pdf").alias("ext"), raw.cast("binary").alias("content"))
    found = S.LoaderRegistry().parsed(docs).filter("kind = 'span'")
    return found.select("source_id", "page", "pos", "size", "flags", F.md5(F.col("text").cast("binary")).alias("text"))


def _files(spark, d, ext: str, content: str) -> DataFrame:
    """Nations as files of a kind."""
    return A.table(spark, d, "nation").selectExpr("lower(n_name) as source_id", f"'{ext}' as ext", "'srs' as artifact_type", f"cast({content} as binary) as content")


def _parsed(rows: DataFrame) -> DataFrame:
    return S.LoaderRegistry().parsed(rows).filter("error is null").select("source_id", "section_id", "section_ref", "text")


@query("""select lower(n_name) as source_id, 1 as section_id, 'json:name' as section_ref, concat('"', n_name, '"') as text from nation union all
select lower(n_name), 2, 'json:key', cast(n_nationkey as varchar) from nation union all select lower(n_name), 3, 'json:more',
 concat('{', chr(10), '  "region": [', chr(10), '    ', n_regionkey, chr(10), '  ]', chr(10), '}') from nation""")
def json_sections(spark, d):
    return _parsed(_files(spark, d, "json", "concat('{\"name\": \"', n_name, '\", \"key\": ', n_nationkey, ', \"more\": {\"region\": [', n_regionkey, ']}}')"))


@query("""select lower(n_name) as source_id, 1 as section_id, 'openapi:info' as section_ref, concat('API: ', n_name, chr(10), 'Version: 1', chr(10), 'Description:', chr(10), 'Base path: /v',
 n_regionkey, chr(10), 'Host:') as text from nation union all
select lower(n_name), 2, concat('openapi:path:/', n_name), concat('Endpoint: /', n_name, chr(10), '  Method: GET', chr(10), '  Summary: read', chr(10), '  Description:', chr(10), '  Tags: a, b',
 chr(10), '  Parameters:', chr(10), '    - id (path, integer, required=True)', chr(10), '  Responses:', chr(10), '    - 200: ok', chr(10), '    - 404: none') from nation union all
select lower(n_name), 3, 'openapi:schema:Pet', concat('Schema: Pet', chr(10), 'Description: an animal', chr(10), '  - k', n_nationkey, ' (string): its key') from nation""")
def api_sections(spark, d):
    spec = """concat('{"swagger": "2.0", "info": {"title": "', n_name, '", "version": "1"}, "basePath": "/v', n_regionkey, '", "paths": {"/', n_name,
    '": {"get": {"summary": "read", "tags": ["a", "b"], "parameters": [{"name": "id", "in": "path", "type": "integer", "required": true}], "responses": {"200": {"description": "ok"}, "404": {"description": "none"}}}, "note": 5}},
    "definitions": {"Pet": {"description": "an animal", "properties": {"k', n_nationkey, '": {"type": "string", "description": "its key"}}}}}')"""
    return _parsed(_files(spark, d, "json", spec))


@query("""select lower(n_name) as source_id, 1 as section_id, 'xml:class' as section_ref, concat('[class] name=', n_name, ', kind=T', chr(10), '[attr:a', n_nationkey, '] text') as text from nation
 union all
select lower(n_name), 2, 'xml:note', concat('[note] r', n_regionkey) from nation""")
def xml_sections(spark, d):
    return _parsed(_files(spark, d, "xml", "concat('<m xmlns:x=\"u\"><class name=\"', n_name, '\" x:type=\"T\"><attr x:id=\"a', n_nationkey, '\"> text </attr></class><!-- c --><note>r', n_regionkey, '</note></m>')"))


@query("""select lower(n_name) as source_id, 1 as section_id, concat('puml:class ', n_name,
 ' {') as section_ref, concat('class ', n_name, ' {', chr(10), '  id', chr(10), '}') as text from nation union all
select lower(n_name), 2, concat('puml:package P', n_regionkey, ' {'), concat('package P', n_regionkey, ' {', chr(10), ''' a longer remark', chr(10), '}') from nation""")
def diagram_sections(spark, d):
    text = "concat('@startuml\\n\\' --- x\\nclass ', n_name, ' {\\n  id\\n}\\npackage P', n_regionkey, ' {\\n\\' a longer remark\\n}')"
    return S.diagram_sections(A.table(spark, d, "nation").selectExpr("lower(n_name) as source_id", "'srs' as artifact_type", f"{text} as text")).drop("artifact_type")


_SPANS = """select concat('pdf', cast(event_id % 5 as {s})) as source_id, 'srs' as artifact_type, cast(floor(event_id / 100) as int) as page, cast(event_id % 100 as int) as pos,
 case when event_id % 5 = 4 then case when event_id % 2 = 0 then 20.0 else 10.0 end when floor(event_id / 5) % 9 = 2 then 14.0 else 10.0 end as size, case
 when floor(event_id / 5) % 11 = 3 then 16 else 0 end as flags,
 case when floor(event_id / 5) % 18 = 2 then concat('* bulleted ', event_type, ' text') else concat('Line ', cast(event_id as {s}), ' about ', event_type) end as text from events"""


@query(f"""with s as ({_SPANS.format(s='varchar')}), b as (select source_id, median(size) as body from s group by source_id), j as (select s.*, size >= 1.2 * body as big from s
 join b using (source_id)),
dk as (select source_id, count(*) filter (big) > 0.4 * count(*) as deck from j group by source_id),
h as (select *, (big or flags & 16 <> 0) and length(text) between 15 and 150 and not regexp_matches(text, '^[*\\-+#>•·]') and not deck as head from j join dk using (source_id)),
k as (select *, coalesce(sum(cast(head as int)) over (partition by source_id order by page, pos), 0) as block from h),
g as (select source_id, block, coalesce(max(text) filter (head), 'Preamble') as ref, coalesce(max(page) filter (head), 1) as page,
 {strip("coalesce(string_agg(text, chr(10) order by page, pos) filter (not head), '')")} as t from k group by source_id, block),
f as (select * from g where t <> ''), many as (select source_id from f join dk using (source_id) where not deck group by source_id having count(*) >= 3)
select source_id, cast(row_number() over (partition by source_id order by block) as int) as section_id, concat(substring(ref, 1, 80), ' (p.', page, ')') as section_ref, t as text from f semi
 join many using (source_id)
union all select source_id, page, concat('page ', page), {strip('string_agg(text, chr(10) order by pos)')} from h anti join many using (source_id) group by source_id, page""")
def span_sections(spark, d):
    A.table(spark, d, "events").createOrReplaceTempView("events")
    return S.span_sections(spark.sql(_SPANS.format(s="string"))).select("source_id", "section_id", "section_ref", "text")


_LINES_OF = f"select doc_id, i, trim(ls[i], ' ') as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, {_PLAIN_LINES} as ls from documents where text is not null))"


@query(f"""with l as (select doc_id, line, row_number() over (partition by doc_id order by i) - 1 as i from ({_LINES_OF}) where line <> ''),
b as (select doc_id, cast(floor(i / 4) as int) as block, max(line) filter (i % 4 = 0) as ref, coalesce(string_agg(line, chr(10) order by i) filter (i % 4 > 0), '') as t from l group by doc_id, block)
select concat('doc', cast(doc_id as varchar)) as source_id, cast(row_number() over (partition by doc_id order by block) as int) as section_id, md5(concat('H1: ', ref)) as section_ref, md5(t) as text
 from b where t <> ''""")
def word_processor_sections(spark, d):
    """Documents as word processor files whose every fourth line is a heading; their sections."""

    def write(batches):
        import html
        import io
        import zipfile

        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        for pdf in batches:
            out = []
            for lines in pdf["lines"]:
                body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{"h1" if i % 4 == 0 else "plain"}"/></w:pPr><w:r><w:t>{html.escape(x)}</w:t></w:r></w:p>' for i, x in enumerate(lines))
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
                    z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>')
                out.append(raw.getvalue())
            yield pdf[["source_id"]].assign(artifact_type="srs", ext="docx", content=out)

    plain = F.split(F.regexp_replace("text", r"[^\x20-\x7E\xA1-\x{17F}\n]", ""), "\n")
    lines = F.filter(F.transform(plain, lambda x: F.trim(x)), lambda x: x != "").alias("lines")
    docs = A.table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("doc"), "doc_id").alias("source_id"), lines)
    files = docs.mapInPandas(write, "source_id string, artifact_type string, ext string, content binary")
    hashed = [F.md5(F.col(c).cast("binary")).alias(c) for c in ("section_ref", "text")]
    return _parsed(files).select("source_id", "section_id", *hashed)


_SOME_WORDS = "trim(concat('first ', regexp_replace(substring(text, {at}, 60), '[^A-Za-z0-9 ]', ''{g})))"


@query(f"""with t as (select doc_id, {_SOME_WORDS.format(at=1, g=", 'g'")} as a, {_SOME_WORDS.format(at=30, g=", 'g'")} as b from documents where text is not null)
select concat('doc', cast(doc_id as varchar)) as source_id, 1 as section_id, 'xml:head' as section_ref, concat('[head] name=d', doc_id, chr(10), '[t] ', a) as text from t
union all select concat('doc', cast(doc_id as varchar)), 2, 'xml:body', concat('[b] ', b, ' & more') from t""")
def mended_xml_sections(spark, d):
    """Documents as XML files that break in the middle."""
    a, b = (_SOME_WORDS.format(at=k, g="") for k in (1, 30))
    raw = f"concat('<doc><head name=d', doc_id, '><t>', {a}, '</t></wrong></head><body><b>', {b}, ' & more')"
    docs = A.table(spark, d, "documents").filter("text is not null").selectExpr("concat('doc', doc_id) as source_id", "'srs' as artifact_type", "'xml' as ext", f"cast({raw} as binary) as content")
    return _parsed(docs)


# ---- stage tables


@query(f"with r as ({_REQ}) select source_id, ordinal, tr_id, category from r where category <> 'consistency_driven'")
def stored_requirements(spark, d):
    path = scratch_path(spark, "stored")
    sinks.save(A.requirements(spark, d).select("source_id", "ordinal", "tr_id", "category"), path, json=True)
    return sinks.load(spark, path, "source_id string, ordinal int, tr_id string, category string", True, {"category": schemas.TR_CATEGORIES[:4]}, ("tr_id",))


@query(f"with r as ({_REQ}) select source_id, tr_id from r where cast(substring(source_id, 4) as int) % 3 <> 1")
def pending_sources(spark, d):
    rows = A.requirements(spark, d)
    return sinks.pending(rows, rows.filter("cast(substring(source_id, 4) as int) % 3 = 1")).select("source_id", "tr_id")


@query(f"with r as ({_REQ}) select source_id, tr_id, case when cast(substring(source_id, 4) as int) % 2 = 0 then 'final' else 'stage' end as origin from r where cast(substring(source_id, 4) as int) % 2 = 1 or ordinal % 3 = 0")
def final_else_stage(spark, d):
    rows = A.requirements(spark, d).select("source_id", "ordinal", "tr_id")
    final = rows.filter("cast(substring(source_id, 4) as int) % 2 = 0 and ordinal % 3 = 0").withColumn("origin", F.lit("final"))
    return reports.latest(final, rows.withColumn("origin", F.lit("stage"))).select("source_id", "tr_id", "origin")


_PASS = "q_h >= 0.4 and q_a >= 0.8 and traceability >= 0.9"


@query(_FLAGS + f", {_METRICS} select count(*) filter ({_PASS}) as passing, count(*) as documents from m")
def passing_documents(spark, d):
    from tessera.config import PipelineConfig

    rows = A.requirements(spark, d)
    return reports.passing(review.metrics(review.flags(rows), rows, None, PipelineConfig(q_h=0.4, q_a=0.8)))


@query(_FLAGS + f", {_METRICS} select g.source_id, g.tr_id, m.q_h from g join m using (source_id) where not ({_PASS})")
def rows_of_failing_sources(spark, d):
    from tessera.config import PipelineConfig

    rows = A.requirements(spark, d)
    m = review.metrics(review.flags(rows), rows, None, PipelineConfig(q_h=0.4, q_a=0.8))
    return rows.join(m.filter("not passed").select("source_id", "q_h"), "source_id").select("source_id", "tr_id", "q_h")


# ---- predicates and replies

_RAW = "case event_id % 6 when 0 then 'function_point' when 1 then 'constraint' when 2 then 'Weird' when 3 then '' when 4 then 'actor_role' end"
_SCORE = "case event_id % 5 when 0 then null when 1 then 1.5 when 2 then -0.5 else 0.4 end"


@query(f"select event_id, {_RAW} as entity_type, cast(greatest(0, least(1, coalesce({_SCORE}, 0.8))) as double) as confidence_score from events where {_RAW} in ('function_point', 'constraint', 'actor_role') and event_id % 7 <> 0")
def cleaned_entities(spark, d):
    raw = A.table(spark, d, "events").selectExpr("event_id", f"{_RAW} as entity_type", "case when event_id % 7 = 0 then ' \\n' else event_type end as content", f"cast({_SCORE} as double) as confidence_score")
    return ranking.clean_entities(raw).select("event_id", "entity_type", "confidence_score")


_KIND = "case event_id % 5 when 0 then 'conflict' when 1 then 'omission' when 2 then 'Conflict' when 3 then 'to_confirm' end"
_SEVERE = "case event_id % 7 when 0 then 'blocker' when 1 then 'Major' when 2 then 'major' when 3 then 'minor' end"


@query(f"""with e as (select concat('intra_', user_id % 30) as comparison_id, {_KIND} as kind, {_SEVERE} as severe, event_type, row_number() over (partition by user_id % 30 order by event_id) - 1 as n
 from events)
select comparison_id, cast(n as int) as ordinal, printf('ISS-%03d', n + 1) as issue_id, coalesce(kind, 'to_confirm') as issue_type, coalesce(severe, 'minor') as severity, concat('see ',
 event_type) as description from e
where n < 20 and coalesce(kind, '') <> 'Conflict' and coalesce(severe, '') <> 'Major'""")
def parsed_issues(spark, d):
    e = A.table(spark, d, "events").selectExpr("concat('intra_', user_id % 30) as comparison_id", "event_id", f"{_KIND} as issue_type", f"{_SEVERE} as severity", "concat('see ', event_type) as description")
    item = F.struct("event_id", F.struct("issue_type", "severity", "description").alias("x"))
    reply = F.concat(F.lit("Found:\n```json\n"), F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"])), F.lit("\n```"))
    replies = e.groupBy("comparison_id").agg(reply.alias("reply")).withColumns({"source_a": F.lit("a"), "source_b": F.lit("a")})
    return consistency.parse_issues(replies).select("comparison_id", "ordinal", "issue_id", "issue_type", "severity", "description")


_CAT = "case floor(event_id / 40) % 5 when 0 then 'functional' when 1 then 'nfr_constraint' when 2 then 'runtime_environment' when 3 then 'interface_exception' else 'consistency_driven' end"
_CODE = "case k when 0 then 'FUNC' when 1 then 'NFR_' when 2 then 'RUNT' when 3 then 'INTE' else 'CONS' end"


@query(f"""with e as (select concat('source', event_id % 40) as source_id, cast(floor(event_id / 40) % 5 as int) as k, {_CAT} as category, event_id, event_type from events),
c as (select *, row_number() over (partition by source_id, k order by event_id) as p from e), n as (select *, row_number() over (partition by source_id order by k, p) as ordinal from c where p <= 50)
select source_id, cast(ordinal as int) as ordinal, upper(concat('source', '-', {_CODE}, '-', printf('%03d', ordinal))) as tr_id, category, concat('The system shall ', event_type) as tr_h, case
 when event_id % 3 = 0 then 'low' else 'medium' end as priority,
event_type as stimuli, concat('R', event_id) as ids from n where event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0""")
def built_requirements(spark, d):
    e = A.table(spark, d, "events").selectExpr(
        "concat('source', event_id % 40) as source_id", f"{_CAT} as category", "event_id", "case when event_id % 11 = 0 then '  ' else concat('The system shall ', event_type) end as tr_h",
        "case when event_id % 13 = 0 then 'High' when event_id % 3 = 0 then 'low' end as priority", "array(event_type, '') as stimuli", "concat('R', event_id) as source_req",
    )
    whole = F.to_json(F.struct("tr_h", "priority", F.struct("stimuli").alias("tr_a"), "source_req"))
    text = F.when(F.col("event_id") % 17 == 0, F.lit("7")).otherwise(whole)
    reply = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), ","), F.lit("]"))
    rows = requirements.build(e.groupBy("source_id", "category").agg(reply.alias("reply")))
    return rows.select("source_id", "ordinal", "tr_id", "category", "tr_h", "tr_a.priority", F.array_join("tr_a.stimuli", "|").alias("stimuli"), F.array_join("source_req_ids", "|").alias("ids"))


@query("""select event_id, case when event_id % 3 = 0 then case when event_id % 2 = 0 then concat('B', event_id) end else concat('A', event_id, case
 when event_id % 5 = 0 then ' / C' else '' end) end as source from events""")
def source_texts(spark, d):
    first = "case when event_id % 3 = 0 then array(' ', '') else array(concat('A', event_id), ' ', case when event_id % 5 = 0 then 'C' else '' end) end as a"
    other = "case when event_id % 2 = 0 then array(concat('B', event_id)) else cast(array() as array<string>) end as b"
    return A.table(spark, d, "events").selectExpr("event_id", first, other).select("event_id", T.joined_source("a", "b").alias("source"))


_MARKS = [f"case when event_id % {k} = 0 then '{a}' else '{b}' end" for k, a, b in ((2, "PASS", "fail"), (3, "passed", "FAIL"), (5, "FAIL", "pass"), (7, "no", "PASS."), (2, "x", "PASS"), (3, "PASS", "-"), (1, "PASS", "PASS"))]


@query("select event_id, " + " + ".join(f"cast(starts_with(upper({m}), 'PASS') as int)" for m in _MARKS[:6]) + " as passes from events")
def judge_passes(spark, d):
    reply = "concat_ws(' ', " + ", ".join(_MARKS) + ") as reply"
    return A.table(spark, d, "events").selectExpr("event_id", reply).select("event_id", Q.passes_in("reply").alias("passes"))


_CUT = "substring(concat('Reply: [{\"k\": 1}, {\"k\": 22}, {\"k\": 333}', case when event_id % 4 = 0 then ']' else ', {\"k\"' end), 1, cast(20 + event_id % 40 as int))"


@query(f"select event_id, len(regexp_extract_all({_CUT}, '\\{{\"k\": \\d+\\}}')) as n from events where len(regexp_extract_all({_CUT}, '\\{{\"k\": \\d+\\}}')) > 0")
def salvaged_objects(spark, d):
    replies = A.table(spark, d, "events").selectExpr("event_id", f"{_CUT} as reply")
    return judging.salvaged(replies, ["event_id"]).groupBy("event_id").agg(F.count("*").alias("n"))


@query("select r_regionkey, coalesce(string_agg('- ' || n_name, chr(10) order by n_nationkey), '(none)') as prompt from region left join nation on n_regionkey + 1 = r_regionkey group by r_regionkey")
def bullet_lists(spark, d):
    n = A.table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    r = A.table(spark, d, "region")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"] + 1, "left").select("r_regionkey", T.bullets("names").alias("prompt"))


_REPLY = "case event_id % 4 when 0 then '' when 1 then props when 2 then concat(event_type, chr(65533)) else concat('I found ', event_type) end"


@query("select event_id, case event_id % 4 when 0 then 'empty' when 1 then 'json' when 2 then 'corrupt' else 'text' end as health from events")
def model_health(spark, d):
    reply = "case event_id % 4 when 0 then '' when 1 then props when 2 then concat(event_type, decode(unhex('EFBFBD'), 'UTF-8')) else concat('I found ', event_type) end as reply"
    return A.table(spark, d, "events").selectExpr("event_id", reply).select("event_id", M.health("reply").alias("health"))


# ---- model-backed steps, answered by rules

_PATTERNS = M.ENTITY_RULES


@query(f"""with r as ({_REQ}), s as (select *, cast(floor(ordinal / 10) as int) as b from r),
k as (select source_id, b, ordinal, tr_h, case {' '.join(f"when regexp_matches(tr_h, '{p}', 'i') then '{n}'" for n, p in _PATTERNS)} end as entity_type from s)
select source_id, cast(row_number() over (partition by source_id order by b, ordinal) - 1 as int) as ordinal, entity_type, array_to_string({words('tr_h')}[1:20], ' ') as content,
 cast(0.8 as double) as confidence_score from k where entity_type is not null""")
def extracted_entities(spark, d):
    rows = A.requirements(spark, d).withColumn("b", F.floor(F.col("ordinal") / 10).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "tr_h"))), lambda x: x["tr_h"]), "\n")
    sections = rows.groupBy("source_id", "b").agg(text.alias("text")).selectExpr("source_id", "'srs' as artifact_type", "b as section_id", "'r' as section_ref", "text")
    return demand.extract_entities(chunking.chunk(sections), M.RuleClient()).select("source_id", "ordinal", "entity_type", "content", "confidence_score")


_TOP = f"""{_RANK}, e1 as ({_ENT}), o as (select *, row_number() over (partition by source_id order by confidence_score desc, ordinal) as n from e1 where entity_type = 'function_point'),
g1 as (select source_id, ordinal, case when contains(content, ':') then trim(split_part(content, ':', 1)) else substring(content, 1, 40) end as term, case when contains(content,
 ':') then trim(substring(content, strpos(content, ':') + 1)) else content end as definition from e1 where entity_type = 'glossary_term'),
w as (select *, regexp_matches(content, '[0-9]') as timed from r where entity_type = 'constraint' and rank <= 20), w1 as (select *, row_number() over (partition by source_id, timed order by rank) as i
 from w) """


@query(_TOP + """select source_id, 'objective' as field, cast(min(n) as int) as ordinal, null as item_id, content as text from o where n <= 8 group by source_id, content
union all select source_id, 'glossary', cast(min(ordinal) as int), term, arg_max(definition, ordinal) from g1 group by source_id, term
union all select source_id, 'role', cast(rank - 1 as int), null, trim(content) from r where entity_type = 'actor_role' and rank <= 10
union all select source_id, 'use_case', cast(rank - 1 as int), printf('UC-%03d', rank), trim(content) from r where entity_type = 'function_point' and rank <= 10
union all select source_id, case when timed then 'nfr' else 'runtime' end, cast(i - 1 as int), concat(case when timed then 'NFR' else 'RT' end, printf('-%03d', i)), trim(content) from w1
 where i <= 10""")
def demand_model(spark, d):
    return demand.demand_items(A.entities(spark, d), M.RuleClient()).filter("field <> 'functional'").select("source_id", "field", "ordinal", "item_id", "text")


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> ''))"
_ALIKE = "len(list_intersect(" + _TOKENS.format("q.t") + ", " + _TOKENS.format("x.t") + ")) / len(list_distinct(list_concat(" + _TOKENS.format("q.t") + ", " + _TOKENS.format("x.t") + "))) > 0.75"
_MERGE = f"""h as (select source_id, list({{'i': i, 't': t}} order by i) as todo from base group by source_id),
m(source_id, todo, i, t) as (select source_id, todo, cast(null as bigint), cast(null as varchar) from h union all
 select source_id, step.rest, step.i, step.t from (select source_id, list_reduce(list_transform(todo, lambda y: {{'i': y.i, 't': y.t, 'rest': cast([] as struct(i bigint, t varchar)[])}}),
  lambda q, x: case when {_ALIKE} then {{'i': q.i, 't': case when length(x.t) > length(q.t) then x.t else q.t end, 'rest': q.rest}} else {{'i': q.i, 't': q.t, 'rest': list_append(q.rest, {{'i': x.i,
 't': x.t}})}} end) as step from m where len(todo) > 0)) """


@query(_RANK.replace("with e as", "with recursive e as", 1) + f", base as (select source_id, cast(rank as bigint) as i, content as t from r where entity_type = 'function_point' and rank <= 15), {_MERGE} select source_id, cast(i as int) as ordinal, concat('FR-', i) as item_id, t as description, 'medium' as priority, source_id as source_ids from m where i is not null")
def near_dup_greedy_merge(spark, d):
    top = ranking.rank_by_significance(A.entities(spark, d), 15).filter("entity_type = 'function_point'")
    rows = top.selectExpr("source_id", "rank as ordinal", "concat('FR-', rank) as item_id", "content as description", "'medium' as priority", "array(source_id) as source_ids")
    return similarity.greedy_merge(rows).withColumn("source_ids", F.array_join("source_ids", ","))


@query(_TOP.replace("with e as", "with recursive e as", 1) + f""", base as (select source_id, cast(rank - 1 as bigint) as i, case when contains(lower(trim(content)),
 'shall') then trim(content) else concat('The system shall ', lower(substring(trim(content), 1, 1)), substring(trim(content), 2)) end as t from r where entity_type = 'function_point' and rank <= 15),
{_MERGE}, z as (select *, row_number() over (partition by source_id order by i) as n from m where i is not null) select source_id, cast(i as int) as ordinal, printf('FR-%03d', i + 1) as item_id,
 t as text from z where n <= 10""")
def functional_requirements(spark, d):
    return demand.demand_items(A.entities(spark, d), M.RuleClient()).filter("field = 'functional'").select("source_id", "ordinal", "item_id", "text")


_FIELDS = ("functional", "nfr", "runtime", "exception", "use_case", "objective", "role", "glossary")
_FIELD = "case event_id % 8 " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(_FIELDS)) + " end"


def _items(spark, d) -> DataFrame:
    rows = A.table(spark, d, "events").selectExpr("concat('src', cast(floor(event_id / 8) % 20 as string)) as source_id", f"{_FIELD} as field", "cast(floor(event_id / 160) as int) as ordinal", "concat('I', event_id) as item_id", "concat(case when event_id % 9 = 0 then 'some ' else '' end, event_type, ' ', props) as text")
    return rows.filter("not (field = 'use_case' and source_id = 'src3')")


_ITEMS = f"""with recursive i as (select * from (select concat('src', cast(cast(floor(event_id / 8) as int) % 20 as varchar)) as source_id, {_FIELD} as field,
 cast(floor(event_id / 160) as int) as ordinal, concat('I', event_id) as item_id,
 concat(case when event_id % 9 = 0 then 'some ' else '' end, event_type, ' ', props) as text from events) where not (field = 'use_case' and source_id = 'src3')),
n as (select *, row_number() over (partition by source_id, field order by ordinal) as n from i) """


@query(_ITEMS + "select source_id, " + ", ".join(f"count(*) filter (field = '{f}') as {f}" for f in ("objective", "role", "use_case", "functional", "nfr", "runtime", "exception", "glossary")) + " from i group by source_id")
def demand_sizes(spark, d):
    return demand.sizes(_items(spark, d))


_LISTS = [("functional", "FUNC", (("functional", 12),)), ("nfr_constraint", "NFR_", (("nfr", 10), ("runtime", 6))), ("runtime_environment", "RUNT", (("exception", 10), ("runtime", 8))), ("interface_exception", "INTE", (("use_case", 8), ("exception", 8)))]
_ISSUES = "select concat('intra_src', cast(event_id % 7 as {s})) as comparison_id, cast(event_id as int) as ordinal, case event_id % 3 when 0 then 'conflict' else 'omission' end as issue_type, case when event_id % 19 = 0 then 'all_sources' else concat('src', cast(event_id % 25 as {s})) end as source_a_id, concat('src', cast(event_id % 7 as {s})) as source_b_id, event_type as description from events"


@query(f"with i as ({_ISSUES.format(s='varchar')}), s as (select concat('src', unnest(range(30))) as sid) select sid, comparison_id, ordinal from i join s on sid in (source_a_id, source_b_id) or source_a_id = 'all_sources' or contains(comparison_id, concat('intra_', sid))")
def issues_of_sources(spark, d):
    A.table(spark, d, "events").createOrReplaceTempView("events")
    sources = spark.range(30).select(F.concat(F.lit("src"), "id").alias("source_id"))
    return consistency.relevant_issues(spark.sql(_ISSUES.format(s="string")), sources).select("sid", "comparison_id", "ordinal")


_ASKED = " union all ".join(
    f"select source_id, {k} as k, '{cat}' as category, '{code}' as code, {o} * 1000 + n as p, text from n where field = '{f}' and n <= {cap}" + (" and source_id in (select source_id from i where field = 'use_case')" if cat == "interface_exception" else "")
    for k, (cat, code, wanted) in enumerate(_LISTS) for o, (f, cap) in enumerate(wanted, 1)
)


@query(_ITEMS + f""", j as ({_ISSUES.format(s='varchar')}), s as (select distinct source_id from i),
c as (select source_id, row_number() over (partition by source_id order by comparison_id, ordinal) as p, concat('(', issue_type, ') ', description) as text from j join s on source_id in (source_a_id,
 source_b_id) or source_a_id = 'all_sources' or contains(comparison_id, concat('intra_', source_id))),
a as ({_ASKED} union all select source_id, 4, 'consistency_driven', 'CONS', p, text from c where p <= 50),
t as (select *, row_number() over (partition by source_id order by k, p) as ordinal, row_number() over (partition by source_id, k order by p) as x from a)
select source_id, cast(ordinal as int) as ordinal, concat(upper(substring(source_id, 1, 6)), '-', code, '-', printf('%03d', ordinal)) as tr_id, category, concat('{SAT}', trim(text)) as tr_h,
 printf('REQ-%03d', x) as ids from t""")
def generated_requirements(spark, d):
    A.table(spark, d, "events").createOrReplaceTempView("events")
    issues = spark.sql(_ISSUES.format(s="string")).withColumn("issue_id", F.lit("ISS"))
    rows = pipeline.generate(_items(spark, d), issues, M.RuleClient())
    return rows.select("source_id", "ordinal", "tr_id", "category", "tr_h", F.array_join("source_req_ids", "|").alias("ids"))


_SYSTEMS = f"select {_NAMES} as source_id, n_nationkey, concat('region', n_regionkey) as bundle_id from nation"
_SYS_TEXT = "concat(case when (i + n_nationkey) % 4 = 0 then 'fast ' else '' end, field, ' ', cast(i as {s}), case when field in ('glossary', 'role') then '' else concat(' of ', source_id) end)"
_CHECKED = " union all ".join(
    f"select c.comparison_id, {side} * 100000 + {o} * 1000 + t.i as p, t.text from c join t on t.source_id = c.{'source_a' if side == 0 else 'source_b'} where ends_with(c.comparison_id, ':{kind}') and c.source_a <> c.source_b and t.field = '{f}' and t.i < {cap if not (kind == 'runtime_vs_srs' and side == 0 and o == 3) else 0}"
    for kind, (first, second, most, _) in pipeline.CHECKS.items() for side, wanted in enumerate((first, second)) for o, (f, cap) in enumerate(wanted, 1)
)


@query(_ROLE_SQL.replace("order by p, ordinal", "order by p, source_id") + f""", kinds as (select * from (values ('srs', 'manual'), ('runtime', 'srs'), ('design', 'srs')) v(p, q)),
c as (select concat(y.bundle_id, ':', p, '_vs_', q) as comparison_id, y.source_id as source_a, z.source_id as source_b from kinds join x y on y.role = p join x z on z.role = q
 and z.bundle_id = y.bundle_id and y.source_id <> z.source_id),
t as (select source_id, n_nationkey, field, i, {_SYS_TEXT.format(s='varchar')} as text from ({_SYSTEMS}), (select unnest([{', '.join(f"'{f}'" for f in _FIELDS)}]) as field),
 (select unnest(range(15)) as i)),
w as (select source_id, text, 0 as kind, i from t where field = 'glossary' union all select source_id, text, 1, i from t where field = 'role' and i < 8),
v as (select lower(case when kind = 0 then concat('term ', i) else text end) as term, source_id, kind, i from w), fst as (select term, min(row(source_id, kind, i)) as place,
 array_to_string(list_sort(list(distinct source_id)), ', ') as s from v group by term),
l as ({_CHECKED} union all select concat('intra_', source_id), o * 1000 + i, text from t, (select * from (values ('functional', 12, 1), ('nfr', 8, 2), ('exception', 10, 3), ('use_case', 8, 4)) u(f,
 cap, o)) where t.field = f and i < cap
 union all select 'terminology', row_number() over (order by place) - 1, concat(term, ' (in: ', s, ')') from fst qualify row_number() over (order by place) <= 40),
z as (select *, row_number() over (partition by comparison_id order by p) as n from l where regexp_matches(text, '\\b(appropriate|fast|easy|etc|some)\\b', 'i'))
select comparison_id, cast(n - 1 as int) as ordinal, 'ambiguity' as issue_type, text as description from z where n <= 20""")
def consistency_issues(spark, d):
    n = A.table(spark, d, "nation").selectExpr(f"{_NAMES} as source_id", "n_nationkey", "concat('region', n_regionkey) as bundle_id")
    rows = n.withColumn("field", F.explode(F.array(*map(F.lit, _FIELDS)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(14))))
    items = rows.selectExpr("source_id", "field", "i as ordinal", "concat('Term ', i) as item_id", f"{_SYS_TEXT.format(s='string')} as text")
    return pipeline.check(items, n.select("source_id", "bundle_id"), M.RuleClient()).select("comparison_id", "ordinal", "issue_type", "description")


@query(_FLAGS + f""", {_FLAGGED}, {_COVER}, sel as (select g.*, row_number() over (partition by source_id order by ordinal) as n from g join fl using (source_id, tr_id)),
un as (select source_id, text, row_number() over (partition by source_id order by ordinal) as n from ic where not cov)
select source_id, tr_id, tr_h from g anti join fl using (source_id, tr_id) union all select source_id, tr_id, case when n <= 8 then concat('{SAT}', tr_h) else tr_h end from sel
union all select source_id, concat(upper(substring(source_id, 1, 6)), '-FIXD-', 1000 + n), concat('{SAT}', text) from un where n <= 8""")
def repaired_requirements(spark, d):
    rows = A.requirements(spark, d)
    ids = review.flagged_ids(review.flags(rows)).groupBy("source_id").agg(F.collect_set("tr_id").alias("flagged_tr_ids"))
    cover = review.coverage_score(A.items(spark, d), rows.select("source_id", F.col("tr_h").alias("text"))).select("source_id", "uncovered")
    reviewed = ids.join(cover, "source_id", "left").withColumn("correction_notes", F.array(F.lit("say more")))
    from tessera.config import PipelineConfig

    return pipeline.repair_with(M.RuleClient(), PipelineConfig())(rows, reviewed, 0).select("source_id", "tr_id", "tr_h")


_SOURCE = "case when event_id % 10 = 9 then '' else substring(tr_h, 1, cast(event_id % 70 + 1 as int)) end"


@query(f"""with r as (select *, cast(substring(tr_id, 4) as bigint) as event_id from ({_REQ})), w as (select *, row_number() over (partition by source_id order by ordinal) as n, {_SOURCE} as src
 from r),
k as (select *, {_TOKENS.format('src')} as a, {_TOKENS.format('tr_h')} as b from w where n <= 30)
select source_id, tr_id, case when trim(src) = '' then 'SKIPPED_NO_SOURCE' when len(list_intersect(a, b)) / len(b) > 0.6 then 'SUPPORTED' when len(list_intersect(a,
 b)) / len(b) > 0.2 then 'PARTIALLY_SUPPORTED' else 'UNSUPPORTED' end as verdict from k""")
def faithful_verdicts(spark, d):
    rows = A.requirements(spark, d).withColumn("event_id", F.substring("tr_id", 4, 20).cast("long")).withColumn("source_req_ids", F.array(F.expr(_SOURCE)))
    rows = rows.withColumn("tr_a", F.col("tr_a").withField("source_req_ids", F.col("source_req_ids"))).drop("event_id")
    return judging.faithfulness(rows, M.RuleClient()).select("source_id", "tr_id", "verdict")


_SOME = "regexp_replace(array_to_string({}, ', '), '^\\s+|\\s+$', '', 'g') <> ''"
_JUDGED = f"""j as (select source_id, cast(contains(lower(tr_h), 'shall') as int) + cast(split_part(lower(tr_h), ' ', 1) in ('when', 'if', 'upon',
 'the') as int) + cast(len({words("array_to_string(expected_outputs, ', ')")}) > 3 as int)
 + cast({_SOME.format('preconditions')} as int) + cast({_SOME.format('stimuli')} as int) + cast(regexp_matches(tr_h || array_to_string(expected_outputs, ', '), '[0-9]') as int) as passes from r),
jm as (select source_id, count(*) as answered, round(count(*) filter (passes >= 5) / count(*), 6) as q_h_judge from j group by source_id) """


@query(_FLAGS + f", {_METRICS}, {_JUDGED} select source_id, total_trs, q_a, traceability, answered, q_h_judge from m join jm using (source_id)")
def judged_quality(spark, d):
    """The offline client judges by rules of its own, which rows fail."""
    rows = A.requirements(spark, d)
    return judging.judged_metrics(judging.judged(rows, M.RuleClient()), rows)


@query(f"""with r as ({_REQ}), k as (select source_id, tr_h, row_number() over (partition by source_id order by ordinal) as n from r where contains(lower(tr_h), 'shall'))
select source_id, cast(n as int) as ordinal, printf('B-%03d', n) as tr_id, 'functional' as category, tr_h from k""")
def single_prompt_requirements(spark, d):
    rows = A.requirements(spark, d).withColumn("b", F.floor(F.col("ordinal") / 10).cast("int"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "tr_h"))), lambda x: x["tr_h"]), "\n")
    sections = rows.groupBy("source_id", "b").agg(text.alias("text")).selectExpr("source_id", "'srs' as artifact_type", "b as section_id", "'r' as section_ref", "text")
    return judging.baseline(sections, M.RuleClient()).select("source_id", "ordinal", "tr_id", "category", "tr_h")


# ---- the whole review and the report

_PAIR = f"""tw as (select source_id, ordinal as o, {_TOKENS.format('tr_h')} as t from r), pr as (select a.source_id, a.o as i, b.o as j, len(list_intersect(a.t, b.t)) as common,
 len(a.t) + len(b.t) as total
 from tw a join tw b on a.source_id = b.source_id and b.o > a.o and b.o <= a.o + 19), dp as (select * from pr where common / (total - common) > 0.75) """
_WHOLE = _FLAGS + f""", {_COVER}, {_METRICS}, {_TOP_ISSUES}, {_PAIR},
bd as (select g.*, untestable or exists (select 1 from dp where dp.source_id = g.source_id and dp.j = g.ordinal) as bad from g),
fl as (select source_id, tr_id from (select *, row_number() over (partition by source_id order by tr_id, ordinal) as n from bd where bad) where n <= 10
 union select source_id, tr_id from (select *, row_number() over (partition by source_id order by ordinal) as n from g where not traceable) where n <= 10
 union select source_id, tr_id from (select *, row_number() over (partition by source_id order by ordinal) as n from g where not complete) where n <= 10
 union select source_id, tr_id from (select *, row_number() over (partition by source_id order by ordinal) as n from g where not compliant) where n <= 5),
ls as (select source_id, array_to_string(list(tr_id order by ordinal) filter (not traceable)[1:10], ',') as untraceable, array_to_string(list(tr_id order by ordinal) filter (not complete)[1:10],
 ',') as invalid,
 array_to_string(list(tr_id order by ordinal) filter (not compliant)[1:10], ',') as non_compliant_ids, count(*) filter (not compliant) as non_compliant from g group by source_id),
un as (select source_id, list(text order by ordinal) filter (not cov)[1:10] as uncovered from ic group by source_id), fi as (select source_id, array_to_string(list_sort(list(tr_id)),
 ',') as flagged_tr_ids from fl group by source_id),
dc as (select source_id, count(*) as duplicate_count from dp group by source_id),
al as (select m.*, coalesce(score, 1.0) as coverage, coalesce(duplicate_count, 0) as duplicate_count, non_compliant, coalesce(untraceable, '') as untraceable, coalesce(invalid, '') as invalid,
 coalesce(non_compliant_ids, '') as non_compliant_ids, coalesce(flagged_tr_ids, '') as flagged_tr_ids, coalesce(uncovered, []) as un
, top
 from m left join cs using (source_id) left join ls using (source_id) left join un using (source_id) left join fi using (source_id) left join dc using (source_id) left join tk using (source_id)) """


@query(_WHOLE + f"""select source_id, total_trs, q_h, q_a, traceability, coverage, q_h >= 0.78 and q_a >= 0.85 and traceability >= 0.9 and coverage >= 0.95 as passed, duplicate_count, non_compliant,
 untraceable, invalid, non_compliant_ids, flagged_tr_ids, array_to_string(un, '|') as uncovered,
array_to_string({_NOTES}, '|') as notes from al""")
def full_review(spark, d):
    out = review.review(A.requirements(spark, d), A.items(spark, d))
    notes = F.array_join("correction_notes", "|").alias("notes")
    plain = ["source_id", "total_trs", "q_h", "q_a", "traceability", "coverage", "passed", "duplicate_count", "non_compliant"]
    listed = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), s).alias(c) for c, s in (("untraceable", ","), ("invalid", ","), ("non_compliant_ids", ","), ("flagged_tr_ids", ","), ("uncovered", "|"))]
    return out.select(*plain, *listed, notes)


@query(_WHOLE + f""", e2 as ({_ENT}) select '1 Parsing and extraction' as stage, 'entities' as output, cast((select count(*) from e2) as varchar) as count union all select '2 Demand', 'demand models',
 cast((select count(distinct source_id) from ({_ITEMS.replace('with recursive', 'with')} select source_id from i)) as varchar)
union all select '3 Consistency', 'issues', cast((select count(*) from ({_ISSUES.format(s='varchar')})) as varchar) union all select '4 Requirements', 'test requirements', cast((select count(*) from r
 where cast(substring(source_id, 4) as int) % 2 = 1 or ordinal % 3 = 0) as varchar)
union all select '5 Review', 'documents passing all targets', concat((select count(*) from al where q_h >= 0.78 and q_a >= 0.85 and traceability >= 0.9 and coverage >= 0.95), '/', (select count(*)
 from al))""")
def report_summary(spark, d):
    A.table(spark, d, "events").createOrReplaceTempView("events")
    rows, issues = A.requirements(spark, d), spark.sql(_ISSUES.format(s="string"))
    final = rows.filter("cast(substring(source_id, 4) as int) % 2 = 0 and ordinal % 3 = 0")
    tables = reports.stage_tables(A.entities(spark, d), _items(spark, d), issues.select("comparison_id"), issues, rows, final, review.review(rows, A.items(spark, d)))
    return tables["Summary"]


@query(f"""with e as ({_ENT}), n as (select source_id, entity_type, count(*) as n, min(ordinal) as f from e group by all), r as (select *, row_number() over (partition by source_id order by n desc,
 f) as rank from n)
select source_id, 'srs' as artifact_type, cast(sum(n) as bigint) as entities, string_agg(concat(entity_type, ': ', n), ', ' order by rank) filter (rank <= 3) as top_entity_types from r
 group by source_id""")
def report_entities(spark, d):
    rows = A.requirements(spark, d)
    none = spark.createDataFrame([], schemas.ISSUE)
    tables = reports.stage_tables(A.entities(spark, d), _items(spark, d), none, none, rows, rows, review.review(rows, A.items(spark, d), None, A.items(spark, d).select("source_id").distinct()))
    return tables["Stage 1: parsing and entities"]
