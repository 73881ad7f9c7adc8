"""The queries opN_<name> over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    out = toxicity.score(documents, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_words", F.size("passages").alias("n_passages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import lm

    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import langid, toxicity

    documents = table(spark, sf_dir, "documents")
    out = langid.identify(documents, langid.learn(documents))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4, threshold=0.8)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.counting import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive

    out = archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.centroids import centroid_clusters

    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed="1")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.collocation import collocations

    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_notices", F.size("notices")).drop("notices")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_best_fit_packing, op3_toxicity, op4_lm_scoring, op5_topk_search, op6_language_id, op7_decontamination, op8_near_dedup, op9_token_counts, op10_warc,
            op11_centroid_clusters, op12_collocations, op13_license_scan, pipeline,
        )
    }


_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
           from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
p as (select distinct item, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as phrase
      from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
v as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as phrase from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) where len(w) >= n)),
h as (select v.r, v.i, v.n, p.item from v join p using (n, phrase)),
hits as (select r, count(distinct z) as n_hit from (select r, unnest(range(i, i + n)) as z from h) group by r),
found as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (r) left join found using (r)
"""

_NEAR = f"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select r, doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
e as (select r, len(g) as n, unnest(g) as g from s),
l as (select a.r as a, b.r as b from e a join e b on a.g = b.g and a.r < b.r group by a.r, b.r, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
t as (select a, b from l union all select b, a from l),
c(r, x) as (select r, r from s union select c.r, t.b from c join t on c.x = t.a),
m as (select c.r, min(s.doc_id) as component_id from c join s on s.r = c.x group by c.r)
select doc_id, cast(len(g) as bigint) as n_shingles, component_id, doc_id is not distinct from component_id as kept from s join m using (r)
"""

_URL = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)(?:\\?([^#]*))?"
_WARC = f"""
with p as (select page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]', '%0A', 'g') as url, coalesce(html, '') as html from pages),
q as (select *, cast(octet_length(encode(html)) as bigint) as n, sha1(html) as digest, {_LOWER.format("trim(url, ' ')")} as u, ((coalesce(page_id, 0) % 2147483648) + 2147483648) % 2147483648 as t from p),
g as (select digest, max(page_id) as original from q where n >= 1000 group by digest having count(*) > 1),
r as (select q.*, coalesce(page_id <> original, false) as again, original, regexp_extract(u, '{_URL}', 1) as host, regexp_extract(u, '{_URL}', 2) as path, regexp_extract(u, '{_URL}', 3) as query from q left join g using (digest)),
k as (select page_id, n as payload_bytes, digest as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then original end as refers_to,
      case when regexp_matches(u, '^[a-z][a-z0-9+.-]*://') then array_to_string(list_filter(list_reverse(string_split(host, '.')), lambda x: x <> '' and x <> 'www'), ',') || ')' || case when path = '' then '/' else path end
           || case when query = '' then '' else '?' || query end else u end as url_key,
      strftime(timestamp '2020-01-01 00:00:00' + to_seconds(t), '%Y-%m-%dT%H:%M:%SZ') as captured from r)
select *, row_number() over (order by url_key, captured, page_id nulls first, payload_digest, record_type) - 1 as position from k
"""


_START = """
with v as (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
           from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select cast(row_number() over (order by h, q) - 1 as integer) as c, q
       from (select sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h, q from v order by h, q limit 16))"""
# nearest centroids, and their moves: s - (s mod n) is what a floored quotient leaves
_NEAREST = """
a{i} as (select id, c, d from (select id, c, d, row_number() over (partition by id order by d, c) as place from (
    select v.id, k.c, cast(list_sum(list_transform(list_zip(v.q, k.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from v, c{i} k)) where place = 1)"""
_MOVED = """
m{i} as (select c, list((s - ((s % n) + n) % n) // n order by j) as q from (
    select c, j, cast(sum(q[j]) as bigint) as s, count(*) as n from a{i} join v using (id), range(1, 65) t(j) group by c, j) group by c),
c{next} as (select k.c, coalesce(m{i}.q, k.q) as q from c{i} k left join m{i} using (c))"""
_CLUSTERS = ",".join([_START, *[x for i in range(3) for x in (_NEAREST.format(i=i), _MOVED.format(i=i, next=i + 1))], _NEAREST.format(i=3)]) + """
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c3.q, ',')) as centroid_sha256
from a3 join v using (id) join c3 using (c)
"""

_COLLOCATIONS = f"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, {_LOWER.format("coalesce(text, '')")} as x from documents),
s as (select lang, unnest(string_split_regex(x, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from s),
g as (select lang, k as words, array_to_string(w[i : i + k - 1], ' ') as phrase
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) t(k) where len(w) >= k)),
f as (select lang, words, phrase, count(*) as f from g group by all having count(*) >= 100),
n as (select lang, sum(len(w)) as n from w group by lang),
c as (select lang, words, phrase, f as a, string_split(phrase, ' ') as p from f where words > 1),
u as (select c.*, n, k from c join n using (lang), range(1, 5) t(k) where k < words),
e as (select u.*, l.f as l, r.f as r, (1000 * cast(a as hugeint) * cast(n as hugeint)) // (cast(l.f as hugeint) * cast(r.f as hugeint)) as score
      from u join f l on l.lang = u.lang and l.phrase = array_to_string(p[:k], ' ') join f r on r.lang = u.lang and r.phrase = array_to_string(p[k + 1 :], ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from e) where place = 1),
h as (select distinct s.lang, s.phrase from c s join c q on q.lang = s.lang and q.words > s.words and 100 * q.a >= 100 * s.a and strpos(' ' || q.phrase || ' ', ' ' || s.phrase || ' ') > 0),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b anti join h using (lang, phrase))
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score from o where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_topk_search": _TOP_K, "op7_decontamination": _CONTAMINATION, "op8_near_dedup": _NEAR, "op10_warc": _WARC,
        "op11_centroid_clusters": _CLUSTERS, "op12_collocations": _COLLOCATIONS,
    }
