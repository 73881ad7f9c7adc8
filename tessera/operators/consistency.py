"""Comparisons between documents of one system, their issues, and the terminology index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import replies as R
from tessera.operators.positions import ordered

#: Parts of a source id that tell its role, by priority (fixed values).
ROLES = {"srs": ("srs", "nasa"), "manual": ("manual", "bash", "user"), "runtime": ("swagger", "petstore", "runtime"), "design": ("design",)}
COMPARED = (("srs", "manual"), ("runtime", "srs"), ("design", "srs"))


def bundles(sources: DataFrame, bundle_map: DataFrame | None = None) -> DataFrame:
    """source_id, ordinal, bundle_id; a source without a bundle is one of its own."""
    if bundle_map is None:
        return sources.withColumn("bundle_id", F.col("source_id"))
    return sources.join(bundle_map.select("source_id", "bundle_id").dropDuplicates(["source_id"]), "source_id", "left").withColumn("bundle_id", F.coalesce("bundle_id", "source_id"))


def roles(bundled: DataFrame) -> DataFrame:
    """bundle_id, role, source_id: the first match by keyword, then by order. One pass, a fixed number of keywords."""
    marks = [F.when(F.contains("source_id", F.lit(k)), F.struct(F.lit(r).alias("role"), F.lit(i).alias("keyword"))) for r, keys in ROLES.items() for i, k in enumerate(keys)]
    each = bundled.select("bundle_id", "source_id", "ordinal", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("m"))
    return each.groupBy("bundle_id", F.col("m.role").alias("role")).agg(F.min(F.struct(F.col("m.keyword"), "ordinal", "source_id")).alias("x")).select("bundle_id", "role", F.col("x.source_id").alias("source_id"))


def comparisons(bundled: DataFrame) -> DataFrame:
    """comparison_id, bundle_id, source_a, source_b: three cross-document checks of bundles with several documents, and one within each document."""
    r = roles(bundled)
    wide = r.groupBy("bundle_id").pivot("role", list(ROLES)).agg(F.first("source_id"))
    several = bundled.groupBy("bundle_id").agg(F.count_distinct("source_id").alias("n")).filter("n >= 2").select("bundle_id")
    cross = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in COMPARED])
    pairs = wide.join(several, "bundle_id").select("bundle_id", F.explode(cross).alias("x")).filter("x.a is not null and x.b is not null and x.a <> x.b")
    within = bundled.select(F.concat(F.lit("intra_"), "source_id").alias("comparison_id"), "bundle_id", F.col("source_id").alias("source_a"), F.col("source_id").alias("source_b"))
    return pairs.select(F.concat(F.col("bundle_id"), F.lit(":"), F.col("x.kind")).alias("comparison_id"), "bundle_id", F.col("x.a").alias("source_a"), F.col("x.b").alias("source_b")).union(within)


def terminology(glossary: DataFrame, roles_of: DataFrame, sources: DataFrame | None = None, per_glossary: int = 20, per_roles: int = 8, most: int = 40) -> DataFrame:
    """position, term, sources (sorted): the first glossary terms and roles of each source, lower-cased, by the sources that use them.

    The first `most` terms are kept, in the order of sources (their `ordinal` if `sources` tells it, then their ids), glossary before roles.
    Both inputs have source_id, ordinal and text.
    """
    from tessera.operators.ranking import first_k

    cut = lambda df, k, kind: first_k(df, ["source_id"], ["ordinal"], k).select("source_id", F.lit(kind).alias("kind"), "ordinal", F.lower("text").alias("term"))
    terms = cut(glossary, per_glossary, 0).unionByName(cut(roles_of, per_roles, 1))
    terms = terms.withColumn("k", F.lit(0)) if sources is None else terms.join(sources.select("source_id", F.col("ordinal").alias("k")), "source_id")
    place = F.min(F.struct("k", "source_id", "kind", "ordinal")).alias("place")
    firsts = terms.groupBy("term").agg(F.sort_array(F.collect_set("source_id")).alias("sources"), place).orderBy("place", "term").limit(most)
    return firsts.select((F.row_number().over(W.orderBy("place", "term")) - 1).alias("position"), "term", "sources")  # `most` rows


def parse_issues(replies: DataFrame, most: int = 20, lenient: bool = False) -> DataFrame:
    """Issues of model replies (comparison_id, source_a, source_b, reply). Missing kinds get a default; wrong ones drop the row."""
    item = F.col("item")
    rows = replies.select("comparison_id", "source_a", "source_b", F.posexplode(F.slice(R.reply_items("reply"), 1, most)).alias("ordinal", "item"))
    rows = rows.filter(F.schema_of_variant("item").startswith("OBJECT"))
    rows = rows.withColumn("issue_type", R.in_domain(R.field(item, "issue_type", "to_confirm"), schemas.ISSUE_TYPES, lenient)).withColumn("severity", R.in_domain(R.field(item, "severity", "minor"), schemas.SEVERITIES, lenient))
    rows = rows.filter("issue_type is not null and severity is not null")
    return rows.select(
        "comparison_id", "source_a", "source_b", "ordinal", F.coalesce(R.field(item, "issue_id"), F.format_string("ISS-%03d", F.col("ordinal") + 1)).alias("issue_id"), "issue_type",
        F.col("source_a").alias("source_a_id"), F.col("source_b").alias("source_b_id"), R.field(item, "description", "").alias("description"), "severity",
        F.array().cast("array<string>").alias("affected_req_ids"), R.field(item, "suggested_fix").alias("suggested_fix"),
    )


def report_totals(comparisons: DataFrame, issues: DataFrame) -> DataFrame:
    """The four counts of every comparison, zeros where it has no issue."""
    n = issues.groupBy("comparison_id").agg(*[F.count_if(F.col("issue_type") == k).alias(c) for k, c in (("conflict", "total_conflicts"), ("omission", "total_omissions"), ("ambiguity", "total_ambiguities"), ("to_confirm", "total_to_confirm"))])
    return comparisons.join(n, "comparison_id", "left").fillna(0, ["total_conflicts", "total_omissions", "total_ambiguities", "total_to_confirm"])


def relevant_issues(issues: DataFrame, sources: DataFrame, bundled: DataFrame | None = None, first: int | None = None, block: int = 1000) -> DataFrame:
    """Issues that concern each source: named by it, about all sources, or where the comparison's id holds "intra_" and the source's id.

    With `bundled`, those about all sources only within the bundle. Equality joins instead of one over a disjunction: an
    id that follows "intra_" is one of the prefixes of what stands there. Issues about all sources meet the sources in blocks of `block` issues,
    by the block's number. Where only the `first` issues of each source (by comparison_id and ordinal) are wanted, only so many of these are given to each.
    """
    s = sources.select(F.col("source_id").alias("sid"))
    columns = issues.columns
    named = issues.withColumn("sid", F.explode(F.array_distinct(F.array("source_a_id", "source_b_id"))))
    rest = F.col("rest")
    inner = issues.select("*", F.explode(F.slice(F.split("comparison_id", "intra_"), 2, 1 << 30)).alias("rest")).filter("rest <> ''")
    inner = inner.withColumn("sid", F.explode(F.transform(F.sequence(F.lit(1), F.length(rest)), lambda k: F.substring(rest, F.lit(1), k)))).drop("rest")
    everyone = issues.filter("source_a_id = 'all_sources'")
    if bundled is not None:
        b = bundled.select(F.col("source_id").alias("sid"), "bundle_id")
        shared = everyone.withColumn("bundle_id", F.split("comparison_id", ":")[0]).join(b, "bundle_id")
    else:
        order = ["comparison_id", "ordinal"]
        if first is not None:
            everyone = everyone.orderBy(*order).limit(first)
        placed = ordered(everyone, order, "shared-issues")
        last = placed.agg(F.max("place").alias("n")).first()["n"]
        blocks = placed.groupBy(F.floor(F.col("place") / block).alias("k")).agg(F.collect_list(F.struct(*columns)).alias("all"))
        wanted = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((last or 0) // block).cast("long"))))
        shared = wanted.join(blocks, "k").select("sid", F.explode("all").alias("x")).select("sid", "x.*")
    return named.select("sid", *columns).unionByName(inner.select("sid", *columns)).join(s, "sid", "left_semi").unionByName(shared.select("sid", *columns)).dropDuplicates(["sid", "comparison_id", "ordinal"])
