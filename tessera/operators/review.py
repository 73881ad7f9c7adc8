"""Quality review of test requirements: flags per row in one projection, metrics in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import PipelineConfig
from tessera.functions import quality as Q
from tessera.operators.coverage import coverage_score
from tessera.operators.ranking import first_k
from tessera.operators.similarity import window_pairs
from tessera.plans.storage import materialize, release


def flags(requirements: DataFrame) -> DataFrame:
    """Every row with ears_score, compliant, issues, traceable, complete, untestable."""
    six = Q.criteria()
    return requirements.select(
        "source_id", "ordinal", "tr_id", "tr_h", Q.score(six).alias("ears_score"), (Q.score(six) >= Q.PASS_AT).alias("compliant"),
        Q.issues(six).alias("issues"), Q.traceable().alias("traceable"), Q.complete().alias("complete"), Q.untestable().alias("untestable"),
    )


def issue_histogram(flagged: DataFrame, k: int = 3) -> DataFrame:
    """Issues of non-compliant rows per source, the k most frequent first; ties by first appearance."""
    each = flagged.filter("not compliant").select("source_id", "ordinal", F.posexplode("issues").alias("p", "issue"))
    n = each.groupBy("source_id", "issue").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "p")).alias("first_seen"))
    return first_k(n, ["source_id"], [F.desc("n"), "first_seen"], k).select("source_id", "rank", "issue", "n")


def metrics(flagged: DataFrame, sources: DataFrame, coverage: DataFrame | None = None, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """One row per source with q_h, q_a, traceability, coverage and passed. A source without rows has zeros and fails."""
    m = flagged.groupBy("source_id").agg(F.count("*").alias("total_trs"), *[F.round(F.count_if(c) / F.count("*"), 6).alias(n) for n, c in (("q_h", "compliant"), ("q_a", "complete"), ("traceability", "traceable"))])
    out = sources.select("source_id").distinct().join(m, "source_id", "left")
    if coverage is None:
        out = out.withColumn("coverage", F.when(F.col("total_trs") > 0, F.lit(1.0)))
    else:  # no items to cover counts as covered, but not for a source without rows
        out = out.join(coverage.select("source_id", F.col("score").alias("coverage")), "source_id", "left").withColumn("coverage", F.when(F.col("total_trs") > 0, F.coalesce("coverage", F.lit(1.0))))
    out = out.fillna(0, ["total_trs"]).fillna(0.0, ["q_h", "q_a", "traceability", "coverage"])
    passed = (F.col("q_h") >= config.q_h) & (F.col("q_a") >= config.q_a) & (F.col("traceability") >= config.traceability) & (F.col("coverage") >= config.coverage)
    return out.withColumn("passed", passed & (F.col("total_trs") > 0))


def duplicates(requirements: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Pairs of like requirements within the horizon of a source."""
    return window_pairs(requirements, "tr_h", ["source_id"], "ordinal", config.similar_above, config.horizon)


def flagged_ids(flagged: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The rows to repair: the first ten untraceable, of bad quality (repeats, untestable) and incomplete ones, and the first five non-compliant."""
    parts = [(F.col("traceable") == F.lit(False), 10), (F.col("complete") == F.lit(False), 10), (F.col("compliant") == F.lit(False), 5)]
    bad = flagged.filter("untestable").select("source_id", "ordinal", "tr_id")
    if pairs is not None:
        bad = bad.union(flagged.join(pairs.select("source_id", F.col("j").alias("ordinal")).distinct(), ["source_id", "ordinal"], "left_semi").select("source_id", "ordinal", "tr_id")).distinct()
    out = first_k(bad, ["source_id"], ["tr_id", "ordinal"], 10).select("source_id", "tr_id")
    for condition, k in parts:
        out = out.union(first_k(flagged.filter(condition), ["source_id"], ["ordinal"], k).select("source_id", "tr_id"))
    return out.distinct()


def notes(reviewed: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """correction_notes of each source: one line per metric below its target, in the order coverage, traceability, schema, structure.

    `reviewed` has the metrics, and the arrays uncovered, untraceable, invalid and top_issues and the count non_compliant.
    """
    listed = lambda c, sep, k: F.concat_ws(sep, F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, k))
    # the texts are fixed values
    rows = [
        (F.col("coverage") < config.coverage, F.format_string(f"Coverage %.0f%%%% < {config.coverage * 100:.0f}%%%%. Missing: %s".replace("%%%%", "%%"), F.col("coverage") * 100, listed("uncovered", "; ", 3))),
        (F.col("traceability") < config.traceability, F.format_string(f"Traceability %.0f%% < {config.traceability * 100:.0f}%%. Fix: %s", F.col("traceability") * 100, listed("untraceable", ", ", 3))),
        (F.col("q_a") < config.q_a, F.format_string(f"Q_A %.2f < {config.q_a:.2f}. Fix schema for: %s", F.col("q_a"), listed("invalid", ", ", 3))),
        (F.col("q_h") < config.q_h, F.format_string(f"Q_H %.2f < {config.q_h:.2f}. %d TRs fail EARS. Issues: %s", F.col("q_h"), F.col("non_compliant"), listed("top_issues", "; ", 2))),
    ]
    return reviewed.withColumn("correction_notes", F.filter(F.array(*[F.when(c, t) for c, t in rows]), lambda x: x.isNotNull()))


def review(requirements: DataFrame, items: DataFrame, constraint_items: DataFrame | None = None, sources: DataFrame | None = None, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """The whole review, one row per source: metrics, lists, flagged ids, notes, passed.

    Flags and pairs are evaluated once and written; only the result's table is left.
    """
    f = materialize(flags(requirements), "flags")
    near = duplicates(requirements, config)
    pairs = materialize(near, "pairs")
    release(near)
    cov = coverage_score(items, requirements.select("source_id", F.col("tr_h").alias("text")))
    m = metrics(f, sources if sources is not None else requirements, cov, config)
    bad = lambda c, k: F.transform(F.slice(F.sort_array(F.collect_list(F.when(~F.col(c), F.struct("ordinal", "tr_id")))), 1, k), lambda x: x["tr_id"])
    lists = f.groupBy("source_id").agg(bad("traceable", 10).alias("untraceable"), bad("complete", 10).alias("invalid"), bad("compliant", 10).alias("non_compliant_ids"), F.count_if(~F.col("compliant")).alias("non_compliant"))
    tops = issue_histogram(f).groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "issue"))), lambda x: x["issue"]).alias("top_issues"))
    ids = flagged_ids(f, pairs).groupBy("source_id").agg(F.sort_array(F.collect_set("tr_id")).alias("flagged_tr_ids"))
    dup = pairs.groupBy("source_id").agg(F.count("*").alias("duplicate_count"))
    out = m
    for other in (lists, tops, ids, dup, cov.select("source_id", "uncovered")):
        out = out.join(other, "source_id", "left")
    out = notes(out.fillna(0, ["duplicate_count", "non_compliant"]), config)
    out = out.withColumn("correction_notes", F.when(F.col("total_trs") == 0, F.array(F.lit("No TRs to review."))).otherwise(F.col("correction_notes")))
    if constraint_items is not None:
        nfr = requirements.filter("category = 'nfr_constraint'").select("source_id", F.col("tr_h").alias("text"))
        c = coverage_score(constraint_items, nfr, 5).select("source_id", F.struct("covered", "total", "uncovered").alias("constraints"))
        out = out.join(c, "source_id", "left")
    whole = materialize(out, "review")
    release(f, pairs)
    return whole
