"""Bounded repair of requirements that a review flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import PipelineConfig
from tessera.functions import replies as R
from tessera.operators import model as M
from tessera.operators import requirements
from tessera.operators.ranking import first_k
from tessera.operators.requirements import tr_id
from tessera.plans.storage import materialize, release


def split_flagged(rows: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows to repair; ids count within a source only."""
    return rows.join(flagged, ["source_id", "tr_id"], "left_anti"), rows.join(flagged, ["source_id", "tr_id"], "left_semi")


def to_send(selected: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    return first_k(selected, ["source_id"], ["ordinal"], config.flagged_sent)


def repair_prompts(chosen: DataFrame, reviewed: DataFrame, notes: int = 3) -> DataFrame:
    """One prompt per source: the rows to rewrite, with what the review found."""
    found = F.concat_ws("; ", F.slice(F.coalesce("correction_notes", F.array().cast("array<string>")), 1, notes))
    issues = reviewed.select("source_id", F.coalesce(F.nullif(found, F.lit("")), F.lit("make the statements clearer and more specific")).alias("issues"))
    lines = chosen.join(issues, "source_id").select("source_id", "ordinal", "issues", F.concat_ws(" | ", "tr_id", "category", "tr_h").alias("text"))
    asked = M.prompts(lines, "repair", "Rewrite these test requirements as a JSON array (tr_id as given, tr_h, preconditions, stimuli, expected_outputs, coverage_criterion, priority, source_req).", ["source_id", "issues"])
    return asked.withColumn("prompt", F.concat_ws("\n", "prompt", F.concat(F.lit("Issues to fix: "), "issues"))).drop("issues")


def replacements(replies: DataFrame, chosen: DataFrame) -> DataFrame:
    """source_id, tr_id, tr_h, tr_a from replies: by the id an item names, or by its place if it names none."""
    each = replies.select("source_id", F.posexplode(R.reply_items("reply")).alias("p", "item")).withColumn("named", R.field(F.col("item"), "tr_id"))
    rows = requirements.parsed(each, ["source_id", "p", "named"])
    ids = chosen.select("source_id", "tr_id", (F.row_number().over(W.partitionBy("source_id").orderBy("ordinal")) - 1).alias("at"))
    by_name = rows.filter("named is not null").join(ids.drop("at"), (F.col("named") == F.col("tr_id")) & (rows["source_id"] == ids["source_id"])).drop(ids["source_id"])
    by_place = rows.filter("named is null").join(ids, (F.col("p") == F.col("at")) & (rows["source_id"] == ids["source_id"])).drop(ids["source_id"], "at")
    a = F.struct("tr_id", "preconditions", "stimuli", "expected_outputs", "coverage_criterion", "priority", "source_req_ids").cast(schemas.TR_A).alias("tr_a")
    return by_name.unionByName(by_place).select("source_id", "p", "tr_id", "tr_h", a).groupBy("source_id", "tr_id").agg(F.min_by(F.struct("tr_h", "tr_a"), "p").alias("x")).select("source_id", "tr_id", "x.*")


def merge(rows: DataFrame, flagged: DataFrame, replacements: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Requirements with replacements (source_id, tr_id, tr_h, and tr_a if they have one) put in; category and source stay the original's.

    Mode keep leaves flagged rows that got no replacement; mode reference drops them.
    """
    keep, chosen = split_flagged(rows, flagged)
    a = F.col("tr_a") if "tr_a" in replacements.columns else F.lit(None).cast(schemas.TR_A)
    new = replacements.filter("trim(tr_h) <> ''").dropDuplicates(["source_id", "tr_id"]).select("source_id", "tr_id", F.col("tr_h").alias("new_h"), a.alias("new_a"))
    sent = to_send(chosen, config).select("source_id", "tr_id").distinct()
    new = new.join(sent, ["source_id", "tr_id"], "left_semi")
    fixed = chosen.join(new, ["source_id", "tr_id"], "left")
    if config.feedback_mode == "reference":
        fixed = fixed.filter("new_h is not null")
    fixed = fixed.withColumns({"tr_h": F.coalesce("new_h", "tr_h"), "source_req_ids": F.coalesce("new_a.source_req_ids", "source_req_ids"), "tr_a": F.coalesce("new_a", "tr_a")})
    return keep.unionByName(fixed.select(keep.columns))


def gap_prompts(reviewed: DataFrame, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """One prompt per source for the first items that no requirement covers."""
    lines = reviewed.select("source_id", F.posexplode(F.slice(F.coalesce("uncovered", F.array().cast("array<string>")), 1, config.gaps_sent)).alias("ordinal", "text"))
    return M.prompts(lines, "gaps", "Write a test requirement for each of these uncovered items as a JSON array (tr_h, preconditions, stimuli, expected_outputs, coverage_criterion, priority, source_req).", ["source_id"])


def gap_requirements(replies: DataFrame, rows: DataFrame, iteration: int, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Functional requirements that fill gaps, behind the present ones. Numbers count rejects and run on over iterations, so none repeats."""
    n = config.gap_rows
    each = replies.select("source_id", F.posexplode(F.slice(R.reply_items("reply"), 1, n)).alias("p", "item"))
    each = each.withColumn("number", F.col("p") + 1001 + iteration * n).withColumn("tr_id", tr_id("source_id", F.lit("FIXD"), "number"))
    last = rows.groupBy("source_id").agg(F.max("ordinal").alias("last"))
    each = each.join(last, "source_id", "left").withColumns({"ordinal": F.coalesce("last", F.lit(0)) + F.col("p") + 1, "category": F.lit("functional")})
    return requirements.shaped(requirements.parsed(each, ["source_id", "ordinal", "tr_id", "category"]))


def loop(rows: DataFrame, review: Callable[[DataFrame, DataFrame | None], DataFrame], repair: Callable[[DataFrame, DataFrame, int], DataFrame], config: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, DataFrame]:
    """At most `max_iterations` repairs of sources that don't pass, and the reviews of what they end as; no change ends it.

    `review` takes rows and the sources to review (None: all) and gives source_id, passed; `repair` takes (rows of failing sources, their
    review, number of the iteration). Only sources that a repair has changed are reviewed again; the reviews of the others stay.
    """
    now = materialize(rows, "requirements")
    reviewed = materialize(review(now, None), "reviews")
    for turn in range(config.max_iterations):
        failing = reviewed.filter("not passed")
        if failing.isEmpty():
            break
        before = now.join(failing.select("source_id"), "source_id", "left_semi")
        fixed = materialize(repair(before, failing, turn), "repaired")
        changed = materialize(changed_sources(before, fixed), "changed")
        if changed.isEmpty():
            release(fixed, changed)
            break
        theirs = fixed.join(changed, "source_id", "left_semi")
        after = materialize(now.join(changed, "source_id", "left_anti").unionByName(theirs), "requirements")
        again = review(theirs, changed)
        merged = materialize(reviewed.join(changed, "source_id", "left_anti").unionByName(again), "reviews")
        release(now, reviewed, fixed, changed)
        now, reviewed = after, merged
    return now, reviewed


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """The sources whose rows differ, by number and hashes."""
    whole = F.sum(F.pmod(F.xxhash64(*[F.to_json(F.struct(c)) for c in before.columns]), F.lit(1 << 30)))
    mark = lambda df, side: df.groupBy("source_id").agg(F.struct(F.count("*"), whole).alias(side))
    both = mark(before, "before").join(mark(after, "after"), "source_id", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("source_id")
