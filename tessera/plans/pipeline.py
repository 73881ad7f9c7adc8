"""The five stages in order: load and chunk, entities, demand model, consistency, requirements, review with repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import PipelineConfig
from tessera.operators import chunking, consistency, demand, feedback, requirements, review, sinks
from tessera.operators import model as M
from tessera.operators.ranking import first_k
from tessera.plans.storage import materialize, release

#: Fields and caps of the lists that each category of requirement is written from.
SELECTED = {
    "functional": (("functional", 12),),
    "nfr_constraint": (("nfr", 10), ("runtime", 6)),
    "runtime_environment": (("exception", 10), ("runtime", 8)),
    "interface_exception": (("use_case", 8), ("exception", 8)),
}
_WHOLE = (("functional", 12), ("nfr", 6), ("runtime", 8))
#: For each check the lists of its two documents (fields and caps), and how many lines of the first are shown.
CHECKS = {
    "srs_vs_manual": ((("functional", 12),), (("objective", 12), ("use_case", 8)), None, "A holds requirements, B what users are told. Report features of one without the other (omission), contradictions (conflict) and vague points (ambiguity)"),
    "runtime_vs_srs": ((("nfr", 10), ("runtime", 10), ("exception", 8)), _WHOLE, 20, "A holds conditions at run time, B requirements. Report conditions that rule requirements out, differing numbers too (conflict), undocumented assumptions (omission) and unstated conditions (to_confirm)"),
    "design_vs_srs": ((("role", 10), ("functional", 12), ("nfr", 10), ("runtime", 8)), _WHOLE, None, "A holds a design, B requirements. Report requirements that it leaves out (omission) or contradicts, differing numbers too (conflict), and parts without a requirement (to_confirm)"),
}
WITHIN = (("functional", 12), ("nfr", 8), ("exception", 10), ("use_case", 8))
_FIELDS = "as a JSON array (tr_h, preconditions, stimuli, expected_outputs, coverage_criterion, priority, source_req)."
_ASKED = "as a JSON array (issue_type, description, severity, suggested_fix), [] if there are none."


@dataclass
class Result:
    chunks: DataFrame
    entities: DataFrame
    items: DataFrame
    issues: DataFrame
    requirements: DataFrame
    reviews: DataFrame


def pick(items: DataFrame, wanted: tuple[tuple[str, int], ...], most: int | None = None) -> DataFrame:
    """The first rows of each field, in the order of the fields, of all of them the first `most`."""
    order = F.array_position(F.array(*[F.lit(f) for f, _ in wanted]), F.col("field")).cast("int")
    cap = F.element_at(F.array(*[F.lit(k) for _, k in wanted]), order)
    rows = items.filter(F.col("field").isin(*[f for f, _ in wanted])).withColumn("o", order).withColumn("cap", cap)
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("source_id", "field").orderBy("ordinal"))).filter("n <= cap")
    rows = rows.select("source_id", (F.col("o") * 1000 + F.col("n")).alias("ordinal"), "text", "field")
    return rows if most is None else first_k(rows, ["source_id"], ["ordinal"], most).drop("rank")


def check(items: DataFrame, bundle_map: DataFrame | None, client: M.ModelClient) -> DataFrame:
    """Issues of every comparison, within documents that have functional requirements, and of the terms of all documents."""
    sources = items.groupBy("source_id").agg(F.lit(0).alias("ordinal"))
    pairs = consistency.comparisons(consistency.bundles(sources, bundle_map))
    keys = ["comparison_id", "source_a", "source_b"]
    asked = None
    for kind, (first, second, most, task) in CHECKS.items():
        chosen = pairs.filter(F.endswith("comparison_id", F.lit(f":{kind}")) & (F.col("source_a") != F.col("source_b")))
        lists = None
        for side, wanted, cap, at in (("source_a", first, most, 0), ("source_b", second, None, 1)):
            own = pick(items, wanted, cap)
            label = F.concat(F.lit(f"[{'AB'[at]} "), "field", F.lit("] "), "text")
            rows = chosen.join(own, chosen[side] == own["source_id"]).select(*keys, (F.lit(at * 100_000) + F.col("ordinal")).alias("ordinal"), label.alias("text"))
            lists = rows if lists is None else lists.unionByName(rows)
        p = M.prompts(lists, f"check_{kind}", f"{task}, {_ASKED}", keys)
        asked = p if asked is None else asked.unionByName(p)
    with_reqs = items.filter("field = 'functional'").select("source_id").distinct()
    own = pick(items, WITHIN).join(with_reqs, "source_id", "left_semi")
    inner = pairs.filter("source_a = source_b")
    lists = inner.join(own, inner["source_a"] == own["source_id"]).select(*keys, "ordinal", F.concat(F.lit("["), "field", F.lit("] "), "text").alias("text"))
    asked = asked.unionByName(M.prompts(lists, "check_within", f"Report contradictions, gaps, vague statements and missing criteria within this document, {_ASKED}", keys))
    of = lambda field, text: items.filter(F.col("field") == field).select("source_id", "ordinal", F.col(text).alias("text"))
    terms = consistency.terminology(of("glossary", "item_id"), of("role", "text"))
    lines = terms.select(F.lit("terminology").alias("comparison_id"), F.lit("all_sources").alias("source_a"), F.lit("all_sources").alias("source_b"), F.col("position").alias("ordinal"), F.concat("term", F.lit(" (in: "), F.concat_ws(", ", "sources"), F.lit(")")).alias("text"))
    asked = asked.unionByName(M.prompts(lines, "check_terminology", f"Report one concept under several names (ambiguity), one term with several meanings (conflict) and undefined key terms (to_confirm), {_ASKED}", keys))
    return consistency.parse_issues(M.ask(asked, client))


def generate(items: DataFrame, issues: DataFrame, client: M.ModelClient) -> DataFrame:
    """Requirements of all five categories; use cases are needed for interface requirements. Functional ones are asked for again where nothing came."""
    asked = None
    for category, wanted in SELECTED.items():
        own = pick(items, wanted)
        if category == "interface_exception":
            own = own.join(items.filter("field = 'use_case'").select("source_id").distinct(), "source_id", "left_semi")
        p = M.prompts(own, f"tr_{category}", f"Write test requirements ({category}) {_FIELDS}", ["source_id"]).withColumn("category", F.lit(category))
        asked = p if asked is None else asked.unionByName(p)
    near = consistency.relevant_issues(issues, items.select("source_id").distinct(), first=50)
    line = F.concat(F.lit("["), "issue_id", F.lit("] ("), "issue_type", F.lit(") "), "description")
    near = near.select(F.col("sid").alias("source_id"), F.struct("comparison_id", "ordinal").alias("ordinal"), line.alias("text"))
    near = first_k(near, ["source_id"], ["ordinal"], 50)
    p = M.prompts(near, "tr_consistency_driven", f"Write a test requirement for each issue that fails until it is settled, {_FIELDS}", ["source_id"]).withColumn("category", F.lit("consistency_driven"))
    replies = M.ask(asked.unionByName(p), client).withColumn("attempt", F.lit(0))
    functional = F.col("category") == "functional"
    got = requirements.build(replies.filter(functional)).select("source_id").distinct()
    again = asked.filter(functional).join(got, "source_id", "left_anti").withColumn("prompt", F.concat("prompt", F.lit("\nAnswer with the array only.")))
    return requirements.build(replies.unionByName(M.ask(again, client).withColumn("attempt", F.lit(1))))


def covered_items(items: DataFrame) -> DataFrame:
    """What coverage counts: 60 characters of each functional requirement, use case goal and quality constraint."""
    rows = items.filter("field in ('functional', 'use_case', 'nfr')")
    return rows.select("source_id", F.concat_ws("-", "field", "ordinal").alias("ordinal"), F.substring("text", 1, 60).alias("text"))


def judge_with(asked: DataFrame, limits: DataFrame, sources: DataFrame, config: PipelineConfig):
    """Reviews of rows, of all sources or of those named."""

    def judge(rows: DataFrame, only: DataFrame | None) -> DataFrame:
        own = lambda df: df if only is None else df.join(only, "source_id", "left_semi")
        return review.review(own(rows), own(asked), own(limits), own(sources), config)

    return judge


def repair_with(client: M.ModelClient, config: PipelineConfig):
    """Flagged requirements are written anew, then gaps are filled."""

    def repair(rows: DataFrame, reviewed: DataFrame, turn: int) -> DataFrame:
        flagged = reviewed.select("source_id", F.explode("flagged_tr_ids").alias("tr_id"))
        chosen = feedback.to_send(feedback.split_flagged(rows, flagged)[1], config)
        got = feedback.replacements(M.ask(feedback.repair_prompts(chosen, reviewed), client), chosen)
        fixed = feedback.merge(rows, flagged, got, config)
        gaps = feedback.gap_requirements(M.ask(feedback.gap_prompts(reviewed, config), client), rows, turn, config)
        return fixed.unionByName(gaps)

    return repair


def run(sections: DataFrame, client: M.ModelClient | None = None, bundle_map: DataFrame | None = None, config: PipelineConfig = PipelineConfig(), with_issues: bool = True, with_feedback: bool = True) -> Result:
    """All stages over sections. Without issues no requirement is driven by consistency."""
    client = client or M.RuleClient()
    chunks = materialize(chunking.chunk(sections), "chunks")
    entities = materialize(demand.extract_entities(chunks, client), "entities")
    items = materialize(demand.demand_items(entities, client, config), "items")
    issues = materialize(check(items, bundle_map, client), "issues")
    if not with_issues:
        issues = issues.filter("false")
    rows = materialize(generate(items, issues, client), "requirements")
    asked, limits = covered_items(items), items.filter("field in ('nfr', 'runtime')").select("source_id", F.concat_ws("-", "field", "ordinal").alias("ordinal"), "text")
    sources = items.select("source_id").distinct()
    if with_feedback:
        rows, reviews = feedback.loop(rows, judge_with(asked, limits, sources, config), repair_with(client, config), config)
    else:
        reviews = materialize(judge_with(asked, limits, sources, config)(rows, None), "reviews")
    return Result(chunks, entities, items, issues, rows, reviews)


def run_into(path: str, sections: DataFrame, client: M.ModelClient | None = None, bundle_map: DataFrame | None = None, config: PipelineConfig = PipelineConfig(), force: bool = False) -> Result:
    """All stages, with their tables saved below `path`; documents that have a review there are skipped unless `force`.

    Of new documents chunks, entities, items, requirements and reviews are added. Issues concern pairs of documents, so they are found anew over
    the items of all. What is returned reads the tables as they are now; a later save that replaces their files needs a new read.
    """
    spark, client = sections.sparkSession, client or M.RuleClient()
    at = lambda name: f"{path}/{name}"
    todo = materialize(sinks.pending(sections, sinks.saved_sources(spark, at("reviews")), force), "pending")
    if not todo.isEmpty():
        sinks.save(materialize(chunking.chunk(todo), "chunks"), at("chunks"))
        mine = sinks.load(spark, at("chunks"), schemas.CHUNK).join(todo.select("source_id").distinct(), "source_id", "left_semi")
        entities = materialize(demand.extract_entities(mine, client), "entities")
        sinks.save(entities, at("entities"))
        own = materialize(demand.demand_items(entities, client, config), "items")
        sinks.save(own, at("items"))
        items = sinks.load(spark, at("items"), schemas.DEMAND_ITEM)
        issues = materialize(check(items, bundle_map, client), "issues")
        issues.write.mode("overwrite").parquet(at("issues"))
        rows = materialize(generate(own, issues, client), "requirements")
        limits = own.filter("field in ('nfr', 'runtime')").select("source_id", F.concat_ws("-", "field", "ordinal").alias("ordinal"), "text")
        judge = judge_with(covered_items(own), limits, own.select("source_id").distinct(), config)
        rows, reviews = feedback.loop(rows, judge, repair_with(client, config), config)
        sinks.save(rows, at("requirements"))
        sinks.save(reviews, at("reviews"))
    release(todo)
    read = lambda name, ddl: sinks.load(spark, at(name), ddl)
    reviews = spark.read.parquet(at("reviews")).drop("bucket")
    return Result(read("chunks", schemas.CHUNK), read("entities", schemas.ENTITY), read("items", schemas.DEMAND_ITEM), spark.read.schema(schemas.ISSUE).parquet(at("issues")), read("requirements", schemas.REQUIREMENT), reviews)
