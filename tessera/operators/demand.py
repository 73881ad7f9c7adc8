"""Entities and demand models: the relational shell around the model's steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import PipelineConfig
from tessera.functions import replies as R
from tessera.operators import model as M
from tessera.operators import ranking
from tessera.operators.positions import renumbered
from tessera.operators.chunking import schema
from tessera.operators.similarity import greedy_merge

#: Chunks of a source in their order: by numbers, as ids of sections beyond 9999 sort before others as text.
CHUNK_ORDER = ("section_id", "chunk_index", "chunk_id")
#: A chunk may be asked about in several parts.
ASKED_ORDER = (*CHUNK_ORDER, "part")


def extract_entities(chunks: DataFrame, client: M.ModelClient, known: DataFrame | None = None) -> DataFrame:
    """Entities of all chunks; an element that isn't an object is dropped alone."""
    replies = M.ask(M.entity_prompts(chunks), client, known)
    item = F.col("item")
    each = replies.select("source_id", "artifact_type", *ASKED_ORDER, "page_ref", F.posexplode(R.reply_items("reply")).alias("p", "item")).filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    rows = each.select("source_id", "artifact_type", R.field(item, "entity_type", "").alias("entity_type"), F.trim(R.field(item, "content", "")).alias("content"), "page_ref", F.try_variant_get(item, "$.confidence_score", "double").alias("confidence_score"), *ASKED_ORDER, "p")
    numbered = renumbered(ranking.clean_entities(rows), ["source_id"], [*ASKED_ORDER, "p"], "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    return numbered.select([f.name for f in schema(schemas.ENTITY)]).to(schema(schemas.ENTITY))


def demand_items(entities: DataFrame, client: M.ModelClient, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """The demand model in long form: one row per (source_id, field, ordinal).

    Fields: objective, role, use_case, functional, nfr, runtime, exception, glossary.
    """
    n = config.item_cap
    top = ranking.capped(entities, config).withColumnRenamed("content", "text").withColumn("ordinal", F.col("rank") - 1)
    of = lambda *t: top.filter(F.col("entity_type").isin(*t))
    plain = lambda df, field: df.select("source_id", F.lit(field).alias("field"), F.col("ordinal").cast("int"), "text")
    items = plain(ranking.objectives(entities).select("source_id", "content", F.col("position").alias("ordinal")).withColumnRenamed("content", "text"), "objective")
    items = items.unionByName(plain(of("exception_condition"), "exception"))
    terms = ranking.glossary(entities).select("source_id", F.lit("glossary").alias("field"), F.col("position").cast("int").alias("ordinal"), F.col("term").alias("item_id"), F.col("definition").alias("text"))

    def answers(kind: str, task: str, source: DataFrame) -> DataFrame:
        replies = M.ask(M.prompts(source, kind, task, ["source_id"]), client)
        return replies.select("source_id", F.posexplode(R.reply_items("reply")).alias("ordinal", "item"))

    item = F.col("item")
    text_of = lambda name: F.trim(R.field(item, name, ""))
    asked = answers("roles", "Name the user roles as a JSON array of strings.", of("actor_role", "interface_name"))
    roles = asked.select("source_id", "ordinal", F.try_variant_get(item, "$", "string").alias("text")).filter(f"text <> '' and ordinal < {n}")
    without = top.select("source_id").distinct().join(of("actor_role", "interface_name").select("source_id").distinct(), "source_id", "left_anti")
    roles = roles.unionByName(without.select("source_id", F.posexplode(F.array(F.lit("User"), F.lit("System"))).alias("ordinal", "text")))
    functions = of("function_point")
    cases = answers("use_cases", "Write use cases (goal, actor, steps) as a JSON array.", functions.select("source_id", "ordinal", "text").unionByName(of("process_step").select("source_id", (F.col("ordinal") + 1000).alias("ordinal"), "text")))
    cases = cases.filter(f"ordinal < {n}").select("source_id", F.lit("use_case").alias("field"), "ordinal", F.coalesce(R.field(item, "use_case_id"), F.format_string("UC-%03d", F.col("ordinal") + 1)).alias("item_id"), text_of("goal").alias("text"), R.field(item, "actor", "User").alias("actor"), F.try_variant_get(item, "$.steps", "array<string>").alias("parts"))
    reqs = answers("functional_reqs", "Write functional requirements (description, priority) as a JSON array.", functions).filter(f"ordinal < {n + 5}")
    reqs = reqs.select("source_id", "ordinal", F.coalesce(R.field(item, "req_id"), F.format_string("FR-%03d", F.col("ordinal") + 1)).alias("item_id"), text_of("description").alias("description"), R.field(item, "priority", "medium").alias("priority"), F.array("source_id").alias("source_ids")).filter("description <> ''")
    merged = ranking.first_k(greedy_merge(reqs, config.similar_above), ["source_id"], ["ordinal"], n)
    functional = merged.select("source_id", F.lit("functional").alias("field"), "ordinal", "item_id", F.col("description").alias("text"), "priority", "source_ids")
    out = items.unionByName(terms, True).unionByName(roles.select("source_id", F.lit("role").alias("field"), "ordinal", "text"), True).unionByName(cases, True).unionByName(functional, True)
    sorted_out = M.ask(M.prompts(of("constraint"), "constraints", "Sort these constraints into nfr and runtime, as a JSON object of two arrays.", ["source_id"]), client)
    whole = F.try_parse_json(R.bracketed(R.without_fences("reply"), "{"))
    for field, code in (("nfr", "NFR"), ("runtime", "RT")):
        listed = F.coalesce(F.try_variant_get(whole, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
        found = sorted_out.select("source_id", F.posexplode(listed).alias("ordinal", "item")).filter(f"ordinal < {n}")
        rows = found.select("source_id", F.lit(field).alias("field"), "ordinal", F.coalesce(R.field(item, "constraint_id"), F.format_string(f"{code}-%03d", F.col("ordinal") + 1)).alias("item_id"), text_of("description").alias("text"), R.field(item, "category").alias("category"), R.field(item, "threshold").alias("threshold"))
        out = out.unionByName(rows.filter("text <> ''"), True)
    return out.select([F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(schemas.DEMAND_ITEM)]).to(schema(schemas.DEMAND_ITEM))


def sizes(items: DataFrame) -> DataFrame:
    """Number of items of each field by source."""
    return items.groupBy("source_id").pivot("field", ["objective", "role", "use_case", "functional", "nfr", "runtime", "exception", "glossary"]).count().na.fill(0)
