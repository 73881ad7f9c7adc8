"""Test requirements from model replies: numbering, defaults, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import replies as R
from tessera.operators.chunking import schema

#: The first four letters of each category, upper case, in the order of generation (fixed values).
CODES = ("FUNC", "NFR_", "RUNT", "INTE", "CONS")


def tr_id(source: str, code: str, number: str) -> F.Column:
    return F.upper(F.format_string("%s-%s-%03d", F.substring(source, 1, 6), F.substring(code, 1, 4), F.col(number)))


def parsed(rows: DataFrame, keep: list[str], lenient: bool = False) -> DataFrame:
    """The fields of a requirement from `item`, beside the columns `keep`.

    Lists stand in the item itself or within its tr_a; a single source_req stands for a list of them. Dropped are what is no object, an unknown priority,
    lists of another kind, and rows without tr_h.
    """
    item = F.col("item")

    def texts(name: str) -> F.Column:
        """An array of the non-empty texts; null for any other kind of value, empty if missing."""

        def of(path: str) -> F.Column:
            got = F.filter(F.try_variant_get(item, path, "array<string>"), lambda x: x.isNotNull() & (x != ""))
            return F.when(F.startswith(F.schema_of_variant(F.try_variant_get(item, path, "variant")), F.lit("ARRAY")), got)

        own, within = (F.try_variant_get(item, p, "variant") for p in (f"$.{name}", f"$.tr_a.{name}"))
        return F.when(own.isNotNull(), of(f"$.{name}")).when(within.isNotNull(), of(f"$.tr_a.{name}")).otherwise(F.array().cast("array<string>"))

    lists = [texts(c).alias(c) for c in ("preconditions", "stimuli", "expected_outputs")]
    single = R.field(item, "source_req")
    ids = F.coalesce(F.nullif(texts("source_req_ids"), F.array().cast("array<string>")), F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))
    priority = R.in_domain(F.coalesce(R.field(item, "priority"), R.field(item, "tr_a.priority"), F.when(F.try_variant_get(item, "$.priority", "variant").isNull(), F.lit("medium"))), schemas.PRIORITIES, lenient)
    criterion = F.coalesce(R.field(item, "coverage_criterion"), R.field(item, "tr_a.coverage_criterion"), F.lit(""))
    out = rows.filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))
    out = out.select(*keep, F.trim(R.field(item, "tr_h", "")).alias("tr_h"), *lists, criterion.alias("coverage_criterion"), priority.alias("priority"), ids.alias("source_req_ids"))
    return out.filter("tr_h <> '' and priority is not null and preconditions is not null and stimuli is not null and expected_outputs is not null")


def shaped(rows: DataFrame) -> DataFrame:
    """Rows of `parsed` with source_id, ordinal, tr_id and category as requirements."""
    a = F.struct("tr_id", "preconditions", "stimuli", "expected_outputs", "coverage_criterion", "priority", "source_req_ids").alias("tr_a")
    return rows.select("source_id", "ordinal", "tr_id", "category", "tr_h", a, "source_req_ids").to(schema(schemas.REQUIREMENT))


def build(replies: DataFrame, most: int = 50, lenient: bool = False) -> DataFrame:
    """Requirements from replies (source_id, category, reply, and attempt if something was asked twice). Numbers run over all
    categories of a source and count rows that are then rejected.
    """
    order = F.array_position(F.array(*map(F.lit, schemas.TR_CATEGORIES)), F.col("category"))
    code = F.element_at(F.array(*map(F.lit, CODES)), order.cast("int"))
    attempt = F.col("attempt") if "attempt" in replies.columns else F.lit(0)
    whole = replies.select("source_id", "category", order.alias("k"), attempt.alias("attempt"), code.alias("code"), F.slice(R.reply_items("reply"), 1, most).alias("items"))
    # a window over the few replies of a source, not over their items
    before = W.partitionBy("source_id").orderBy("k", "attempt").rowsBetween(W.unboundedPreceding, -1)
    each = whole.withColumn("first", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0))).select("*", F.posexplode("items").alias("p", "item"))
    each = each.withColumn("ordinal", (F.col("first") + F.col("p") + 1).cast("int")).drop("items")
    each = each.withColumn("tr_id", tr_id("source_id", "code", "ordinal"))
    return shaped(parsed(each, ["source_id", "ordinal", "tr_id", "category"], lenient))


def rejects(replies: DataFrame, built: DataFrame, most: int = 50) -> DataFrame:
    """How many items of each source's replies were dropped."""
    n = replies.select("source_id", F.least(F.size(R.reply_items("reply")), F.lit(most)).alias("n")).groupBy("source_id").agg(F.sum("n").alias("items"))
    kept = built.groupBy("source_id").agg(F.count("*").alias("kept"))
    return n.join(kept, "source_id", "left").select("source_id", "items", (F.col("items") - F.coalesce("kept", F.lit(0))).alias("rejects"))
