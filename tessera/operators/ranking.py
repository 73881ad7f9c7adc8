"""Ranked and capped entity lists; every per-key limit is a row number, so ties are broken by the ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import PipelineConfig
from tessera.functions import text as T


def first_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def clean_entities(raw: DataFrame) -> DataFrame:
    """Rows with a known type and some content; scores default to 0.8 and lie in 0 to 1."""
    from tessera.schemas import ENTITY_TYPES

    rows = raw.filter((F.trim("entity_type") != "") & (T.trim_all("content") != "") & F.col("entity_type").isin(*ENTITY_TYPES))
    return rows.withColumn("confidence_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence_score", F.lit(0.8)))))


def rank_by_significance(entities: DataFrame, cap: int | None = None) -> DataFrame:
    """source_id, entity_type, rank, content, freq, significance: frequency plus mean confidence of each normalised content.

    The longest spelling stands for it (the first on ties); equal significance goes by first appearance. Partial
    aggregation runs before the shuffle, so a source with most of the rows sends few.
    """
    key = T.normal_key("content")
    spelled = F.struct(F.length("content"), -F.col("ordinal"))
    groups = entities.groupBy("source_id", "entity_type", key.alias("key")).agg(
        F.count("*").alias("freq"), F.round(F.count("*") + F.avg("confidence_score"), 6).alias("significance"), F.max_by("content", spelled).alias("content"), F.min("ordinal").alias("first_ordinal")
    )
    k = cap if cap is not None else 1 << 30
    ranked = first_k(groups, ["source_id", "entity_type"], [F.desc("significance"), "first_ordinal"], k)
    return ranked.select("source_id", "entity_type", "rank", "content", "freq", "significance")


def capped(entities: DataFrame, config: PipelineConfig) -> DataFrame:
    """Each type's list cut at its own cap."""
    limits = F.create_map(*[F.lit(x) for pair in config.caps().items() for x in pair])
    return rank_by_significance(entities).filter(F.col("rank") <= limits[F.col("entity_type")])


def objectives(entities: DataFrame, k: int = 8) -> DataFrame:
    """The k most confident functions, then without repeats: fewer than k may remain."""
    top = first_k(entities.filter("entity_type = 'function_point'"), ["source_id"], [F.desc("confidence_score"), "ordinal"], k)
    return top.groupBy("source_id", "content").agg(F.min("rank").alias("position"))


def glossary(entities: DataFrame) -> DataFrame:
    """term, definition: split at the first colon, else the first 40 characters stand for the whole; the last definition and the first place count."""
    parts = F.split("content", ":", 2)
    has = F.contains("content", F.lit(":"))
    rows = entities.filter("entity_type = 'glossary_term'").select(
        "source_id", "ordinal", F.when(has, T.trim_all(parts[0])).otherwise(F.substring("content", 1, 40)).alias("term"), F.when(has, T.trim_all(parts[1])).otherwise(F.col("content")).alias("definition")
    )
    return rows.groupBy("source_id", "term").agg(F.max_by("definition", "ordinal").alias("definition"), F.min("ordinal").alias("position"))


def cap_sweep(entities: DataFrame, caps: list[int]) -> DataFrame:
    """How many rows each cap leaves per source and type, for all caps in one pass."""
    counts = rank_by_significance(entities).groupBy("source_id", "entity_type").agg(F.count("*").alias("n"))
    return counts.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).select("cap", "source_id", "entity_type", F.least("n", F.col("cap")).alias("kept"))
