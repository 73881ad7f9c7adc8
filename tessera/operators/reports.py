"""Counts and summaries over the stages' tables, and the Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import quality as Q
from tessera.operators.ranking import first_k

VERDICTS = ("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "UNPARSEABLE", "ERROR")


def category_counts(requirements: DataFrame) -> DataFrame:
    """One column per category."""
    return requirements.groupBy("source_id").pivot("category", list(schemas.TR_CATEGORIES)).count().na.fill(0)


def top_types(entities: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent entity types of each source; ties by first occurrence."""
    n = entities.groupBy("source_id", "entity_type").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_seen"))
    return first_k(n, ["source_id"], [F.desc("n"), "first_seen"], k).select("source_id", "rank", "entity_type", "n")


def totals(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in columns])


def score_distribution(scores: DataFrame, column: str = "score", top: int = 6) -> DataFrame:
    """How many rows have each score from 0 to `top`, zeros included."""
    every = scores.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("score"))
    n = scores.groupBy(F.col(column).cast("int").alias("score")).agg(F.count("*").alias("n"))
    return every.join(n, "score", "left").na.fill(0, ["n"])


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """The five kinds of verdict with their counts and shares."""
    n = verdicts.groupBy(Q.verdict_class("verdict").alias("kind")).agg(F.count("*").alias("n"))
    every = verdicts.sparkSession.createDataFrame([(v,) for v in VERDICTS], "kind string")
    out = every.join(n, "kind", "left").na.fill(0, ["n"])
    total = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).select("kind", "n", F.coalesce(F.round(F.try_divide("n", "total"), 6), F.lit(0.0)).alias("share"))


def passing(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if("passed").alias("passing"), F.count("*").alias("documents"))


def latest(final: DataFrame, stage: DataFrame) -> DataFrame:
    """Final rows where a source has any, its stage rows otherwise."""
    return final.unionByName(stage.join(final.select("source_id").distinct(), "source_id", "left_anti"))


def stage_tables(entities: DataFrame, items: DataFrame, comparisons: DataFrame, issues: DataFrame, stage: DataFrame, final: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report, one per stage, and the summary. Requirements are the final ones of a source, or its stage's if it has none."""
    from tessera.operators import consistency, demand

    top = top_types(entities).groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(": ", "entity_type", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("top_entity_types"))
    found = entities.groupBy("source_id", "artifact_type").agg(F.count("*").alias("entities")).join(top, "source_id").orderBy("source_id")
    sizes = demand.sizes(items).select("source_id", F.col("role").alias("roles"), F.col("use_case").alias("use_cases"), F.col("functional").alias("func_reqs"), "nfr", "glossary", F.col("exception").alias("exceptions")).orderBy("source_id")
    checks = consistency.report_totals(comparisons.select("comparison_id").distinct(), issues).orderBy("comparison_id")
    rows = latest(final, stage)
    counts = category_counts(rows)
    counts = counts.select("source_id", sum((F.col(c) for c in schemas.TR_CATEGORIES[1:]), F.col(schemas.TR_CATEGORIES[0])).alias("total"), *schemas.TR_CATEGORIES).orderBy("source_id")
    status = F.when(F.col("passed"), "PASS").otherwise("NEEDS REVIEW").alias("status")
    scores = reviews.select("source_id", "total_trs", *[F.format_number(c, 2).alias(c) for c in ("q_h", "q_a", "traceability", "coverage")], F.coalesce("duplicate_count", F.lit(0)).alias("duplicates"), status).orderBy("source_id")
    passed = passing(reviews).select(F.concat_ws("/", "passing", "documents"))
    one = lambda stage, output, df: df.toDF("n").select(F.lit(stage).alias("stage"), F.lit(output).alias("output"), F.col("n").cast("string").alias("count"))
    summary = one("1 Parsing and extraction", "entities", entities.agg(F.count("*"))).unionByName(one("2 Demand", "demand models", items.agg(F.count_distinct("source_id"))))
    summary = summary.unionByName(one("3 Consistency", "issues", issues.agg(F.count("*")))).unionByName(one("4 Requirements", "test requirements", rows.agg(F.count("*")))).unionByName(one("5 Review", "documents passing all targets", passed))
    return {"Stage 1: parsing and entities": found, "Stage 2: demand": sizes, "Stage 3: consistency": checks, "Stage 4: test requirements": counts, "Stage 5: review": scores, "Summary": summary}


def explanations(config) -> str:
    """What the metrics and criteria of the report mean."""
    metrics = [("Q_H", "six structural criteria", config.q_h), ("Q_A", "required fields of the structured form", config.q_a), ("Traceability", "requirements that name a source", config.traceability), ("Coverage", "demand items that share a keyword with a requirement", config.coverage)]
    rows = ["## Metrics", "", "| metric | share of | target |", "| --- | --- | --- |", *[f"| {n} | {t} | >= {k:.2f} |" for n, t, k in metrics]]
    rows += ["", f"## Criteria of Q_H (at least {Q.PASS_AT} of {len(Q.ISSUES)})", "", *[f"- {chr(97 + i)}: not \"{name}\"" for i, name in enumerate(Q.ISSUES)]]
    return "\n".join(rows) + "\n"


def report(title: str, config=None, **tables: DataFrame) -> str:
    """The whole report; see `stage_tables` for the tables it is made of."""
    from tessera.config import PipelineConfig

    return markdown(title, stage_tables(**tables)) + "\n" + explanations(config or PipelineConfig())


def markdown(title: str, tables: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A report of small aggregates; each table shows its first `most_rows` rows."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most_rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"
