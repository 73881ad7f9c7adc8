"""The driver's tables as engine tables. Requirements and entities are derived from events by fixed templates.

Expressions are written once for two SQL dialects: ARR(…) and EMPTY stand for array literals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REQUIREMENT = {
    "source_id": "concat('req', cast(event_id % 40 as string))",
    "ordinal": "cast(floor(event_id / 40) as int)",
    "tr_id": "concat('TR-', cast(event_id as string))",
    "category": "case event_id % 5 when 0 then 'functional' when 1 then 'nfr_constraint' when 2 then 'runtime_environment' when 3 then 'interface_exception' else 'consistency_driven' end",
    "tr_h": "case event_id % 7 when 0 then concat('When ', event_type, ' occurs, the system shall respond within ', cast(event_id % 30 + 1 as string), ' seconds')"
    " when 1 then concat('The system shall record ', event_type, ' of user ', cast(user_id as string)) when 2 then concat('The service works for ', event_type)"
    " when 3 then concat('Upon ', event_type, ' the page shall be good') when 4 then concat('If a user sends get /api/', event_type, ' then http 200 shall follow')"
    " when 5 then concat('the ', event_type, ' shall be stored') else 'The system shall keep an audit trail of all actions' end",
    "preconditions": "case when event_id % 5 = 0 then ARR('  ') else ARR('the user is signed in') end",
    "stimuli": "case when event_id % 11 = 0 then EMPTY else ARR(event_type) end",
    "expected_outputs": "case when event_id % 3 = 0 then ARR('ok') else ARR('the response arrives', 'and is logged') end",
    "coverage_criterion": "case when event_id % 13 = 0 then '' else 'each branch once' end",
    "source_req_ids": "case when event_id % 17 = 0 then ARR(' ') else ARR(concat('REQ-', cast(event_id % 100 as string))) end",
}
ENTITY = {
    "source_id": "concat('src', cast(user_id % 50 as string))",
    "artifact_type": "'srs'",
    "entity_type": "case event_id % 4 when 0 then 'function_point' when 1 then 'glossary_term' when 2 then 'constraint' else 'actor_role' end",
    "content": "concat(case when event_id % 2 = 0 then upper(event_type) else event_type end, '  ', props)",
    "page_ref": "cast(null as string)",
    "confidence_score": "cast(event_id % 10 as double) / 10",
    "ordinal": "cast(event_id as int)",
}


def spark_sql(expression: str) -> str:
    return re.sub(r"\bARR\(", "array(", expression).replace("EMPTY", "cast(array() as array<string>)")


def duck_sql(expression: str) -> str:
    return re.sub(r"\bARR\(", "list_value(", expression).replace("EMPTY", "cast([] as varchar[])")


def duck_select(columns: dict[str, str]) -> str:
    return "select " + ", ".join(f"{duck_sql(e)} as {c}" for c, e in columns.items()) + " from events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "events").selectExpr(*[f"{spark_sql(e)} as {c}" for c, e in REQUIREMENT.items()])
    return flat.selectExpr(
        "source_id", "ordinal", "tr_id", "category", "tr_h",
        "named_struct('tr_id', tr_id, 'preconditions', preconditions, 'stimuli', stimuli, 'expected_outputs', expected_outputs, 'coverage_criterion', coverage_criterion, 'priority', 'medium', 'source_req_ids', source_req_ids) as tr_a",
        "source_req_ids",
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{spark_sql(e)} as {c}" for c, e in ENTITY.items()])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand items: one per source and event type."""
    return table(spark, sf_dir, "events").selectExpr("concat('req', cast(event_id % 40 as string)) as source_id", "event_id", "concat('Handle ', event_type) as text").groupBy("source_id", "text").agg({"event_id": "min"}).selectExpr("source_id", "`min(event_id)` as ordinal", "text")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections; the kind of document goes by the source's number."""
    kind = "case cast(substring(source, 4) as int) % 4 when 0 then 'srs' when 1 then 'user_manual' when 2 then 'runtime' else 'design' end"
    return table(spark, sf_dir, "documents").selectExpr("source as source_id", f"{kind} as artifact_type", "cast(doc_id as int) as section_id", "concat('doc ', cast(doc_id as string)) as section_ref", "text")
