"""Table schemas and enumerated domains. Order within a source is a column (`ordinal`), never row order."""

from __future__ import annotations

ARTIFACT_TYPES = ("srs", "user_manual", "runtime", "design")
ENTITY_TYPES = ("function_point", "constraint", "actor_role", "glossary_term", "interface_name", "process_step", "exception_condition")
ISSUE_TYPES = ("conflict", "omission", "ambiguity", "to_confirm")
SEVERITIES = ("blocker", "major", "minor")
TR_CATEGORIES = ("functional", "nfr_constraint", "runtime_environment", "interface_exception", "consistency_driven")
PRIORITIES = ("high", "medium", "low")

#: Entity types asked for per kind of document (fixed values); replies of other types are kept.
ASKED_TYPES = {
    "srs": ("function_point", "constraint", "actor_role", "interface_name", "exception_condition"),
    "user_manual": ("function_point", "actor_role", "process_step", "glossary_term", "exception_condition"),
    "runtime": ("interface_name", "constraint", "exception_condition", "function_point"),
    "design": ("interface_name", "actor_role", "function_point", "constraint", "glossary_term"),
}

SECTION = "source_id string, artifact_type string, section_id int, section_ref string, text string"
CHUNK = "chunk_id string, source_id string, artifact_type string, content string, page_ref string, metadata struct<section_id:int,chunk_index:int,token_count:int,overlap:boolean>"
ENTITY = "source_id string, artifact_type string, entity_type string, content string, page_ref string, confidence_score double, ordinal int"
USE_CASE = "struct<use_case_id:string,actor:string,goal:string,preconditions:array<string>,steps:array<string>,postconditions:array<string>,exceptions:array<string>>"
DEMAND_ITEM = "source_id string, field string, ordinal int, item_id string, text string, actor string, category string, threshold string, priority string, parts array<string>, source_ids array<string>"
ISSUE = "comparison_id string, source_a string, source_b string, ordinal int, issue_id string, issue_type string, source_a_id string, source_b_id string, description string, severity string, affected_req_ids array<string>, suggested_fix string"
TR_A = "struct<tr_id:string,preconditions:array<string>,stimuli:array<string>,expected_outputs:array<string>,coverage_criterion:string,priority:string,source_req_ids:array<string>>"
REQUIREMENT = f"source_id string, ordinal int, tr_id string, category string, tr_h string, tr_a {TR_A}, source_req_ids array<string>"
VERDICT = "tr_id string, tr_h string, source string, verdict string"
