"""Schemas that readers declare (nothing is inferred), and integrity checks as predicates of a violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.nested import CONDITIONS
from stepweave.functions.text import LABELS

NODE_TYPES = ("Process", "Transfer", "Plate")
VERDICTS = ("accept", "revise", "reject")
EDGE_TYPES = ("NEXT", "REQUIRES", "HAS_SAFETY_BOUND", "INGREDIENT_OF", "USES_TOOL")
PAIR_LABELS = ("same", "a_contains_b", "b_contains_a", "different")

RECIPE = "recipe_id string, title string, source_url string, variant_label string, gold boolean, ingredients array<string>, tools array<string>, steps array<struct<number:int,text:string>>, temperatures_mentioned array<string>, timings_mentioned array<string>"
STEP = "recipe_id string, step_number int, text string"
ACTION = (
    f"recipe_id string, step_number int, sub_step int, node_type string, action_phrase string, pre {CONDITIONS}, post {CONDITIONS}, timing struct<duration_s:double,deadline:string>, "
    "ingredients array<string>, tools array<string>, source_span string, in_scope boolean, temperature_c double, confidence double, extractor_model string"
)
VERDICT = "recipe_id string, step_number int, sub_step int, pass int, verdict string, grounding_quote string, issues array<string>, critic_model string, revision_instructions string, scores map<string,double>"
_EXPECTED = "struct<node_type:string,action_phrase:string,pre_conditions:array<struct<entity_id:string,k2_label:string>>,post_conditions:array<struct<entity_id:string,k2_label:string>>,tools:array<string>,has_safety_bound:boolean,in_scope:boolean>"
GOLD = f"recipe_id string, step_number int, expected {_EXPECTED}, sub_steps array<{_EXPECTED}>, split_checked boolean, split_seconds_spent double, annotator string, annotation_date string, notes string, mode string, seconds_spent double, seeded_from_run string, definition_version string"
EDGE = "from_id string, to_id string, edge_type string, recipe_id string, weight double, rule_id string, reason string, bound_id string, temperature_c double, severity string, k2_transition string, seq long"
MERGE_LABEL = "pair_id string, a_id string, b_id string, a_phrase string, b_phrase string, label string, added_by_hand boolean, annotator string, annotation_date string, seconds_spent double, graph_version string, notes string"

#: For rows written before a field was there.
DEFAULTS = {"gold": False, "in_scope": True, "sub_step": 1, "confidence": 1.0, "mode": "corrected", "weight": 1.0, "split_checked": False}


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def action_checks() -> dict[str, Column]:
    """Name of a check, and when a row of actions breaks it."""
    c = F.col
    domain = F.exists(F.concat("pre", "post"), lambda x: ~F.coalesce(x["k2_label"].isin(*LABELS), F.lit(False)))
    return {
        "process_has_states": c("in_scope") & (c("node_type") == "Process") & ((F.size("pre") < 1) | (F.size("post") < 1)),
        "confidence_in_range": ~c("confidence").between(0.0, 1.0),
        "sub_step_positive": c("sub_step") < 1,
        "node_type_known": ~c("node_type").isin(*NODE_TYPES),
        "label_known": domain,
    }


def violations(rows: DataFrame, checks: dict[str, Column], key: list[str]) -> DataFrame:
    """One row (key, check) for every check that a row breaks; empty if all hold."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]))
    return rows.select(*key, F.explode(failed).alias("check"))


def gold_checks() -> dict[str, Column]:
    return {"sub_steps_none_or_several": F.size("sub_steps") == 1}


def not_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: what a uniqueness constraint would refuse."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
