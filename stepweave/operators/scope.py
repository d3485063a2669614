"""The scope rule: actions are trimmed to an inventory, and dropped where nothing of it is left; branches end at a goal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions import nested
from stepweave.functions.nested import CONDITIONS
from stepweave.operators.dims import Dims

RULE_MODEL = "rule/goal_completion"


def apply_scope(actions: DataFrame, dims: Dims) -> DataFrame:
    """Actions with conditions, ingredients and tools of the inventory only, plus removed_entities and reason.

    reason is null for actions that stay; of several reasons the first in this order counts: marked as outside, the
    phrase names something outside, nothing of the inventory is involved, a Process without a state change.
    """
    aliases = dims.alias_map()
    empty = F.array().cast("array<string>")
    filled = actions.withColumns({"ingredients": F.coalesce("ingredients", empty), "tools": F.coalesce("tools", empty), "pre": F.coalesce("pre", F.array().cast(CONDITIONS)), "post": F.coalesce("post", F.array().cast(CONDITIONS))})
    outside = nested.outside_entities(F.col("pre"), F.col("post"), F.col("ingredients"), F.col("tools"), aliases, list(dims.inventory))
    named = filled.withColumn("removed_entities", outside)
    named = named.withColumn("_named", nested.scope_issues(F.col("action_phrase"), F.col("removed_entities"), list(dims.known_out)))
    inside = lambda c: nested.first_conditions(F.filter(nested.resolve_conditions(F.col(c), aliases), lambda x: x["entity_id"].isin(*dims.inventory)))
    names = lambda c, known: F.array_distinct(F.filter(F.transform(c, lambda n: nested.resolve(n, aliases)), lambda n: n.isin(*known)))
    out = named.withColumns({"pre": inside("pre"), "post": inside("post"), "ingredients": names("ingredients", dims.ingredients), "tools": names("tools", dims.utensils)})
    nothing = (F.size("pre") + F.size("post") + F.size("ingredients") + F.size("tools")) == 0
    reason = (
        F.when(~F.coalesce("in_scope", F.lit(True)), "generator marked the step as outside the dish")
        .when(F.size("_named") > 0, F.concat(F.lit("action_phrase names out-of-inventory items: "), F.array_join("_named", ", ")))
        .when(nothing, "no inventory item is involved")
        .when((F.col("node_type") == "Process") & ((F.size("pre") == 0) | (F.size("post") == 0)), "Process has no state change on an inventory item")
    )
    return out.withColumn("reason", reason).drop("_named")


def in_scope(scoped: DataFrame) -> DataFrame:
    return scoped.filter("reason is null").drop("reason", "removed_entities")


def scope_report(scoped: DataFrame) -> DataFrame:
    """One row: steps_dropped, steps_trimmed."""
    return scoped.agg(F.count_if(F.col("reason").isNotNull()).alias("steps_dropped"), F.count_if(F.col("reason").isNull() & (F.size("removed_entities") > 0)).alias("steps_trimmed"))


def scope_records(scoped: DataFrame) -> DataFrame:
    return scoped.filter("reason is not null or size(removed_entities) > 0").select("recipe_id", "step_number", "sub_step", "action_phrase", "removed_entities", F.col("reason").isNotNull().alias("dropped"), F.coalesce("reason", F.lit("")).alias("reason"))


def goal_states(actions: DataFrame, dims: Dims) -> DataFrame:
    """recipe_id, has_plate, last_state of the goal entity (in order of steps and conditions), last_step."""
    states = F.filter("post", lambda c: c["entity_id"] == dims.goal_entity)
    last = F.element_at(states, -1)["k2_label"]
    return actions.withColumn("_n", F.size(states)).groupBy("recipe_id").agg(
        F.bool_or(F.col("node_type") == "Plate").alias("has_plate"),
        F.max_by(F.when(F.col("_n") > 0, last), F.when(F.col("_n") > 0, F.struct("step_number", "sub_step"))).alias("last_state"),
        F.max("step_number").alias("last_step"),
    )


def complete_to_goal(actions: DataFrame, dims: Dims) -> tuple[DataFrame, DataFrame]:
    """(actions with a closing Plate action where a branch has none, report: recipe_id, last_state, step_number, added).

    The added action keeps the goal entity in its last state, has no span, and RULE_MODEL as its extractor. A branch
    that never reaches a goal state stays as it is and is reported with added = false.
    """
    open_ = goal_states(actions, dims).filter("not has_plate").withColumn("added", F.coalesce(F.col("last_state").isin(*dims.goal_labels), F.lit(False)))
    state = F.array(F.struct(F.lit(dims.goal_entity).alias("entity_id"), F.col("last_state").alias("physics_state"), F.col("last_state").alias("k2_label"))).cast(CONDITIONS)
    value = {
        "recipe_id": F.col("recipe_id"), "step_number": F.col("last_step") + 1, "sub_step": F.lit(1), "node_type": F.lit("Plate"), "action_phrase": F.lit(dims.goal_action), "pre": state, "post": state,
        "ingredients": F.array(F.lit(dims.goal_entity)), "tools": F.array(F.lit(dims.goal_location)), "source_span": F.lit(""), "in_scope": F.lit(True), "confidence": F.lit(1.0), "extractor_model": F.lit(RULE_MODEL), "verdict": F.lit("accept"),
    }
    new = open_.filter("added").select(*[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in actions.schema])
    return actions.unionByName(new), open_.select("recipe_id", "last_state", (F.col("last_step") + 1).alias("step_number"), "added")
