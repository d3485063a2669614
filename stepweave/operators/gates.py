"""Integrity gates and linters: each gives the rows that fail (gate, subject, message); an empty relation passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import text as tx
from stepweave.operators.dims import Dims
from stepweave.operators.graph import cycles, order_scopes
from stepweave.sources import schema as sc


def _errors(rows: DataFrame, gate: int, subject: str | Column, message: Column) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), message.alias("message"))


def gate1(actions: DataFrame) -> DataFrame:
    return _errors(sc.violations(actions, sc.action_checks(), ["recipe_id", "step_number"]), 1, F.concat_ws("/", "recipe_id", "step_number"), F.col("check"))


def gate2(edges: DataFrame) -> DataFrame:
    """Order scopes with cycles, the first three of each."""
    return _errors(cycles(order_scopes(edges)), 2, "scope", F.concat(F.lit("contains a cycle: "), F.array_join("cycle", " -> ")))


def gate3(nodes: DataFrame) -> DataFrame:
    """A Process has states before and after: a row for each side that lacks them."""
    sides = F.array_compact(F.array(F.when(F.size("pre") < 1, F.lit("pre_conditions")), F.when(F.size("post") < 1, F.lit("post_conditions"))))
    return _errors(nodes.filter("node_type = 'Process'").withColumn("side", F.explode(sides)), 3, "node_id", F.concat(F.lit("Process has no "), "side"))


def gate4(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A thermal Process (by its wording) has bounds and an edge to one."""
    thermal = nodes.filter("node_type = 'Process'").filter(tx.is_thermal(F.col("action_phrase")))
    bound = edges.filter("edge_type = 'HAS_SAFETY_BOUND'").select(F.col("from_id").alias("node_id")).distinct().withColumn("_edge", F.lit(True))
    rows = thermal.join(bound, "node_id", "left")
    message = F.when(F.size("safety_bounds") < 1, "thermal Process has no safety bounds").when(F.col("_edge").isNull(), "thermal Process has safety bounds but no edge to one")
    return _errors(rows.withColumn("_m", message).filter("_m is not null"), 4, "node_id", F.col("_m"))


def gate5(nodes: DataFrame, labels: tuple[str, ...] = tx.LABELS) -> DataFrame:
    rows = nodes.select("node_id", F.explode(F.concat("pre", "post")).alias("c")).filter(~F.coalesce(F.col("c.k2_label").isin(*labels), F.lit(False)))
    return _errors(rows, 5, "node_id", F.concat(F.lit("invalid label: "), F.coalesce("c.k2_label", F.lit("null"))))


def gate6(observations: DataFrame, steps: DataFrame) -> DataFrame:
    """A source span is in its step's text; spans of unknown branches or steps aren't checked."""
    rows = observations.join(steps, ["recipe_id", "step_number"]).filter(~F.contains("text", F.col("source_span")))
    return _errors(rows, 6, "node_id", F.format_string("source span not found in %s step %d: '%s'", "recipe_id", "step_number", F.substring("source_span", 1, 60)))


def gate7(nodes: DataFrame, observations: DataFrame, ingredient_nodes: DataFrame, tool_nodes: DataFrame, dims: Dims) -> DataFrame:
    """Only the inventory is used and named, and nothing comes from an excluded branch."""
    spark = nodes.sparkSession
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    entities = F.transform(F.concat("pre", "post"), lambda c: c["entity_id"])
    outside = F.array_sort(F.array_union(F.array_union(F.array_except(entities, lit(dims.inventory)), F.array_except("ingredients", lit(dims.ingredients))), F.array_except("tools", lit(dims.utensils))))
    uses = nodes.withColumn("_o", outside).filter(F.size("_o") > 0)
    names = nodes.withColumn("_n", tx.mentioned(F.col("action_phrase"), list(dims.known_out))).filter(F.size("_n") > 0)
    banned = observations.select("node_id", "recipe_id").distinct().join(dims.excluded_df(spark).select("recipe_id"), "recipe_id")
    parts = [
        _errors(uses, 7, "node_id", F.concat(F.lit("uses entities outside the inventory: "), F.array_join("_o", ", "))),
        _errors(names, 7, "node_id", F.concat(F.lit("action names out-of-inventory items: "), F.array_join("_n", ", "))),
        _errors(banned, 7, "node_id", F.concat(F.lit("comes from excluded branch "), "recipe_id")),
        _errors(ingredient_nodes.filter(~F.col("name").isin(*dims.ingredients)), 7, "name", F.lit("ingredient node is not in the inventory")),
        _errors(tool_nodes.filter(~F.col("name").isin(*dims.utensils)), 7, "name", F.lit("tool node is not in the inventory")),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_all(gates: list[DataFrame]) -> tuple[bool, DataFrame]:
    errors = reduce(DataFrame.unionByName, gates)
    return errors.isEmpty(), errors


def check_rules(dims: Dims, spark, steps: DataFrame) -> DataFrame:
    """Problems (subject, message) of classes, rules and preferences; empty if there are none.

    Phrases in two classes, unknown classes, rules without reason, rules that form a cycle, preferences of an unknown kind
    or with fewer than two choices or unknown branches, and quotes that their source step doesn't have.
    """
    rules, prefs = dims.rules_df(spark), dims.preferences_df(spark)
    classes = dims.class_df(spark).select("cls").distinct()
    branches = steps.select("recipe_id").distinct()
    used = rules.select("rule_id", F.explode(F.concat("before", "after")).alias("cls"))
    issue = lambda rows, subject, message: rows.select(F.col(subject).alias("subject"), message.alias("message"))
    order = rules.select(F.explode("before").alias("from_id"), "after").select("from_id", F.explode("after").alias("to_id")).withColumn("scope", F.lit("order rules"))
    quoted = rules.select(F.concat(F.lit("rule "), "rule_id").alias("subject"), "source_recipe", "source_step", "quote", "curated", F.lit(True).alias("may")).unionByName(
        prefs.select(F.concat(F.lit("preference "), "point", F.lit(" / "), "choice").alias("subject"), "source_recipe", "source_step", "quote", "curated", F.lit(False).alias("may"))
    )
    at = steps.select(F.col("recipe_id").alias("source_recipe"), F.col("step_number").alias("source_step"), "text")
    known = branches.select(F.col("recipe_id").alias("source_recipe"), F.lit(True).alias("_known"))
    sourced = quoted.filter("source_recipe is not null").join(known, "source_recipe", "left").join(at, ["source_recipe", "source_step"], "left")
    wrong = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown branch "), "source_recipe")).when(F.col("text").isNull(), F.concat(F.lit("no step "), F.col("source_step").cast("string"))).when(~F.contains("text", F.coalesce("quote", F.lit(""))), "quote not found")
    parts = [
        issue(used.join(classes, "cls", "left_anti"), "rule_id", F.concat(F.lit("unknown class "), "cls")),
        issue(rules.filter("trim(coalesce(reason, '')) = ''"), "rule_id", F.lit("no reason")),
        issue(cycles(order), "scope", F.concat(F.lit("form a cycle: "), F.array_join("cycle", " -> "))),
        issue(prefs.filter("kind is null or kind not in ('structural', 'parametric')"), "point", F.lit("kind must be structural or parametric")),
        issue(prefs.groupBy("point").agg(F.count(F.lit(1)).alias("n")).filter("n < 2"), "point", F.lit("needs at least two alternatives")),
        issue(prefs.select("point", F.explode("recipes").alias("recipe_id")).join(branches, "recipe_id", "left_anti"), "point", F.concat(F.lit("unknown branch "), "recipe_id")),
        issue(quoted.filter("curated and not may"), "subject", F.lit("curated is for physical rules only")),
        issue(sourced.withColumn("_m", wrong).filter("_m is not null"), "subject", F.col("_m")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def class_overlaps(classes: DataFrame) -> DataFrame:
    """Phrases (normalised) that a table (phrase, cls) puts into several classes."""
    return classes.groupBy(tx.normal_phrase(F.col("phrase")).alias("phrase")).agg(F.array_sort(F.collect_set("cls")).alias("classes")).filter(F.size("classes") > 1)


def blockers(queue: DataFrame, reviewed: DataFrame, scoped: DataFrame, classified: DataFrame, broken: DataFrame, heat: DataFrame) -> DataFrame:
    """What stands against a final graph (kind, subject): unreviewed steps, actions that scope would drop, unclassified
    actions, orders against a rule, thermal wording without a heat tick."""
    key = ["recipe_id", "step_number"]
    at = F.concat_ws("/", "recipe_id", "step_number")
    kind = lambda rows, name, subject: rows.select(F.lit(name).alias("kind"), subject.cast("string").alias("subject"))
    parts = [
        kind(queue.join(reviewed, key, "left_anti"), "unreviewed", at),
        kind(scoped.filter("reason is not null"), "out of scope", at),
        kind(classified.filter("cls is null"), "unclassified", at),
        kind(broken, "order violation", F.concat_ws("/", "recipe_id", "rule_id", "first", "then")),
        kind(heat.filter(tx.is_thermal(F.col("action_phrase")) & ~F.coalesce("thermal", F.lit(False))), "heat not ticked", at),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
