"""Fusing actions into a step graph: fingerprints, provenance, order, rules, bounds, dimensions.

Actions carry `seq`, their global order (branch, step, sub-step); nothing relies on the order of rows. Its high bits are
the range of the order that a row was dealt to, so what follows the order of a branch works range by range (`neighbours`)
and a branch of any length is no single task. Provenance is a table with one row for each observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.operators.dims import Dims
from stepweave.operators.graph import cut

#: Bits of seq that count rows inside a range of the order.
RANGE_BITS = 33
#: Observations in one row of `nested_provenance`.
SEGMENT = 1000

EDGE_COLUMNS = ("from_id", "to_id", "edge_type", "recipe_id", "weight", "rule_id", "reason", "bound_id", "temperature_c", "severity", "k2_transition", "seq")
_TYPES = {"weight": "double", "temperature_c": "double", "seq": "long"}


def as_edges(df: DataFrame) -> DataFrame:
    """All edge columns, absent ones null, weight 1 by default."""
    have = lambda c: F.col(c) if c in df.columns else (F.lit(1.0) if c == "weight" else F.lit(None))
    return df.select(*[have(c).cast(_TYPES.get(c, "string")).alias(c) for c in EDGE_COLUMNS])


def with_seq(actions: DataFrame) -> DataFrame:
    """seq: larger for what is later in the order of branches (by id), steps and sub-steps; rows that tie in all three come
    in any order. One shuffle into ranges and a sort inside each; written, so that all that follows sees one order."""
    order = ["recipe_id", "step_number", "sub_step"]
    n = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(actions.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()))


def neighbours(rows: DataFrame, columns: list[str], before: bool = False, key: str = "recipe_id") -> DataFrame:
    """Rows (key, seq, ...) with `_near`, the struct of columns of the next row of the key by seq (before: the last one),
    null at its end.

    Inside a range that is a window over the key's rows there; between ranges, over one row for each key and range.
    """
    value = F.struct(*columns)
    ranged = rows.withColumn("_range", F.shiftright("seq", RANGE_BITS))
    inside = Window.partitionBy(key, "_range").orderBy("seq")
    edge = (F.max_by if before else F.min_by)(value, "seq").alias("_edge")
    across = Window.partitionBy(key).orderBy("_range")
    step = F.lag if before else F.lead
    ends = ranged.groupBy(key, "_range").agg(edge).select(F.col(key).alias("_key"), F.col("_range").alias("_at"), step("_edge").over(across).alias("_edge"))
    near = ranged.withColumns({"_near": step(value).over(inside), "_last": step(F.lit(1)).over(inside).isNull()})
    joined = near.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("_near", F.when(F.col("_last"), F.col("_edge")).otherwise(F.col("_near"))).drop("_range", "_last", "_key", "_at", "_edge")


def fingerprints(actions: DataFrame, aliases: Column) -> DataFrame:
    """Actions with resolved conditions and node_id."""
    out = actions.withColumns({"pre": nested.resolve_conditions(F.col("pre"), aliases), "post": nested.resolve_conditions(F.col("post"), aliases)})
    return out.withColumn("node_id", tx.fingerprint(F.col("node_type"), F.col("action_phrase"), nested.conditions_key(F.col("pre")), nested.conditions_key(F.col("post"))))


def provenance(actions: DataFrame) -> DataFrame:
    return actions.select("node_id", "seq", "recipe_id", "step_number", "source_span", "extractor_model", "verdict", "confidence")


def nodes(actions: DataFrame) -> DataFrame:
    """One row a fingerprint: the first observation's values (of safety_bounds the first that aren't empty), the names of
    all, counts and mean confidence.

    Aggregated before the shuffle; only distinct names are collected, never observations.
    """
    first = lambda c: F.min_by(c, "seq").alias(c)
    kept = [first(c) for c in ("node_type", "action_phrase", "pre", "post", "timing") if c in actions.columns]
    if "safety_bounds" in actions.columns:
        kept.append(F.coalesce(F.min_by("safety_bounds", F.when(F.size("safety_bounds") > 0, F.col("seq"))), F.min_by("safety_bounds", "seq")).alias("safety_bounds"))
    base = actions.groupBy("node_id").agg(*kept, F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_observations"), F.avg("confidence").alias("mean_confidence"))
    named = [_ordered_names(actions, c) for c in ("ingredients", "tools")]
    shared = actions.select("node_id", "recipe_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n_recipes"))
    out = base.join(shared, "node_id")
    for n in named:
        out = out.join(n, "node_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"canonical_action": tx.canonical_action(F.col("action_phrase")), "ingredients": F.coalesce("ingredients", empty), "tools": F.coalesce("tools", empty)})


def _ordered_names(actions: DataFrame, column: str) -> DataFrame:
    """node_id, distinct names in the order first seen."""
    seen = actions.select("node_id", "seq", F.posexplode(column).alias("at", "name")).groupBy("node_id", "name").agg(F.min(F.struct("seq", "at")).alias("first"))
    listed = seen.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("l"))
    return listed.select("node_id", F.transform("l", lambda x: x["name"]).alias(column))


def nested_provenance(observations: DataFrame) -> DataFrame:
    """node_id, segment, provenance (array in order of seq): SEGMENT observations a row, so a node may have any number.

    Observations are numbered by node inside ranges of seq, and ranges by their counts.
    """
    entry = F.struct("seq", "recipe_id", "step_number", "source_span", "extractor_model", "verdict", "confidence")
    ranged = observations.withColumn("_range", F.shiftright("seq", RANGE_BITS))
    ahead = Window.partitionBy("node_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("node_id", "_range").agg(F.count(F.lit(1)).alias("_n")).select("node_id", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    turn = F.row_number().over(Window.partitionBy("node_id", "_range").orderBy("seq")) - 1
    placed = ranged.withColumn("_turn", turn).join(counts, ["node_id", "_range"])
    segment = F.floor((F.col("_turn") + F.col("_before")) / SEGMENT)
    return placed.groupBy("node_id", segment.alias("segment")).agg(F.array_sort(F.collect_list(entry)).alias("provenance"))


def next_edges(actions: DataFrame) -> DataFrame:
    """Consecutive actions of a branch; each (from, to, branch) once, at its first place."""
    pairs = neighbours(actions.select("recipe_id", "seq", "node_id"), ["node_id"]).select("recipe_id", "seq", F.col("node_id").alias("from_id"), F.col("_near.node_id").alias("to_id")).filter("to_id is not null")
    return as_edges(pairs.groupBy("from_id", "to_id", "recipe_id").agg(F.min("seq").alias("seq")).withColumn("edge_type", F.lit("NEXT")))


def classify(actions: DataFrame, classes: DataFrame) -> DataFrame:
    """Actions with cls, null where no phrase of the class table fits."""
    keyed = classes.select(tx.normal_phrase(F.col("phrase")).alias("_phrase"), "cls").dropDuplicates(["_phrase"])
    return actions.withColumn("_phrase", tx.normal_phrase(F.col("action_phrase"))).join(keyed, "_phrase", "left").drop("_phrase")


def rule_pairs(rules: DataFrame) -> DataFrame:
    return rules.select("rule_seq", "rule_id", "reason", F.explode("before").alias("before"), "after").select("rule_seq", "rule_id", "reason", "before", F.explode("after").alias("after")).distinct()


def required_pairs(classified: DataFrame, rules: DataFrame, key: str = "recipe_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, violations) of positions: key, rule_id, first, then.

    A pair is an earlier action of a class before a later one that must follow it; a violation has them the other way
    round. Rules join first, on classes, so only ordered classes of one branch meet. `pos` is the action's place.
    """
    pairs = rule_pairs(rules)
    early = classified.select(key, F.col("pos").alias("first"), F.col("cls").alias("before"))
    late = classified.select(key, F.col("pos").alias("then"), F.col("cls").alias("after"))
    met = early.join(F.broadcast(pairs), "before").join(late, [key, "after"]).filter("first < then").select(key, "rule_id", "first", "then").distinct()
    early, late = early.withColumnRenamed("before", "after"), late.withColumnRenamed("after", "before")
    broken = early.join(F.broadcast(pairs), "after").join(late, [key, "before"]).filter("first < then").select(key, "rule_id", "first", "then").distinct()
    return met, broken


def required_edges(classified: DataFrame, rules: DataFrame) -> DataFrame:
    """REQUIRES edges between nodes; of a pair of nodes the first branch and rule stays.

    Works on each branch's distinct nodes with their first and last places: some occurrence of one is before some of
    the other just if its first place is before the other's last. Repeats in a branch so don't multiply.
    """
    spots = classified.filter("cls is not null").groupBy("recipe_id", "node_id", "cls").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    before = spots.select("recipe_id", F.col("node_id").alias("from_id"), F.col("cls").alias("before"), "_lo").join(F.broadcast(rule_pairs(rules)), "before")
    after = spots.select("recipe_id", F.col("node_id").alias("to_id"), F.col("cls").alias("after"), "_hi")
    found = before.join(after, ["recipe_id", "after"]).filter("_lo < _hi and from_id <> to_id")
    # the first in the order of branches, then rules, then places
    best = found.groupBy("from_id", "to_id").agg(F.min(F.struct("recipe_id", "rule_seq", F.col("_lo").alias("seq"), "rule_id", "reason")).alias("b"))
    return as_edges(best.select("from_id", "to_id", "b.recipe_id", "b.rule_id", "b.reason", "b.seq", F.lit("REQUIRES").alias("edge_type")))


def bounds_of(actions: DataFrame, bounds: DataFrame, default_entity: str, key: str = "node_id") -> DataFrame:
    """key and every bound of a thermal action: those of its entities and those of the default entity, in bound order.

    `thermal` may hold a reviewer's decision; where null it follows from the wording. Bounds are few (a dimension), and
    the join is on their entity: each action's distinct entities, with the default one added.
    """
    decided = F.coalesce("thermal", tx.is_thermal(F.col("action_phrase"))) if "thermal" in actions.columns else tx.is_thermal(F.col("action_phrase"))
    entities = F.array_distinct(F.concat(F.transform(F.concat("pre", "post"), lambda c: c["entity_id"]), F.array(F.lit(default_entity))))
    return actions.filter(decided).select(key, F.explode(entities).alias("entity")).distinct().join(bounds, "entity").select(key, "seq", "bound_id", "label", "temperature_c", "description", "k2_transition", "severity").withColumnRenamed("seq", "bound_seq")


def bound_edges(found: DataFrame) -> DataFrame:
    return as_edges(found.select(F.col("node_id").alias("from_id"), F.concat(F.lit("bound_"), "bound_id").alias("to_id"), F.lit("HAS_SAFETY_BOUND").alias("edge_type"), "bound_id", "temperature_c", "severity", "k2_transition").distinct())


def dimension_edges(nodes_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ingredient nodes, tool nodes, edges): each name once; INGREDIENT_OF from name to node, USES_TOOL from node to name."""
    def part(column: str, prefix: str) -> DataFrame:
        return nodes_.select("node_id", F.explode(column).alias("name")).distinct().withColumn("id", F.concat(F.lit(prefix), F.regexp_replace("name", " ", "_")))

    ing, tool = part("ingredients", "ing_"), part("tools", "tool_")
    edges = as_edges(ing.select(F.col("id").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("INGREDIENT_OF").alias("edge_type"))).unionByName(
        as_edges(tool.select(F.col("node_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("USES_TOOL").alias("edge_type")))
    )
    return ing.select("id", "name").distinct(), tool.select("id", "name").distinct(), edges


def unique_edges(edges: DataFrame) -> DataFrame:
    """NEXT edges once a branch, others once: the first by seq, then branch and rule."""
    scope = F.when(F.col("edge_type") == "NEXT", F.coalesce("recipe_id", F.lit(""))).otherwise(F.lit(""))
    rest = [c for c in edges.columns if c not in ("from_id", "to_id", "edge_type")]
    lead = [c for c in ("seq", "recipe_id", "rule_id") if c in rest]
    first = F.min_by(F.struct(*rest), F.struct(*lead)) if lead else F.first(F.struct(*rest))
    return edges.withColumn("_scope", scope).groupBy("from_id", "to_id", "edge_type", "_scope").agg(first.alias("_r")).select("from_id", "to_id", "edge_type", "_r.*").select(edges.columns)


def shared_nodes(nodes_: DataFrame) -> DataFrame:
    return nodes_.filter("n_recipes > 1")


def branch_labels(actions: DataFrame) -> list[str]:
    return sorted(r[0] for r in actions.select("recipe_id").distinct().collect())


def dims_of(dims: Dims, spark) -> dict[str, DataFrame]:
    return {"bounds": dims.bounds_df(spark), "rules": dims.rules_df(spark), "classes": dims.class_df(spark)}
