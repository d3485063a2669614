"""The engine's verbs: ingest, extract, verify, fuse, validate, store, evaluate, finalise. Each takes and gives tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators import fuse, gates, graph, merge, review, scope
from stepweave.operators.dims import Dims
from stepweave.sources import html, sinks


@dataclass(frozen=True)
class Graph:
    """A step graph as tables, with the reports of its making."""

    nodes: DataFrame
    edges: DataFrame
    provenance: DataFrame
    ingredient_nodes: DataFrame
    tool_nodes: DataFrame
    bounds: DataFrame
    removed_edges: DataFrame
    violations: DataFrame
    unclassified: DataFrame


def ingest(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes with enough steps, pages for quarantine) from (page_id, url, html)."""
    parsed = html.parse(pages)
    return parsed.filter("enough"), parsed.filter("not enough")


def fuse_graph(actions: DataFrame, dims: Dims) -> Graph:
    """The graph of in-scope actions (ACTION, verdict, optionally thermal): nodes by fingerprint, order, rules, bounds.

    Actions are materialised once with their order and fingerprint; the rest are aggregations and joins over that.
    """
    spark = actions.sparkSession
    rows = fuse.fingerprints(fuse.with_seq(actions), dims.alias_map())
    rows = graph.cut(fuse.classify(rows, dims.class_df(spark)))
    first = fuse.nodes(rows)
    thermal = rows.groupBy("node_id").agg(F.bool_or("thermal").alias("thermal")) if "thermal" in rows.columns else None
    found = fuse.bounds_of(first.join(thermal, "node_id") if thermal is not None else first, dims.bounds_df(spark), dims.default_entity)
    entry = F.struct("bound_seq", "bound_id", "label", "temperature_c", "description", "k2_transition", "severity")
    by = found.groupBy("node_id").agg(F.array_sort(F.collect_set(entry)).alias("safety_bounds"))  # as many as the dimension has
    nodes = first.join(by, "node_id", "left")
    nodes = nodes.withColumn("safety_bounds", F.coalesce("safety_bounds", F.array().cast(nodes.schema["safety_bounds"].dataType)))
    ing, tools, dim_edges = fuse.dimension_edges(nodes)
    order = fuse.next_edges(rows).unionByName(fuse.required_edges(rows, dims.rules_df(spark)))
    kept, removed = graph.break_cycles(order)
    edges = kept.unionByName(fuse.bound_edges(found)).unionByName(dim_edges)
    pos = rows.select("recipe_id", "cls", F.col("seq").alias("pos"))
    _, broken = fuse.required_pairs(pos, dims.rules_df(spark))
    return Graph(graph.cut(nodes), graph.cut(edges), fuse.provenance(rows), ing, tools, found.drop("node_id", "bound_seq").distinct(), removed, broken, rows.filter("cls is null").select("recipe_id", "step_number", "sub_step", "action_phrase"))


def fuse_verified(actions: DataFrame, verdicts: DataFrame, dims: Dims) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, scope report, goal report) from extracted actions and their verdicts."""
    from stepweave.sources.readers import not_rejected

    scoped = scope.apply_scope(not_rejected(actions, verdicts), dims)
    complete, goal = scope.complete_to_goal(scope.in_scope(scoped), dims)
    return fuse_graph(complete, dims), scope.scope_records(scoped), goal


def validate(g: Graph, steps: DataFrame, dims: Dims) -> tuple[bool, DataFrame]:
    """Whether all gates pass, and their errors."""
    return gates.run_all([
        gates.gate2(g.edges), gates.gate3(g.nodes), gates.gate4(g.nodes, g.edges), gates.gate5(g.nodes), gates.gate6(g.provenance, steps), gates.gate7(g.nodes, g.provenance, g.ingredient_nodes, g.tool_nodes, dims),
    ])


def store(g: Graph, path: str) -> None:
    """Tables and the Cypher script under path."""
    sinks.write_graph({"nodes": g.nodes, "edges": g.edges, "provenance": g.provenance, "ingredient_nodes": g.ingredient_nodes, "tool_nodes": g.tool_nodes, "removed_edges": g.removed_edges}, path)
    sinks.write_cypher(sinks.cypher_rows(g.nodes, g.edges, g.ingredient_nodes, g.tool_nodes, g.bounds, g.provenance), f"{path}/cypher")


def finalise(gold: DataFrame, steps: DataFrame, dims: Dims, labels: DataFrame | None = None, allow_unreviewed: bool = False, extracted: DataFrame | None = None) -> tuple[Graph, list[dict]]:
    """(final graph, merge report) from reviewed steps. What `gates.blockers` finds raises: steps not reviewed (unless
    allowed), actions that the scope rule would drop, orders against a rule, actions of no class, heat without its tick."""
    current = gold.filter(review.is_current(dims.definition_version))
    queue = steps.join(dims.excluded_df(steps.sparkSession).select("recipe_id"), "recipe_id", "left_anti")
    actions = review.gold_actions(current, queue, dims, extracted)
    scoped = scope.apply_scope(actions.withColumn("temperature_c", F.lit(None).cast("double")), dims)
    complete, _ = scope.complete_to_goal(scope.in_scope(scoped), dims)
    g = fuse_graph(complete, dims)
    unclassified = g.unclassified.withColumn("cls", F.lit(None).cast("string"))
    found = graph.cut(gates.blockers(queue, queue if allow_unreviewed else current, scoped, unclassified, g.violations, scope.in_scope(scoped).filter("node_type = 'Process'")))
    if not found.isEmpty():
        raise ValueError("; ".join(f"{r['kind']}: {r['n']} ({', '.join(r['some'])})" for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("subject")), 1, 5).alias("some")).orderBy("kind").collect()))
    if labels is None:
        return g, []
    mapping, edges, report = merge.apply_merges(g.nodes, g.edges, labels)
    shared = g.provenance.join(mapping, F.col("node_id") == F.col("node"), "left").withColumn("node_id", F.coalesce("representative", "node_id")).drop("node", "representative")
    counts = shared.select("node_id", "recipe_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n_recipes"))
    nodes = merge.contract(g.nodes, mapping).join(counts, "node_id", "left")
    return Graph(graph.cut(nodes), edges, shared, g.ingredient_nodes, g.tool_nodes, g.bounds, g.removed_edges, g.violations, g.unclassified), report
