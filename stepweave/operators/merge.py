"""Merging nodes that reviewers label as the same step: candidate pairs, groups, contraction, conflicts.

Pairs meet inside blocks (node type and state transition). Labels are made by people, so they and their groups are few;
the graph is not, and is contracted by joins with the map of merged nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.operators.fuse import unique_edges
from stepweave.operators.graph import by_branch, components, cut, cycles, cycles_after_merge, few_requires, order_scopes


#: Nodes of a block whose pairs are made in one go.
PART = 1024


def with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", nested.block_key(F.col("node_type"), F.col("pre"), F.col("post")))


def candidate_pairs(blocked: DataFrame, node: str = "node_id", block: str = "block") -> DataFrame:
    """block, block_size, a, b: every pair of a block's nodes, a < b. What reviewers are asked, so pairs are the result."""
    rows = blocked.select(F.col(block).alias("block"), F.col(node).alias("node")).distinct()
    size = rows.groupBy("block").agg(F.count(F.lit(1)).alias("block_size"))
    return rows.withColumnRenamed("node", "a").join(rows.withColumnRenamed("node", "b"), "block").filter("a < b").join(size, "block").select("block", "block_size", "a", "b")


def review_queue(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidate pairs and those added by hand, each once, largest blocks first."""
    made = pairs.withColumn("pair_id", tx.pair_id(F.col("a"), F.col("b"))).withColumn("_made", F.lit(0))
    hand = labels.filter("added_by_hand").select("pair_id", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).withColumn("_made", F.lit(1))
    both = made.unionByName(hand, allowMissingColumns=True)
    turn = F.row_number().over(Window.partitionBy("pair_id").orderBy("_made"))
    return both.withColumn("_turn", turn).filter("_turn = 1").drop("_turn", "_made").orderBy(F.desc_nulls_last("block_size"), "block", "a", "b")


def block_queue(blocked: DataFrame, labels: DataFrame, node: str = "node_id", block: str = "block") -> DataFrame:
    """The review queue of all blocks, without a shuffle of its pairs: parts of blocks are put in order, each with the nodes that
    its own meet, and pairs are made where the parts are. Where a node is in several blocks, pairs are compared by id."""
    rows = cut(blocked.select(F.col(block).alias("block"), F.col(node).alias("node")).filter("block is not null and node is not null").distinct())
    if not rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return review_queue(candidate_pairs(rows, "node"), labels)
    whole = rows.groupBy("block").agg(F.array_sort(F.collect_list("node")).alias("_nodes")).withColumn("block_size", F.size("_nodes").cast("long"))
    starts = whole.filter("block_size > 1").withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_nodes"), F.lit(PART))))
    parts = starts.select("block_size", "block", "_at", F.slice("_nodes", F.col("_at"), F.size("_nodes")).alias("_nodes"))
    order = [F.desc("block_size"), "block", "_at"]
    n = int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(parts.repartitionByRange(n, *order).sortWithinPartitions(*order))
    ahead = placed.select("block_size", "block", "_nodes", F.posexplode(F.slice("_nodes", 1, PART)).alias("_own", "a"))
    made = ahead.select("block", "block_size", "a", F.explode(F.slice("_nodes", F.col("_own") + 2, F.size("_nodes"))).alias("b"))
    made = made.select("block", "block_size", "a", "b", F.concat("a", F.lit("__"), "b").alias("pair_id"))
    hand = labels.filter("added_by_hand").select("pair_id", F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).dropDuplicates(["pair_id"])
    ends = [rows.select("block", F.col("node").alias(x)) for x in "ab"]
    hand = hand.join(hand.join(ends[0], "a").join(ends[1], ["block", "b"]).select("pair_id"), "pair_id", "left_anti")
    hand = hand.select(F.lit(None).cast(rows.schema["block"].dataType).alias("block"), F.lit(None).cast("long").alias("block_size"), "a", "b", "pair_id")
    return made.union(hand.orderBy("a", "b"))


def current_labels(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels whose two nodes are in the graph."""
    ids = nodes.select("node_id")
    return labels.join(ids.withColumnRenamed("node_id", "a_id"), "a_id", "left_semi").join(ids.withColumnRenamed("node_id", "b_id"), "b_id", "left_semi")


def stale_labels(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    return labels.join(current_labels(labels, nodes).select("pair_id"), "pair_id", "left_anti")


def merge_groups(labels: DataFrame) -> DataFrame:
    """node, component for nodes joined by `same` labels."""
    return components(labels.filter("label = 'same'").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def not_transitive(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Labels other than `same` between two nodes of one group."""
    a, b = (groups.select(F.col("node").alias(f"{k}_id"), F.col("component").alias(f"_{k}")) for k in "ab")
    return labels.filter("label <> 'same'").join(a, "a_id").join(b, "b_id").filter("_a = _b").select("pair_id", "a_id", "b_id", "label", F.col("_a").alias("component"))


def representatives(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """component, representative: most branches, then the shortest wording, then the least id."""
    order = F.struct(-F.col("n_recipes"), F.length("action_phrase"), F.col("node_id"))
    return nodes.join(groups, F.col("node_id") == F.col("node")).groupBy("component").agg(F.min_by("node_id", order).alias("representative"))


def redirect(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends moved to representatives (node, representative), loops dropped, duplicates folded."""
    a = mapping.select(F.col("node").alias("from_id"), F.col("representative").alias("_a"))
    b = mapping.select(F.col("node").alias("to_id"), F.col("representative").alias("_b"))
    moved = edges.join(a, "from_id", "left").join(b, "to_id", "left").withColumns({"from_id": F.coalesce("_a", "from_id"), "to_id": F.coalesce("_b", "to_id")})
    return unique_edges(moved.filter("from_id <> to_id").select(edges.columns))


def contract(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes with every group folded into its representative: its wording and states, the union of names and bounds,
    summed observations, pooled confidence, the first timing there is, other wordings as variant_phrases."""
    lead = nodes.join(mapping, F.col("node_id") == F.col("node"), "left").withColumn("_rep", F.coalesce("representative", "node_id"))
    lead = lead.withColumn("_o", F.struct((F.col("node_id") != F.col("_rep")).alias("later"), F.col("node_id").alias("id")))
    own = lambda c: F.min_by(c, "_o").alias(c)
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("x")))), lambda s: s["x"]))).alias(c)
    aggs = [own(c) for c in ("node_type", "action_phrase", "canonical_action", "pre", "post")]
    aggs += [in_order(c) for c in ("ingredients", "tools")]
    if "safety_bounds" in nodes.columns:
        aggs.append(in_order("safety_bounds"))
    if "timing" in nodes.columns:
        aggs.append(F.min_by("timing", F.when(F.col("timing").isNotNull(), F.col("_o"))).alias("timing"))
    variants = F.transform(F.array_sort(F.collect_list(F.when(F.col("_o.later"), F.struct(F.col("_o.id").alias("id"), F.col("action_phrase").alias("p"))))), lambda s: s["p"])
    pooled = F.sum(F.col("mean_confidence") * F.col("n_observations")) / F.sum("n_observations")
    return lead.groupBy(F.col("_rep").alias("node_id")).agg(*aggs, F.min("seq").alias("seq"), F.sum("n_observations").alias("n_observations"), pooled.alias("mean_confidence"), variants.alias("variant_phrases"))


def apply_merges(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(mapping node -> representative, contracted edges, report) from the current `same` labels.

    Groups are taken largest first; one is skipped where its pairs disagree (not transitive), its members' blocks differ,
    or folding it, on top of those folded before, would close a cycle in an order scope. Folding more never opens a cycle
    between groups, so groups are tried together, twice as many after each success and half as many after a failure:
    tries grow with the groups that are skipped and the logarithm of all. The driver holds the labels' groups only, which
    people made; each try runs on the cluster.
    """
    spark = nodes.sparkSession
    labels = current_labels(labels, nodes)
    groups = cut(merge_groups(labels))
    reps = {r[0]: r[1] for r in representatives(nodes, groups).collect()}
    blocks = with_block(nodes).join(groups, F.col("node_id") == F.col("node")).select("component", "node_id", "block", "action_phrase").collect()
    broken = {r["component"]: r for r in not_transitive(labels, groups).collect()}
    members: dict = {}
    for r in sorted(blocks, key=lambda r: r["node_id"]):
        members.setdefault(r["component"], []).append(r)
    report: list[dict] = []
    todo: list[tuple[dict, list[tuple[str, str]]]] = []
    for component, rows in sorted(members.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        entry = {"group": [r["action_phrase"] for r in rows], "nodes": [r["node_id"] for r in rows], "representative": reps[component], "reason": None}
        if component in broken:
            entry["reason"] = f"not transitive: {broken[component]['pair_id']} is {broken[component]['label']}"
        elif len({r["block"] for r in rows}) > 1:
            entry["reason"] = "members differ in node type or transition"
        else:
            todo.append((entry, [(r["node_id"], reps[component]) for r in rows]))
        report.append(entry)
    kept: list[tuple[str, str]] = []
    mapped = lambda pairs: spark.createDataFrame(pairs, "node string, representative string")
    requires, nexts, large = few_requires(edges), None, edges
    if requires is not None and todo:  # small branches are tried where they are, each in its task
        nexts, large = by_branch(edges, [])
        nexts = cut(nexts)

    def closed(pairs: list[tuple[str, str]]) -> list[DataFrame]:
        """Frames (scope, cycle) that have rows if folding the pairs closes a cycle."""
        small = [] if nexts is None else [cycles_after_merge(nexts, requires, dict(pairs))]
        return small + ([] if large is None else [cycles(cut(order_scopes(cut(redirect(large, mapped(pairs)))).select("scope", "from_id", "to_id")))])

    step = 1  # groups tried at a time
    while todo:
        new = [pair for _, pairs in todo[:step] for pair in pairs]
        found = closed(kept + new)
        if all(f.isEmpty() for f in found):
            kept, todo, step = kept + new, todo[step:], 2 * step
        elif step > 1:
            step //= 2
        else:
            named = sorted({(r["scope"], tuple(r["cycle"])) for f in found for r in f.collect()})
            todo[0][0]["reason"] = "order cycle: " + "; ".join(f"{scope}: {' -> '.join(cycle)}" for scope, cycle in named)
            todo = todo[1:]
    return mapped(kept), cut(redirect(edges, mapped(kept)) if kept else edges), report


def conflicts(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> list[dict]:
    """What keeps current labels from being applied: pairs that disagree with their group, and order cycles."""
    labels = current_labels(labels, nodes)
    broken = not_transitive(labels, merge_groups(labels)).collect()
    out = [{"kind": "not_transitive", "pair_id": r["pair_id"], "detail": f"{r['a_id']} and {r['b_id']} are labelled {r['label']} but merged through other labels"} for r in broken]
    _, _, report = apply_merges(nodes, edges, labels)
    return out + [{"kind": "order_cycle", "pair_id": None, "detail": f"{' = '.join(e['group'])}: {e['reason']}"} for e in report if (e["reason"] or "").startswith("order cycle")]
