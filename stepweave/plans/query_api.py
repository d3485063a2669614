"""Read-only queries over a finished graph.

The step contexts (node, states after it, bounds, what follows) are built once, in the shared folder, sorted by branch
and node; every call is then a point filter over them. Unknown nodes and branches raise, as lookups do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.graph import cut


class GraphQuery:
    def __init__(self, nodes: DataFrame, edges: DataFrame, preferences: DataFrame | None = None, bounds: DataFrame | None = None):
        """nodes and edges of a graph; preferences (point, kind, choice, recipes, outcome); bounds (node_id, bound_id, ...)."""
        self.nodes, self.edges, self._preferences, self._bounds = nodes, edges, preferences, bounds

    @cached_property
    def nexts(self) -> DataFrame:
        return self.edges.filter("edge_type = 'NEXT' and recipe_id is not null").select("recipe_id", "from_id", "to_id").distinct()

    @cached_property
    def on_branch(self) -> DataFrame:
        return self.nexts.select("recipe_id", F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()

    @cached_property
    def step_context(self) -> DataFrame:
        """recipe_id, node_id, node_type, action_phrase, pre, post, bounds, next_ids: what `step` looks up."""
        return cut(self.contexts().repartitionByRange("recipe_id", "node_id").sortWithinPartitions("recipe_id", "node_id"))

    def contexts(self) -> DataFrame:
        """The rows of step_context as a plan."""
        after = self.nexts.groupBy("recipe_id", F.col("from_id").alias("node_id")).agg(F.array_sort(F.collect_set("to_id")).alias("next_ids"))
        out = self.on_branch.join(self.nodes.select("node_id", "node_type", "action_phrase", "pre", "post"), "node_id").join(after, ["recipe_id", "node_id"], "left")
        bounds = self.bound_rows.groupBy("node_id").agg(F.array_sort(F.collect_set("bound_id")).alias("bounds"))
        none = F.array().cast("array<string>")
        return out.join(bounds, "node_id", "left").withColumns({"next_ids": F.coalesce("next_ids", none), "bounds": F.coalesce("bounds", none)})

    @cached_property
    def bound_rows(self) -> DataFrame:
        """Bounds of nodes that also have an edge to them."""
        linked = self.edges.filter("edge_type = 'HAS_SAFETY_BOUND'").select(F.col("from_id").alias("node_id"), F.col("to_id").alias("_to")).distinct()
        if self._bounds is None:
            return self.edges.filter("edge_type = 'HAS_SAFETY_BOUND'").select(F.col("from_id").alias("node_id"), "bound_id", "temperature_c", "severity", "k2_transition").distinct()
        return self._bounds.withColumn("_to", F.concat(F.lit("bound_"), "bound_id")).join(linked, ["node_id", "_to"], "left_semi").drop("_to")

    def branches(self) -> list[str]:
        return sorted(r[0] for r in self.nexts.select("recipe_id").distinct().collect())

    def node(self, node_id: str):
        row = self.nodes.filter(F.col("node_id") == node_id).first()
        if row is None:
            raise KeyError(f"unknown node {node_id}")
        return row

    def entry_points(self) -> DataFrame:
        """recipe_id, node_id: nodes of a branch that nothing in it leads to."""
        entered = self.nexts.select("recipe_id", F.col("to_id").alias("node_id"))
        return self.on_branch.join(entered, ["recipe_id", "node_id"], "left_anti")

    def entry_nodes(self, branch: str) -> list[str]:
        self._known(branch)
        return sorted(r[0] for r in self.entry_points().filter(F.col("recipe_id") == branch).select("node_id").collect())

    def post_conditions(self, node_id: str) -> list:
        return self.node(node_id)["post"]

    def safety_bounds(self, node_id: str) -> DataFrame:
        self.node(node_id)
        return self.bound_rows.filter(F.col("node_id") == node_id)

    def next_node_ids(self, node_id: str, branch: str | None = None) -> list[str]:
        rows = self.nexts.filter(F.col("from_id") == node_id)
        if branch is not None:
            self._known(branch)
            rows = rows.filter(F.col("recipe_id") == branch)
        return list(dict.fromkeys(r["to_id"] for r in rows.orderBy("recipe_id", "to_id").collect()))

    def step(self, branch: str, node_id: str):
        self._known(branch)
        row = self.step_context.filter((F.col("recipe_id") == branch) & (F.col("node_id") == node_id)).first()
        if row is None:
            self.node(node_id)
            raise ValueError(f"node {node_id} is not on branch {branch}")
        return row

    def around(self) -> DataFrame:
        """recipe_id, node_id, previous_ids, next_ids: a node's neighbours on each of its branches, sorted."""
        at, none = ["recipe_id", "node_id"], F.array().cast("array<string>")
        side = lambda own, other, name: self.nexts.groupBy("recipe_id", F.col(own).alias("node_id")).agg(F.array_sort(F.collect_set(other)).alias(name))
        both = side("to_id", "from_id", "previous_ids").join(side("from_id", "to_id", "next_ids"), at, "full_outer")
        return both.withColumns({c: F.coalesce(c, none) for c in ("previous_ids", "next_ids")})

    def followers(self) -> DataFrame:
        """node_id, next_ids: what follows a node on any branch, sorted."""
        return self.nexts.groupBy(F.col("from_id").alias("node_id")).agg(F.array_sort(F.collect_set("to_id")).alias("next_ids"))

    def requirements(self) -> DataFrame:
        """node_id, required_id, action_phrase, rule_id, reason: what must come before a node."""
        return self.edges.filter("edge_type = 'REQUIRES'").select(F.col("to_id").alias("node_id"), F.col("from_id").alias("required_id"), "rule_id", "reason").join(self.nodes.select(F.col("node_id").alias("required_id"), "action_phrase"), "required_id")

    def required_before(self, node_id: str) -> DataFrame:
        self.node(node_id)
        return self.requirements().filter(F.col("node_id") == node_id)

    def branch_preferences(self) -> DataFrame:
        """recipe_id, point, choice, ...: every branch's choices, and with each its alternatives' number."""
        rows = self._preferences
        many = rows.groupBy("point").agg(F.count(F.lit(1)).alias("alternatives"))
        known = self.nexts.select("recipe_id").distinct()
        return rows.withColumn("recipe_id", F.explode("recipes")).join(known, "recipe_id", "left_semi").join(many, "point")

    def preferences(self, branch: str) -> DataFrame:
        """The choices of this branch, and with each its alternatives' number."""
        self._known(branch)
        return self.branch_preferences().filter(F.col("recipe_id") == branch).drop("recipe_id").orderBy("seq")

    def walk(self, branch: str) -> list[str]:
        """Nodes from the entry on, in order."""
        from stepweave.operators.graph import walk

        self._known(branch)
        mine = self.edges.filter(F.col("recipe_id") == branch)
        starts = self.entry_points().filter(F.col("recipe_id") == branch).select("recipe_id", F.col("node_id").alias("node"))
        return [r["node"] for r in walk(mine, starts).orderBy("hop", "node").collect()]

    def _known(self, branch: str) -> None:
        if self.nexts.filter(F.col("recipe_id") == branch).isEmpty():
            raise ValueError(f"unknown branch {branch}")
