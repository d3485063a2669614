"""Graph operators: components, order scopes, cycles and their breaking, walks.

Components and acyclicity run as rounds of joins over edge tables, cut in the shared folder (spark.checkpoint.dir), so
they hold for any size; enumerating or breaking cycles works scope by scope, and a scope is one branch's steps.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a branch or scope up to which one task walks it or breaks its cycles.
TASK_EDGES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A local one is set only where none is and the driver is
    the only executor; on a cluster it would be no shared one, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stepweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder: a lost executor costs a task, and all that reads it sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for undirected edges (a, b); nulls and loops add nothing but their node.

    Each round takes the least label among neighbours, then that label's label: distances halve, rounds are few.
    """
    known = edges.filter("a is not null and b is not null")
    both = cut(known.select("a", "b").union(known.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_n")).agg(F.min("component").alias("_near"))
        step = labels.join(near, F.col("node") == F.col("_n")).select("node", F.least("component", "_near").alias("_to"), F.col("component").alias("_was"))
        jump = labels.select(F.col("node").alias("_at"), F.col("component").alias("_next"))
        new = cut(step.join(jump, F.col("_to") == F.col("_at")).select("node", F.least("_to", "_next").alias("component"), "_was"))
        labels = new.select("node", "component")
        if new.filter("component <> _was").isEmpty():
            return labels


def branch_nodes(edges: DataFrame) -> DataFrame:
    """recipe_id, node for the nodes on each branch's NEXT edges."""
    nexts = edges.filter("edge_type = 'NEXT' and recipe_id is not null and recipe_id <> ''")
    return nexts.select("recipe_id", F.explode(F.array("from_id", "to_id")).alias("node")).distinct()


REQUIRED, LOOSE = "*requires*", "*no recipe*"


def order_scopes(edges: DataFrame) -> DataFrame:
    """Edges with the `scope` in which they must be acyclic together.

    All REQUIRES edges are one scope; NEXT edges without a branch another; each branch has its NEXT edges and the
    REQUIRES edges among its nodes.
    """
    requires = edges.filter("edge_type = 'REQUIRES'")
    nexts = edges.filter("edge_type = 'NEXT'")
    named = F.coalesce(F.col("recipe_id"), F.lit("")) != ""
    on = branch_nodes(edges)
    inside = requires.drop("recipe_id").join(on.withColumnRenamed("node", "from_id"), "from_id").join(on.withColumnRenamed("node", "to_id"), ["recipe_id", "to_id"])
    cols = edges.columns
    parts = [
        requires.withColumn("scope", F.lit(REQUIRED)),
        nexts.filter(~named).withColumn("scope", F.lit(LOOSE)),
        nexts.filter(named).withColumn("scope", F.col("recipe_id")),
        inside.withColumn("scope", F.col("recipe_id")).select(*cols, "scope"),
    ]
    out = parts[0].select(*cols, "scope")
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols, "scope"))
    return out


def peeled(edges) -> set:
    """Nodes of the edges (u, v) that peeling takes."""
    after, before = {}, {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)
        before.setdefault(v, set()).add(u)
    todo = [n for n in {*after, *before} if n not in before or n not in after]
    gone = set()
    while todo:
        n = todo.pop()
        if n in gone:
            continue
        gone.add(n)
        for near, back in ((after, before), (before, after)):
            for m in near.get(n, ()):
                back[m].discard(n)
                if not back[m]:
                    todo.append(m)
    return gone


def cyclic_core(edges: DataFrame, scope: str = "scope", a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Edges that peeling leaves: nodes that nothing leads to, or that lead nowhere, go with their edges until none is left.

    Acyclic scopes vanish. Scopes of up to TASK_EDGES edges are peeled in one task each, in a time by their edges; larger
    ones by rounds of joins, as many as their longest path outside cycles.
    """
    distinct = cut(edges.select(F.col(scope).alias("scope"), F.col(a).alias("from_id"), F.col(b).alias("to_id")).distinct())
    large = cut(distinct.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_EDGES).select("scope"))

    def peel(pdf):
        gone = peeled(zip(pdf["from_id"], pdf["to_id"], strict=True))
        return pdf[~(pdf["from_id"].isin(gone) | pdf["to_id"].isin(gone))]

    kinds = ", ".join(f"{c} {t}" for c, t in distinct.dtypes)
    small = distinct.join(large, "scope", "left_anti").groupBy("scope").applyInPandas(peel, kinds)
    if large.isEmpty():
        return cut(small)
    return cut(small.unionByName(_core_by_joins(cut(distinct.join(large, "scope", "left_semi").select("scope", "from_id", "to_id")))))


def _core_by_joins(left: DataFrame) -> DataFrame:
    n = left.count()
    while n:
        # edges whose start is entered, and whose end is left, by edges of the same kind
        starts = left.select("scope", F.col("to_id").alias("from_id")).distinct()
        ends = left.select("scope", F.col("from_id").alias("to_id")).distinct()
        kept = cut(left.join(starts, ["scope", "from_id"], "left_semi").join(ends, ["scope", "to_id"], "left_semi").select("scope", "from_id", "to_id"))
        before, n = n, kept.count()
        if before == n:
            break
        left = kept
    return left if n else left.filter(F.lit(False))


def cyclic_scopes(edges: DataFrame, **names) -> DataFrame:
    """scope, n_edges on or between cycles; empty if every scope is acyclic."""
    return cyclic_core(edges, **names).groupBy("scope").agg(F.count(F.lit(1)).alias("n_edges"))


def find_cycle(edges: list[tuple]) -> list[int]:
    """Positions of the edges of one cycle, [] if there is none; the same for the same edges in the same order."""
    after: dict = {}
    for i, (u, v) in enumerate(edges):
        after.setdefault(u, []).append((v, i))
    done: set = set()
    for start in after:
        if start in done:
            continue
        path, trail, on = [(start, iter(after[start]))], [], {start: 0}
        while path:
            node, rest = path[-1]
            step = next(rest, None)
            if step is None:
                path.pop()
                done.add(node)
                on.pop(node)
                if trail:
                    trail.pop()
                continue
            v, i = step
            if v in on:
                return [*trail[on[v] :], i]
            if v not in done:
                on[v] = len(path)
                path.append((v, iter(after.get(v, ()))))
                trail.append(i)
    return []


def cycle_cuts(edges: list[tuple]) -> list[int]:
    """Positions of the edges that go when of each cycle that find_cycle names the first edge does, until there is none.

    Nodes from which a search came back empty stay done, since taking edges away makes no cycle; what a search finds depends
    on the order of edges alone, so the cycles are those of a search from the beginning.
    """
    after: dict = {}
    for i, (u, v) in enumerate(edges):
        after.setdefault(u, []).append((i, v))
    done, gone = set(), []
    while found := _next_cycle(after, done):
        i = min(found)
        gone.append(i)
        u = edges[i][0]
        after[u].remove((i, edges[i][1]))
        if not after[u]:
            del after[u]
    return gone


def _next_cycle(after: dict, done: set) -> list[int]:
    for start in sorted((n for n in after if n not in done), key=lambda n: after[n][0][0]):
        if start in done:
            continue
        path, trail, on = [(start, iter(after[start]))], [], {start: 0}
        while path:
            node, rest = path[-1]
            i, v = next(rest, (None, None))
            if i is None:
                path.pop()
                done.add(node)
                on.pop(node)
                if trail:
                    trail.pop()
            elif v in on:
                return [*trail[on[v] :], i]
            elif v not in done:
                on[v] = len(path)
                path.append((v, iter(after.get(v, ()))))
                trail.append(i)
    return []


def simple_cycles(edges: list[tuple], most: int = 3) -> list[list]:
    """Up to `most` simple cycles as lists of nodes, each from its least node on.

    Every cycle is looked for from its least node, over greater nodes that lead back to it. A node from which the search
    came back empty stays closed until a node after it is on a found cycle, so the time for a cycle is at most linear.
    """
    after: dict = {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)
    out: list[list] = []
    for start in sorted(after):
        if len(out) >= most:
            break
        path, closed, waiting = [start], {start}, {}
        stack = [iter(sorted(v for v in after[start] if v >= start))]
        found = [False]
        while stack and len(out) < most:
            v = next(stack[-1], None)
            if v is None:
                stack.pop()
                node, hit = path.pop(), found.pop()
                if hit:
                    reopen = [node]
                    while reopen:
                        x = reopen.pop()
                        if x in closed:
                            closed.discard(x)
                            reopen += waiting.pop(x, ())
                    if found:
                        found[-1] = True
                else:
                    for x in after.get(node, ()):
                        if x >= start:
                            waiting.setdefault(x, set()).add(node)
            elif v == start:
                out.append(list(path))
                found[-1] = True
            elif v not in closed:
                path.append(v)
                closed.add(v)
                found.append(False)
                stack.append(iter(sorted(x for x in after.get(v, ()) if x >= start)))
    return out


def cycles(scopes: DataFrame, most: int = 3) -> DataFrame:
    """scope, cycle (nodes, the first again at the end): the first few of every scope. Only edges that peeling leaves are searched."""
    core = cyclic_core(scopes)

    def search(pdf):
        import pandas as pd

        found = simple_cycles(list(zip(pdf["from_id"], pdf["to_id"], strict=True)), most)
        return pd.DataFrame({"scope": [pdf["scope"].iloc[0]] * len(found), "cycle": [c + c[:1] for c in found]}, columns=["scope", "cycle"])

    return core.groupBy("scope").applyInPandas(search, "scope string, cycle array<string>")


def break_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that stay, edges removed) so that every order scope is acyclic.

    Of a cycle a NEXT edge goes before a REQUIRES edge, the lightest first, ties by branch and nodes. The scope of all
    REQUIRES edges is cleared first, since its edges are in the branches' scopes too; then branches, each by itself.
    Only what peeling leaves is gathered: by scope, and by connected part where a scope has more than TASK_EDGES such
    edges (a cycle never leaves its part, so that changes nothing). Branches of up to TASK_EDGES NEXT edges are cleared in the
    tasks that hold them, without a table of their REQUIRES edges, where those are as few.
    """
    edges = cut(edges.withColumn("_edge", F.monotonically_increasing_id()))
    removed = None
    for wanted in (F.col("scope") == REQUIRED, F.col("scope") != REQUIRED):
        left = edges if removed is None else edges.join(removed, "_edge", "left_anti")
        if removed is not None and (requires := few_requires(left)) is not None:
            nexts, left = by_branch(left, ["weight", "recipe_id", "_edge"])
            new = cut(nexts.filter(wanted).mapInArrow(each_scope(_cuts_of(requires), "_edge"), "_edge long").distinct())
            removed = cut(removed.union(new).distinct())
            if left is None:
                continue
        scopes = order_scopes(left).filter(wanted)
        core = cyclic_core(scopes).distinct()
        todo = scopes.join(core, ["scope", "from_id", "to_id"], "left_semi").select("scope", "_edge", "from_id", "to_id", "edge_type", "recipe_id", "weight")
        large = cut(todo.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_EDGES).select("scope"))
        todo = todo.withColumn("part", F.lit(0).cast("long"))
        if not large.isEmpty():
            spots = todo.join(large, "scope", "left_semi").select(F.xxhash64("scope", "from_id").alias("a"), F.xxhash64("scope", "to_id").alias("b"))
            parts = components(spots).select(F.col("node").alias("_spot"), F.col("component").alias("_part"))
            todo = todo.join(parts, F.xxhash64("scope", "from_id") == F.col("_spot"), "left").withColumn("part", F.coalesce("_part", F.col("part"))).drop("_spot", "_part")

        def drop(pdf):
            # rows are in the order of removal: NEXT sorts before REQUIRES
            pdf = pdf.sort_values(["edge_type", "weight", "recipe_id", "from_id", "to_id", "_edge"], na_position="first", ignore_index=True)
            return pdf.loc[cycle_cuts(list(zip(pdf["from_id"], pdf["to_id"], strict=True))), ["_edge"]]

        new = cut(todo.groupBy("scope", "part").applyInPandas(drop, "_edge long").distinct())
        removed = new if removed is None else cut(removed.union(new).distinct())
    kept = edges.join(removed, "_edge", "left_anti").drop("_edge")
    return kept, edges.join(removed, "_edge", "left_semi").drop("_edge")


def few_requires(edges: DataFrame) -> list | None:
    """The REQUIRES edges, in the order in which they go from a cycle; None where they are more than TASK_EDGES."""
    ends = edges.filter("edge_type = 'REQUIRES' and from_id is not null and to_id is not null")
    rows = ends.select("from_id", "to_id", *[c for c in ("weight", "_edge") if c in edges.columns]).limit(TASK_EDGES + 1).collect()
    if len(rows) > TASK_EDGES:
        return None
    return sorted(rows, key=lambda r: (_nulls_first(r["weight"]), r["from_id"], r["to_id"], r["_edge"] if "_edge" in r else 0))


def _nulls_first(x) -> tuple:
    return (0,) if x is None or x != x else (1, x)


def by_branch(edges: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(scope, named, from_id, to_id, columns) of the NEXT edges of branches of up to TASK_EDGES, each branch in a row in one
    task; and the edges of larger branches with all REQUIRES edges, None if there is no such branch."""
    named = F.coalesce(F.col("recipe_id"), F.lit("")) != ""
    scoped = edges.withColumn("scope", F.when(named, F.col("recipe_id")).otherwise(F.lit(LOOSE))).withColumn("named", named)
    nexts = scoped.filter("edge_type = 'NEXT'")
    large = cut(nexts.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_EDGES).select("scope"))
    few = nexts.filter("from_id is not null and to_id is not null").select("scope", "named", "from_id", "to_id", *columns)
    few = few.join(large, "scope", "left_anti").repartition("scope").sortWithinPartitions("scope")
    if large.isEmpty():
        return few, None
    return few, scoped.filter("edge_type = 'REQUIRES'").unionByName(nexts.join(large, "scope", "left_semi")).select(edges.columns)


def each_scope(run: Callable[[str, list], Iterator], *names: str) -> Callable[[Iterator], Iterator]:
    """For mapInArrow over rows of by_branch: the rows (tuples of names) that run(scope, rows) gives for each scope."""

    def scopes(batches: Iterator) -> Iterator:
        scope, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != scope:
                    yield scope, held
                    held = []
                scope = row[0]
                held.append(row[1:])
        if held:
            yield scope, held

    def out(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"_edge": pa.int64(), "scope": pa.string(), "cycle": pa.list_(pa.string())}
        for scope, rows in scopes(batches):
            if found := list(run(scope, rows)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*found, strict=True), strict=True)], names=list(names))

    return out


def _inside(requires: list) -> Callable[[set], list]:
    """A function that gives the REQUIRES edges (rows that begin with both ends) among nodes, in their order."""
    after: dict = {}
    for i, r in enumerate(requires):
        after.setdefault(r[0], []).append((i, r[1]))
    return lambda nodes: [requires[i] for i in sorted(i for u in nodes for i, v in after.get(u, ()) if v in nodes)]


def _cuts_of(requires: list) -> Callable[[str, list], Iterator]:
    """The edges that go from a branch."""
    inside = _inside([(r["from_id"], r["to_id"], r["_edge"]) for r in requires])

    def run(scope: str, rows: list) -> Iterator:
        rows = sorted(rows, key=lambda r: (_nulls_first(r[3]), _nulls_first(r[4]), r[1], r[2], r[5]))
        edges = [(u, v, edge) for _, u, v, _, _, edge in rows] + inside({n for named, u, v, *_ in rows if named for n in (u, v)})
        gone = peeled((u, v) for u, v, _ in edges)
        core = [e for e in edges if e[0] not in gone and e[1] not in gone]
        yield from ((core[i][2],) for i in cycle_cuts([e[:2] for e in core]))

    return run


def cycles_after_merge(nexts: DataFrame, requires: list, mapping: dict, most: int = 3) -> DataFrame:
    """scope, cycle: the first few of each scope whose edges have a cycle once nodes are mapped and loops dropped; nexts as of
    by_branch, requires as of few_requires."""

    def moved(pairs):
        ends = {(mapping.get(u, u), mapping.get(v, v)) for u, v in pairs}
        return {(u, v) for u, v in ends if u != v}

    everything = sorted(moved((r["from_id"], r["to_id"]) for r in requires))
    inside = _inside(everything)

    def found(scope: str, edges: list) -> Iterator:
        gone = peeled(edges)
        core = [e for e in edges if e[0] not in gone and e[1] not in gone]
        return ((scope, c + c[:1]) for c in (simple_cycles(core, most) if core else ()))

    def run(scope: str, rows: list) -> Iterator:
        loose, own = (moved((u, v) for named, u, v in rows if named is is_named) for is_named in (False, True))
        return found(scope, [*loose, *own, *inside({n for e in own for n in e})])

    kinds = "scope string, cycle array<string>"
    first = nexts.sparkSession.createDataFrame(list(found(REQUIRED, everything)), kinds)
    return first.union(nexts.mapInArrow(each_scope(run, "scope", "cycle"), kinds))


def walk(edges: DataFrame, starts: DataFrame, branch: str = "recipe_id", most: int | None = None) -> DataFrame:
    """branch, node, hop along NEXT edges from each branch's starts; hop is the least number of edges from a start.

    Branches of up to TASK_EDGES edges are walked in one task each; larger ones by joins, where chains (nodes with one
    edge in and one out) are first shortened by pointer jumps, so that a long chain takes rounds by its logarithm. With
    `most`, a walk of more hops is an error.
    """
    nexts = cut(edges.filter("edge_type = 'NEXT'").select(branch, "from_id", "to_id").distinct())
    begin = cut(starts.select(branch, "node").distinct())
    sizes = nexts.groupBy(branch).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > TASK_EDGES).select(branch))
    few, begun = nexts.join(large, branch, "left_anti"), begin.join(large, branch, "left_anti")
    kinds = dict(nexts.dtypes)

    def search(pdf):
        import pandas as pd

        own = pdf[branch].iloc[0]
        after: dict = {}
        for u, v in zip(pdf["from_id"], pdf["to_id"], strict=True):
            if u is not None:
                after.setdefault(u, []).append(v)
        front = list(dict.fromkeys(v for u, v in zip(pdf["from_id"], pdf["to_id"], strict=True) if u is None))
        hops, hop = dict.fromkeys(front, 0), 0
        while front:
            hop += 1
            front = list(dict.fromkeys(v for u in front for v in after.get(u, ()) if v not in hops))
            hops.update(dict.fromkeys(front, hop))
        return pd.DataFrame({branch: [own] * len(hops), "node": list(hops), "hop": list(hops.values())}, columns=[branch, "node", "hop"])

    rows = few.unionByName(begun.select(branch, F.lit(None).cast(kinds["from_id"]).alias("from_id"), F.col("node").cast(kinds["to_id"]).alias("to_id")))
    out = rows.groupBy(branch).applyInPandas(search, f"{branch} {kinds[branch]}, node {kinds['to_id']}, hop int")
    if not large.isEmpty():
        out = out.unionByName(_walk_by_joins(nexts.join(large, branch, "left_semi"), begin.join(large, branch, "left_semi"), branch))
    if most is not None:
        out = cut(out)
        if not out.filter(F.col("hop") > most).isEmpty():
            raise ValueError(f"a walk has more than {most} hops")
    return out


def _walk_by_joins(nexts: DataFrame, starts: DataFrame, branch: str) -> DataFrame:
    """Like walk, by rounds of joins: inner nodes of chains get their distance from the chain's head, heads theirs from the
    starts over edges that stand for whole chains."""
    at = [branch, "node"]
    into = nexts.groupBy(branch, F.col("to_id").alias("node")).agg(F.count(F.lit(1)).alias("_in"), F.first("from_id").alias("head"))
    outof = nexts.groupBy(branch, F.col("from_id").alias("node")).agg(F.count(F.lit(1)).alias("_out"))
    inner = into.filter("_in = 1").join(outof.filter("_out = 1"), at).join(starts, at, "left_anti")
    chain = cut(inner.select(*at, "head", F.lit(1).cast("long").alias("d")))
    n, bound = chain.count(), 1
    while bound <= n:  # a ring of inner nodes has no head and is never reached: jumps end by their number
        up = chain.select(branch, F.col("node").alias("head"), F.col("head").alias("_head"), F.col("d").alias("_d"))
        chain = cut(chain.join(up, [branch, "head"], "left").select(*at, F.coalesce("_head", "head").alias("head"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.col("_head").isNotNull().alias("_moved")))
        moved = not chain.filter("_moved").isEmpty()
        chain, bound = chain.drop("_moved"), 2 * bound
        if not moved:
            break
    long = nexts.withColumnRenamed("from_id", "node").join(chain, at, "left").select(branch, F.coalesce("head", "node").alias("from_id"), "to_id", F.coalesce(F.col("d") + 1, F.lit(1)).alias("d"))
    long = cut(long.join(chain.select(branch, F.col("node").alias("to_id")), [branch, "to_id"], "left_anti"))
    known = front = cut(starts.withColumn("hop", F.lit(0).cast("long")))
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "from_id").join(long, [branch, "from_id"]).groupBy(branch, F.col("to_id").alias("node")).agg(F.min(F.col("hop") + F.col("d")).alias("hop"))
        better = cut(step.join(known.withColumnRenamed("hop", "_hop"), at, "left").filter("_hop is null or hop < _hop").select(*at, "hop"))
        known, front = cut(known.join(better, at, "left_anti").unionByName(better)), better
    inside = chain.join(known.withColumnRenamed("node", "head"), [branch, "head"]).select(*at, (F.col("hop") + F.col("d")).alias("hop"))
    return known.unionByName(inside).withColumn("hop", F.col("hop").cast("int"))


def empty_edges(spark: SparkSession) -> DataFrame:
    from stepweave.sources.schema import EDGE

    return spark.createDataFrame([], EDGE)
