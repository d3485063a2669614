"""Graph operators on hand-made graphs: components, cycles, breaking, merging, walks, queries."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stepweave.functions.nested import CONDITIONS
from stepweave.operators import fuse, gates, graph, merge
from stepweave.operators.dims import Dims
from stepweave.plans import build
from stepweave.plans.query_api import GraphQuery
from stepweave.sources import schema

DIMS = Dims(
    aliases={"eggs": "egg"}, ingredients=("egg", "salt"), utensils=("bowl", "pan", "plate"), known_out=("milk",), goal_entity="egg", goal_labels=("solid",), goal_location="plate", goal_action="serve eggs", default_entity="egg",
    bounds=((0, "onset", "Onset", 62.0, "d", None, "egg", "alert"), (1, "smoke", "Smoke", 150.0, "d", None, "butter", "alert")),
    classes={"crack eggs": "crack", "mix eggs": "mix", "season eggs": "season", "cook eggs": "cook"}, rules=((0, "crack_first", ["crack"], ["mix"], "out of the shell", None, None, None, True), (1, "mix_first", ["mix"], ["cook"], "beaten", None, None, None, True)), definition_version="1",
)


def edges_of(spark, rows):
    """rows: (from, to, type, branch, weight)."""
    return fuse.as_edges(spark.createDataFrame(rows, "from_id string, to_id string, edge_type string, recipe_id string, weight double"))


def actions_of(spark, rows):
    """rows: (branch, step, type, phrase, before, after)."""
    full = [(r, s, 1, t, p, [("eggs", a, a)] if a else [], [("egg", z, z)] if z else [], None, ["egg"], ["bowl"], "span", True, None, 0.8 + s / 10, "m", "accept") for r, s, t, p, a, z in rows]
    return spark.createDataFrame(full, schema.ACTION + ", verdict string")


def test_components_against_plain_search(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_cycles_by_scope(spark):
    e = edges_of(spark, [("a", "b", "NEXT", "r1", 1.0), ("b", "c", "NEXT", "r1", 1.0), ("c", "a", "NEXT", "r1", 1.0), ("b", "a", "NEXT", "r2", 1.0), ("a", "c", "NEXT", "r2", 1.0), ("x", "y", "REQUIRES", None, 1.0), ("y", "x", "REQUIRES", None, 1.0), ("p", "q", "NEXT", None, 1.0)])
    assert {r.scope for r in graph.cyclic_scopes(graph.order_scopes(e)).collect()} == {"r1", "*requires*"}
    assert {(r.scope, tuple(r.cycle)) for r in graph.cycles(graph.order_scopes(e)).collect()} == {("r1", ("a", "b", "c", "a")), ("*requires*", ("x", "y", "x"))}
    assert {r.subject for r in gates.gate2(e).collect()} == {"r1", "*requires*"}


def test_branches_may_order_a_step_differently(spark):
    e = edges_of(spark, [("a", "b", "NEXT", "r1", 1.0), ("b", "a", "NEXT", "r2", 1.0)])
    kept, removed = graph.break_cycles(e)
    assert kept.count() == 2 and removed.isEmpty()


def test_breaking_takes_next_before_requires_and_light_before_heavy(spark):
    e = edges_of(spark, [("a", "b", "REQUIRES", "r1", 0.1), ("b", "c", "NEXT", "r1", 2.0), ("c", "a", "NEXT", "r1", 1.0), ("a", "b", "NEXT", "r1", 3.0), ("x", "y", "REQUIRES", "r1", 1.0), ("y", "x", "REQUIRES", "r1", 0.5), ("s", "s", "NEXT", "r2", 1.0)])
    kept, removed = graph.break_cycles(e)
    assert {(r.from_id, r.to_id, r.edge_type) for r in removed.collect()} == {("c", "a", "NEXT"), ("y", "x", "REQUIRES"), ("s", "s", "NEXT")}
    assert graph.cyclic_scopes(graph.order_scopes(kept)).isEmpty()


def test_breaking_random_graphs(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["NEXT", "NEXT", "REQUIRES"]), f"r{rng.randrange(4)}", float(rng.randrange(1, 4))) for _ in range(120)]
    kept, removed = graph.break_cycles(edges_of(spark, sorted(set(rows))))
    assert graph.cyclic_scopes(graph.order_scopes(kept)).isEmpty()
    assert kept.count() + removed.count() == len(set(rows)) and kept.count() > 30


RECIPES = [
    ("r1", 1, "Process", "crack eggs", "liquid", "liquid"), ("r1", 2, "Process", "Mix  eggs", "liquid", "liquid"), ("r1", 3, "Process", "season eggs", "liquid", "liquid"), ("r1", 4, "Process", "cook eggs", "liquid", "solid"),
    ("r2", 1, "Process", "crack eggs", "liquid", "liquid"), ("r2", 2, "Process", "season eggs", "liquid", "liquid"), ("r2", 3, "Process", "mix eggs", "liquid", "liquid"), ("r2", 4, "Process", "cook eggs", "liquid", "solid"), ("r2", 5, "Plate", "serve eggs", "solid", "solid"),
]


@pytest.fixture(scope="module")
def fused(spark):
    from stepweave.operators import scope

    actions, report = scope.complete_to_goal(actions_of(spark, RECIPES), DIMS)
    assert [tuple(r) for r in report.collect()] == [("r1", "solid", 5, True)]
    return build.fuse_graph(actions, replace(DIMS, classes={**DIMS.classes, "serve eggs": "plate"}))


def test_fusing(fused):
    nodes = {r.action_phrase.lower().replace("  ", " "): r for r in fused.nodes.collect()}
    assert len(nodes) == 5 and {n.n_recipes for n in nodes.values()} == {2} and nodes["mix eggs"].n_observations == 2
    assert nodes["mix eggs"].mean_confidence == pytest.approx((1.0 + 1.1) / 2)
    ids = {k: n.node_id for k, n in nodes.items()}
    by = lambda kind: {(r.from_id, r.to_id, r.recipe_id) for r in fused.edges.filter(F.col("edge_type") == kind).collect()}
    order = lambda r, *names: {(ids[a], ids[b], r) for a, b in zip(names, names[1:], strict=False)}
    assert by("NEXT") == order("r1", "crack eggs", "mix eggs", "season eggs", "cook eggs", "serve eggs") | order("r2", "crack eggs", "season eggs", "mix eggs", "cook eggs", "serve eggs")
    assert {e[:2] for e in by("REQUIRES")} == {(ids["crack eggs"], ids["mix eggs"]), (ids["mix eggs"], ids["cook eggs"])}
    assert by("HAS_SAFETY_BOUND") == {(ids["cook eggs"], "bound_onset", None)}
    assert fused.violations.isEmpty() and fused.unclassified.isEmpty() and fused.removed_edges.isEmpty()
    assert fused.provenance.count() == 10


def test_gates_pass_and_fail(spark, fused):
    steps = spark.createDataFrame([("r1", 1, "a span here"), ("r2", 1, "nothing")], schema.STEP)
    ok, errors = build.validate(fused, steps, DIMS)
    assert not ok
    assert {(r.gate, r.message.split(":")[0]) for r in errors.collect()} == {(6, "source span not found in r2 step 1")}
    none = F.array().cast(CONDITIONS)
    assert gates.gate3(fused.nodes.withColumn("post", none)).count() == 4
    assert gates.gate4(fused.nodes, fused.edges).isEmpty()
    assert gates.gate4(fused.nodes, fused.edges.filter("edge_type = 'NEXT'")).count() == 1


def test_queries(fused):
    q = GraphQuery(fused.nodes, fused.edges)
    assert q.branches() == ["r1", "r2"]
    start = q.entry_nodes("r1")
    assert start == q.entry_nodes("r2") and q.node(start[0]).action_phrase == "crack eggs"
    assert [q.node(n).action_phrase.lower().split()[0] for n in q.walk("r2")] == ["crack", "season", "mix", "cook", "serve"]
    assert len(q.next_node_ids(start[0])) == 2 and len(q.next_node_ids(start[0], "r1")) == 1
    step = q.step("r1", q.walk("r1")[3])
    assert step.action_phrase == "cook eggs" and step.bounds == ["onset"] and len(step.next_ids) == 1
    assert {r.rule_id for r in q.required_before(step.node_id).collect()} == {"mix_first"}
    with pytest.raises(KeyError):
        q.node("absent")
    with pytest.raises(ValueError, match="unknown branch"):
        q.step("r9", start[0])


def labels_of(spark, rows):
    return spark.createDataFrame([("__".join(sorted((a, b))), a, b, label) for a, b, label in rows], "pair_id string, a_id string, b_id string, label string")


def graph_of(spark, rows, phrases):
    """Nodes named by rows' ids, all of one block but for ids that start with z."""
    nodes = spark.createDataFrame([(i, "Transfer" if i.startswith("z") else "Process", p, n) for i, (p, n) in phrases.items()], "node_id string, node_type string, action_phrase string, n_recipes int")
    state = F.array(F.struct(F.lit("egg").alias("entity_id"), F.lit("x").alias("physics_state"), F.lit("solid").alias("k2_label"))).cast(CONDITIONS)
    nodes = nodes.withColumns({"pre": state, "post": state, "canonical_action": F.col("action_phrase"), "ingredients": F.array(F.col("node_id")), "tools": F.array(F.lit("bowl")), "seq": F.lit(1).cast("long"), "n_observations": F.lit(2).cast("long"), "mean_confidence": F.lit(0.5)})
    return nodes, edges_of(spark, rows)


def test_merging(spark):
    rows = [("a", "b", "NEXT", "r1", 1.0), ("b", "c", "NEXT", "r1", 1.0), ("c", "d", "NEXT", "r2", 1.0), ("a", "d", "NEXT", "r2", 1.0), ("z1", "a", "NEXT", "r1", 1.0)]
    nodes, edges = graph_of(spark, rows, {"a": ("add the salt", 1), "b": ("salt", 3), "c": ("cook", 1), "d": ("cook it", 1), "e": ("e", 1), "f": ("f", 1), "g": ("g", 1), "z1": ("z", 1)})
    labels = labels_of(spark, [("a", "b", "same"), ("e", "f", "same"), ("f", "g", "same"), ("e", "g", "different"), ("d", "z1", "same"), ("c", "gone", "same")])
    mapping, merged, report = merge.apply_merges(nodes, edges, labels)
    assert {(r.node, r.representative) for r in mapping.collect()} == {("a", "b"), ("b", "b")}
    assert {(r.from_id, r.to_id, r.recipe_id) for r in merged.collect()} == {("b", "c", "r1"), ("c", "d", "r2"), ("b", "d", "r2"), ("z1", "b", "r1")}
    why = {tuple(r["nodes"]): r["reason"] for r in report}
    assert why["a", "b"] is None and why["e", "f", "g"].startswith("not transitive") and why["d", "z1"].startswith("members differ")
    one = {r.node_id: r for r in merge.contract(nodes, mapping).collect()}
    assert len(one) == 7 and one["b"].action_phrase == "salt" and one["b"].variant_phrases == ["add the salt"]
    assert one["b"].ingredients == ["b", "a"] and one["b"].n_observations == 4 and one["b"].tools == ["bowl"]
    assert {c["kind"] for c in merge.conflicts(nodes, edges, labels)} == {"not_transitive"}
    assert {r.pair_id for r in merge.stale_labels(labels, nodes).collect()} == {"c__gone"}


def test_a_merge_that_closes_a_loop_is_skipped(spark):
    rows = [("x", "y", "NEXT", "r1", 1.0), ("y", "w", "NEXT", "r1", 1.0)]
    nodes, edges = graph_of(spark, rows, {"x": ("x", 1), "y": ("y", 1), "w": ("w", 1)})
    labels = labels_of(spark, [("x", "w", "same")])
    mapping, merged, report = merge.apply_merges(nodes, edges, labels)
    assert mapping.isEmpty() and merged.count() == 2 and report[0]["reason"].startswith("order cycle")
    assert [c["kind"] for c in merge.conflicts(nodes, edges, labels)] == ["order_cycle"]


def test_two_branches_in_opposite_order_merge(spark):
    rows = [("a1", "b1", "NEXT", "r1", 1.0), ("b2", "a2", "NEXT", "r2", 1.0)]
    nodes, edges = graph_of(spark, rows, {k: (k, 1) for k in ("a1", "b1", "a2", "b2")})
    mapping, merged, _ = merge.apply_merges(nodes, edges, labels_of(spark, [("a1", "a2", "same"), ("b1", "b2", "same")]))
    assert mapping.count() == 4 and merged.count() == 2


def test_review_queue(spark):
    nodes, _ = graph_of(spark, [("a", "b", "NEXT", "r1", 1.0)], {"a": ("a", 1), "b": ("b", 1), "z1": ("z", 1)})
    pairs = merge.candidate_pairs(merge.with_block(nodes))
    labels = labels_of(spark, [("a", "z1", "different"), ("b", "a", "same")]).withColumn("added_by_hand", F.lit(True))
    assert [(r.a, r.b) for r in merge.review_queue(pairs, labels).collect()] == [("a", "b"), ("a", "z1")]


def test_rules_are_checked(spark):
    bad = replace(
        DIMS, preferences=((0, "p", "odd", "c", ["r9"], None, "r1", 1, "not there", False),),
        rules=((0, "one", ["crack"], ["mix"], "", None, None, None, True), (1, "two", ["mix"], ["crack"], "x", "r1", 7, "q", False), (2, "three", ["nowhere"], ["mix"], "x", None, None, None, True)),
    )
    steps = spark.createDataFrame([("r1", 1, "text")], schema.STEP)
    got = {(r.subject, r.message) for r in gates.check_rules(bad, spark, steps).collect()}
    assert got == {("one", "no reason"), ("three", "unknown class nowhere"), ("order rules", "form a cycle: crack -> mix -> crack"), ("p", "kind must be structural or parametric"), ("p", "needs at least two alternatives"), ("p", "unknown branch r9"), ("preference p / c", "quote not found"), ("rule two", "no step 7")}
    overlap = spark.createDataFrame([("Mix  eggs", "a"), ("mix eggs", "b"), ("x", "a")], "phrase string, cls string")
    assert [tuple(r) for r in gates.class_overlaps(overlap).collect()] == [("mix eggs", ["a", "b"])]


def test_walk_is_whole(spark):
    import inspect

    import pytest

    from stepweave.operators.graph import walk

    edges = spark.createDataFrame([("b", f"n{i}", f"n{i + 1}", "NEXT") for i in range(5)], "recipe_id string, from_id string, to_id string, edge_type string")
    starts = spark.createDataFrame([("b", "n0")], "recipe_id string, node string")
    assert {(r.node, r.hop) for r in walk(edges, starts, most=5).collect()} == {(f"n{i}", i) for i in range(6)}
    with pytest.raises(ValueError, match="more than 4 hops"):
        walk(edges, starts, most=4)
    assert inspect.signature(walk).parameters["most"].default is None


@pytest.mark.parametrize("most", [0, 1 << 16], ids=["joins", "tasks"])
def test_walks_of_any_length(spark, monkeypatch, most):
    """A chain of 5,000 nodes, a ring, a branching part, an unreached ring: in tasks and by joins."""
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    rng = random.Random(5)
    chain = [("long", f"n{i}", f"n{i + 1}") for i in range(5000)]
    ring = [("ring", f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("ring", "x", "y"), ("ring", "y", "x")]
    web = [("web", f"w{rng.randrange(60)}", f"w{rng.randrange(60)}") for _ in range(110)] + [("web", "w0", "t0"), *(("web", f"t{i}", f"t{i + 1}") for i in range(90)), ("web", "t90", "w1")]
    edges = spark.createDataFrame([(r, u, v, "NEXT") for r, u, v in chain + ring + web], "recipe_id string, from_id string, to_id string, edge_type string")
    starts = spark.createDataFrame([("long", "n0"), ("ring", "r3"), ("web", "w0"), ("alone", "z")], "recipe_id string, node string")
    want = {("alone", "z", 0)}
    for branch, rows, first in (("long", chain, "n0"), ("ring", ring, "r3"), ("web", web, "w0")):
        after, hops, front = {}, {first: 0}, [first]
        for _, u, v in rows:
            after.setdefault(u, []).append(v)
        while front:
            front = [v for u in front for v in after.get(u, ()) if v not in hops and not hops.update({v: hops[u] + 1})]
        want |= {(branch, n, h) for n, h in hops.items()}
    assert {tuple(r) for r in graph.walk(edges, starts).select("recipe_id", "node", "hop").collect()} == want


@pytest.mark.parametrize("most", [0, 1 << 16], ids=["joins", "tasks"])
def test_peeling_and_breaking_by_tasks_and_joins(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    rng = random.Random(11)
    rows = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice(["NEXT", "NEXT", "REQUIRES"]), f"r{rng.randrange(6)}", float(rng.randrange(1, 4))) for _ in range(160)})
    kept, removed = graph.break_cycles(edges_of(spark, rows))
    assert graph.cyclic_scopes(graph.order_scopes(kept)).isEmpty() and kept.count() + removed.count() == len(rows)
    test_peeling_and_breaking_by_tasks_and_joins.found.add(frozenset((r.from_id, r.to_id, r.edge_type, r.recipe_id) for r in removed.collect()))
    assert len(test_peeling_and_breaking_by_tasks_and_joins.found) == 1


test_peeling_and_breaking_by_tasks_and_joins.found = set()


def test_simple_cycles_end_soon():
    """Layers that all lead on, and none back but one: paths are many, cycles few."""
    layers = [(f"a{i:02d}{x}", f"a{i + 1:02d}{y}") for i in range(40) for x in "pq" for y in "pq"]
    assert graph.simple_cycles(layers) == []
    assert graph.simple_cycles([*layers, ("a40p", "a39q")]) == [["a39q", "a40p"]]
    assert len(graph.simple_cycles([*layers, ("a40p", "a00p")])) == 3
    rng = random.Random(2)
    for _ in range(200):
        edges = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 14))})
        after = {u: {v for a, v in edges if a == u} for u, _ in edges}

        def paths(start, path):
            for v in after.get(path[-1], ()):
                if v == start:
                    yield tuple(path)
                elif v > start and v not in path:
                    yield from paths(start, [*path, v])

        want = {p for s in after for p in paths(s, [s])}
        assert {tuple(c) for c in graph.simple_cycles(edges, 1000)} == want


def test_orders_across_ranges(spark):
    """Neighbours and segments where a branch and a node span several ranges of the order."""
    n = 7000
    rows = spark.range(n).select(F.lit("r").alias("recipe_id"), F.col("id").cast("int").alias("step_number"), F.lit(1).alias("sub_step"), (F.col("id") % 3).cast("string").alias("node_id"))
    placed = fuse.with_seq(rows.repartition(5))
    assert placed.select(F.shiftright("seq", fuse.RANGE_BITS)).distinct().count() > 1
    near = fuse.neighbours(placed, ["step_number"]).select("step_number", F.col("_near.step_number").alias("then")).collect()
    assert {(r.step_number, r.then) for r in near} == {(i, i + 1 if i + 1 < n else None) for i in range(n)}
    seen = placed.withColumns({c: F.lit("x") for c in ("source_span", "extractor_model", "verdict")}).withColumn("confidence", F.lit(1.0))
    got = sorted((r.node_id, r.segment, [p.step_number for p in r.provenance]) for r in fuse.nested_provenance(seen).collect())
    for k in range(3):
        mine = [i for i in range(n) if i % 3 == k]
        assert [g[2] for g in got if g[0] == str(k)] == [mine[a : a + fuse.SEGMENT] for a in range(0, len(mine), fuse.SEGMENT)]


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        graph.shared_dir(Session)


def test_gate_request_and_errors():
    from stepweave.operators import verify

    asked = verify.request("text", {"action_phrase": "a"}, "hint")
    assert set(asked["questions"]) == {*verify.QUESTIONS, "verdict"} and asked["revision_hint"] == "hint"
    assert {asked["questions"][q]["type"] for q in verify.QUESTIONS} == {"noul"}
    assert all(verify.is_retryable(RuntimeError(m)) for m in ("502", "Error 529", "model not found", "x is not a valid model", "Rate limit")) and not verify.is_retryable(ValueError("bad key"))
    assert verify.is_retryable(type("NotFoundError", (Exception,), {})("gone"))
    with pytest.raises(ValueError):
        verify.score_map({q: {"noul": 0.9} for q in verify.QUESTIONS} | {"verdict": {"choice": "maybe"}})


def test_containing_against_plain_search(spark):
    from stepweave.operators import contain

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "a  b"), (503, "x\ny z")]
    passages = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(60)] + [(100 + i, t[rng.randrange(len(t) + 1) :][: rng.randrange(60)]) for i, t in docs[:90]] + [(900, None), (901, ""), (902, " "), (903, "y z")]
    passages += [(2000 + i, "ab") for i in range(1200)]  # many short ones
    got = contain.containing(spark.createDataFrame(passages, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"))
    assert {tuple(r) for r in got.select("item_id", "doc_id").collect()} == {(i, j) for i, p in passages for j, t in docs if p is not None and t is not None and p in t}
    none = spark.createDataFrame([], "item_id int, text string")
    assert contain.containing(none, spark.createDataFrame(docs, "doc_id int, text string")).collect() == []


def test_mentioned_terms(spark):
    from stepweave.operators import contain

    docs = spark.createDataFrame([(1, "Add the Sea Salt, and eggs"), (2, "seasalt"), (3, None), (4, "an egg-white; SEA  salt"), (5, "für Öl")], "doc_id int, text string")
    terms = spark.createDataFrame([("sea salt",), ("Egg",), ("eggs",), ("",), ("egg-white",), ("öl",), ("the",)], "term string")
    assert {tuple(r) for r in contain.mentioned_terms(docs, terms).collect()} == {(1, "sea salt"), (1, "eggs"), (1, "the"), (4, "egg"), (4, "egg-white"), (5, "öl")}


def test_queue_of_blocks_is_the_queue_of_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(merge, "PART", 3)
    rows = [(f"b{i % 5}" if i % 9 else "b0", f"n{i:02d}") for i in range(40)] + [("b0", "n00"), (None, "n90"), ("alone", "n91")]
    labels = spark.createDataFrame([("n00__n09", "n09", "n00", True), ("n00__n01", "n01", "n00", True), ("n00__n01", "n00", "n01", True), ("n02__n03", "n02", "n03", False), ("n01__zz", "zz", "n01", True)], "pair_id string, a_id string, b_id string, added_by_hand boolean")
    for extra in ([], [("b1", "n00"), ("b1", "n05")]):  # nodes of two blocks too
        blocked = spark.createDataFrame(rows + extra, "block string, node_id string")
        pairs = merge.candidate_pairs(blocked)
        want = [(r.block_size, r.a, r.b, r.pair_id) for r in merge.review_queue(pairs, labels).collect()]
        queue = merge.block_queue(blocked, labels)
        got = [(r.block_size, r.a, r.b, r.pair_id) for r in queue.collect()]
        assert got == want
    queue = merge.block_queue(spark.createDataFrame(rows, "block string, node_id string"), labels)
    assert "Window" not in queue._jdf.queryExecution().executedPlan().toString()  # pairs aren't shuffled to be numbered


def test_cuts_are_those_of_searches_from_the_beginning():
    rng = random.Random(12)
    for _ in range(300):
        edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(40))]
        left, want = list(range(len(edges))), []
        while found := graph.find_cycle([edges[i] for i in left]):
            want.append(left.pop(min(found)))
        assert graph.cycle_cuts(edges) == want


def test_breaking_makes_no_table_of_the_branches_required_edges(spark, monkeypatch):
    """Each branch has 20 nodes between which there are 100 REQUIRES edges: they aren't written once a branch."""
    requires = [(f"n{i}", f"n{j}", "REQUIRES", "r0", 1.0) for i in range(10) for j in range(10, 20)]
    nexts = [(f"n{(i * k) % 21 % 20}", f"n{(i * k + k) % 21 % 20}", "NEXT", f"r{k}", 1.0 + i % 3) for k in range(1, 21) for i in range(21)]
    rows, written, cut = sorted(set(requires + nexts)), [], graph.cut
    want = [{(r.from_id, r.to_id, r.edge_type, r.recipe_id) for r in x.collect()} for x in graph.break_cycles(edges_of(spark, rows))]

    def noted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", noted)
    graph.break_cycles(edges_of(spark, rows))
    assert max(written) <= len(rows)
    monkeypatch.setattr(graph, "TASK_EDGES", 0)  # by joins
    assert want[1] and [{(r.from_id, r.to_id, r.edge_type, r.recipe_id) for r in x.collect()} for x in graph.break_cycles(edges_of(spark, rows))] == want


def test_merges_are_tried_in_branches_as_by_joins(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(24)]
    state = "array<struct<entity_id:string,physics_state:string,k2_label:string>>"
    nodes = spark.createDataFrame([(n, "Process", f"do {n}", 1 + i % 3) for i, n in enumerate(names)], "node_id string, node_type string, action_phrase string, n_recipes int").selectExpr("*", f"cast(array() as {state}) pre", f"cast(array() as {state}) post")
    rows = {(u, v, kind, branch if kind == "NEXT" else None, 1.0) for u, v, kind, branch in ((*sorted(rng.sample(names, 2)), rng.choice(["NEXT", "NEXT", "REQUIRES"]), rng.choice(["r1", "r2", "r3", None])) for _ in range(45))}
    labels = labels_of(spark, [(names[i], names[i + 12], "same") for i in range(12)])
    e = edges_of(spark, sorted(rows, key=str))
    results = []
    joins = []
    order_scopes = merge.order_scopes
    monkeypatch.setattr(merge, "order_scopes", lambda edges: joins.append(1) or order_scopes(edges))
    for most in (1 << 16, 0):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        mapping, merged, report = merge.apply_merges(nodes, e, labels)
        results.append((sorted(map(tuple, mapping.collect())), sorted(map(str, merged.collect())), [(r["nodes"], r["reason"]) for r in report]))
        assert bool(joins) == (most == 0)  # no table of scopes where branches are small
    assert results[0] == results[1]
    assert {bool(reason) for _, reason in results[0][2]} == {True, False}
