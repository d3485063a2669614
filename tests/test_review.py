"""Scope, verification, review, metrics, pages, sinks and streaming on small cases."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stepweave.operators import gates, review, scope, verify
from stepweave.operators.dims import Dims, from_documents
from stepweave.plans import build, metrics
from stepweave.sources import html, readers, schema, sinks
from stepweave.streaming import timer
from test_graph import DIMS, actions_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

EXPECTED = {"node_type": "Process", "action_phrase": "cook eggs", "pre_conditions": [("egg", "liquid")], "post_conditions": [("egg", "solid")], "tools": ["pan"], "has_safety_bound": True, "in_scope": True}


def expected(**more):
    e = {**EXPECTED, **more}
    return tuple(e[k] for k in ("node_type", "action_phrase", "pre_conditions", "post_conditions", "tools", "has_safety_bound", "in_scope"))


def gold_of(spark, rows):
    """rows: (branch, step, expected, sub-steps, mode, seconds)."""
    return spark.createDataFrame([(r, s, e, subs, bool(subs), 20.0 if subs else None, "ann", "2024-01-01", "", m, t, "", "1") for r, s, e, subs, m, t in rows], schema.GOLD)


# scope


def test_scope_trims_and_drops(spark):
    dims = Dims(aliases={"sea salt": "salt", "eggs": "egg"}, ingredients=("egg", "salt"), utensils=("bowl",), known_out=("milk",))
    c = lambda *names: [(n, "x", "solid") for n in names]
    row = lambda step, phrase, pre, post, ing, tools, inside=True, kind="Process": ("r", step, 1, kind, phrase, pre, post, None, ing, tools, "s", inside, None, 1.0, "m")
    rows = [
        row(1, "season", c("Eggs", "egg", "milk"), c("egg"), ["sea salt", "milk", "salt"], ["bowl", "measuring cup"]), row(2, "pour the milk", c("egg"), c("egg"), [], []), row(3, "x", [], [], [], ["cup"]),
        row(4, "x", c("egg"), [], [], []), row(5, "x", c("egg"), [], [], [], True, "Transfer"), row(6, "x", c("egg"), c("egg"), [], [], False), row(7, "use the measuring cup", c("egg"), c("egg"), [], ["measuring_cup"]),
    ]
    out = {r.step_number: r for r in scope.apply_scope(spark.createDataFrame(rows, schema.ACTION), dims).collect()}
    assert [x.entity_id for x in out[1].pre] == ["egg"] and out[1].ingredients == ["salt"] and out[1].tools == ["bowl"]
    assert out[1].reason is None and out[1].removed_entities == ["milk", "measuring cup"]
    assert [out[i].reason for i in range(2, 8)] == ["action_phrase names out-of-inventory items: milk", "no inventory item is involved", "Process has no state change on an inventory item", None, "generator marked the step as outside the dish", "action_phrase names out-of-inventory items: measuring cup"]
    report = scope.scope_report(scope.apply_scope(spark.createDataFrame(rows, schema.ACTION), dims)).first()
    assert tuple(report) == (5, 1)


def test_goal_completion(spark):
    rows = [("open", 1, "Process", "cook", "liquid", "solid"), ("done", 1, "Plate", "serve", "solid", "solid"), ("raw", 1, "Process", "mix", "liquid", "liquid"), ("raw", 4, "Process", "mix", "liquid", None)]
    from stepweave.functions.nested import literal_map, resolve_conditions

    actions = actions_of(spark, rows).withColumn("post", resolve_conditions(F.col("post"), literal_map({"eggs": "egg"})))
    out, report = scope.complete_to_goal(actions, DIMS)
    assert {(r.recipe_id, r.last_state, r.step_number, r.added) for r in report.collect()} == {("open", "solid", 2, True), ("raw", "liquid", 5, False)}
    new = out.filter(F.col("extractor_model") == scope.RULE_MODEL).collect()
    assert len(new) == 1 and new[0].node_type == "Plate" and new[0].source_span == "" and new[0].pre == new[0].post


# verification


@pytest.fixture
def open_actions(spark):
    rows = [("r", i, "Process", "cook eggs", "liquid", "solid") for i in range(1, 5)]
    actions = actions_of(spark, rows).drop("verdict").withColumns({"pre": F.transform("pre", lambda c: c.withField("entity_id", F.lit("egg"))), "source_span": F.lit("cook"), "temperature_c": F.when(F.col("step_number") == 1, 99.0)})
    return actions, spark.createDataFrame([("r", i, "now cook it") for i in range(1, 5)], schema.STEP)


def answer(p, choice="accept", sure=None):
    return {q: {"noul": p} for q in verify.QUESTIONS} | {"verdict": {"choice": choice, "probabilities": {} if sure is None else {"accept": sure}}}


def test_cascade_asks_only_what_is_open(spark, open_actions):
    actions, steps = open_actions

    def gate(row):
        assert row["step_number"] != 1, "a decided row was asked"
        if row["step_number"] == 4:
            raise ConnectionError("gate is down")
        return answer(0.9 if row["step_number"] == 2 else 0.5)

    def critic(row):
        assert row["step_number"] in (3, 4)
        return {"verdict": "revise" if row["note"] else "accept", "issues": [row["note"] or ""], "revision_instructions": "more"}

    got = {r.step_number: r for r in verify.verify(actions, steps, DIMS, gate, [("critic", critic)]).collect()}
    assert {k: (r.verdict, r.critic_model) for k, r in got.items()} == {1: ("reject", "deterministic"), 2: ("accept", "gate"), 3: ("revise", "critic"), 4: ("accept", "critic")}
    assert got[3].issues[0].startswith("node_type_matches=0.50") and got[2].scores["node_type_matches"] == 0.9 and "Invented temperature 99.0" in got[1].issues[0]
    cached = verify.verify(actions, steps, DIMS, gate, [("critic", critic)])
    again = verify.verify(actions, steps, DIMS, None, [], cached=cached.filter("step_number > 0"))
    assert again.count() == 4


def test_one_round_of_revision(spark, open_actions):
    actions, steps = open_actions

    def extractor(request):
        assert request["hint"] == "more"
        return [{"action_phrase": "stir eggs", "pre": [("egg", "raw", None)], "post": [("egg", "firm", None)], "source_span": "cook"}]

    def critic(row):
        return {"verdict": "accept"} if row["action_phrase"] == "stir eggs" or row["step_number"] == 2 else {"verdict": "revise", "revision_instructions": "more"}

    kept, verdicts = verify.verify_with_revision(actions, steps, DIMS, [("x", extractor)], None, [("critic", critic)])
    assert sorted((r.step_number, r.action_phrase) for r in kept.collect()) == [(2, "cook eggs"), (3, "stir eggs"), (4, "stir eggs")]
    assert verdicts.filter("pass = 2").count() == 2
    assert {r.verdict for r in readers.latest_verdicts(verdicts).filter("step_number = 3").collect()} == {"accept"}
    kept, _ = verify.verify_with_revision(actions, steps, DIMS, [], None, [("critic", critic)], revise=False)
    assert [r.step_number for r in kept.collect()] == [2]


def test_extraction_grounds_and_compiles(spark):
    dims = Dims(states={"runny": "liquid"})
    steps = spark.createDataFrame([("r", 1, "don’t stir"), ("r", 2, "x")], schema.STEP)
    out = verify.extract(steps, [("m", lambda q: [{"action_phrase": "a", "pre": [("egg", "Runny", None)], "source_span": "don't stir" if q["step_number"] == 1 else "x"}, {"action_phrase": "b"}])], dims)
    rows = {(r.step_number, r.sub_step): r for r in out.collect()}
    assert rows[1, 1].source_span == "don’t stir" and rows[1, 1].pre[0].k2_label == "liquid" and rows[2, 2].action_phrase == "b" and len(rows) == 4
    cached = verify.extract(steps, [("n", lambda q: 1 / 0)], dims, cached=out)
    assert cached.count() == 4


def test_fallback_order():
    asked, waits = [], []

    def model(name, error=None):
        def call(request):
            asked.append(name)
            if error:
                raise error
            return name

        return name, call

    assert verify.call_with_fallback([model("a", TimeoutError()), model("b")], {}, tries=2, delay=1.0, sleep=waits.append) == ("b", "b")
    assert asked == ["a", "a", "b"] and waits == [1.0, 2.0]
    with pytest.raises(ValueError, match="bad"):
        verify.call_with_fallback([model("a", ValueError("bad")), model("b")], {})
    with pytest.raises(RuntimeError):
        verify.call_with_fallback([model("a", ConnectionError())], {})
    with pytest.raises(ValueError, match="lacks"):
        verify.score_map({"verdict": {"choice": "accept"}})
    assert verify.score_map(answer(0.7, "revise"))["verdict_accept"] == 0.0


def test_gate_thresholds_count_themselves(spark):
    def accepted(p, choice="accept", sure=None):
        pairs = list(verify.score_map(answer(p, choice, sure)).items())
        return spark.range(1).select(verify.gate_accepts(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), F.lit(choice), 0.8)).first()[0]

    assert accepted(0.8) and accepted(0.8, sure=0.8)
    assert not accepted(0.79) and not accepted(0.9, "revise") and not accepted(0.9, sure=0.5)


# review and metrics


def test_work_time(spark):
    ticks = spark.createDataFrame([("s", "a", 1000.0), ("s", "a", 1030.0), ("s", "a", 2230.0), ("s", "b", 2235.0), ("s", "a", 2240.0), ("t", "a", 5.0), ("t", "a", 4.0)], "session string, key string, at double")
    got = [(r.session, r.at, r.active) for r in review.work_time(ticks, ["session"], "key", "at", 120.0).orderBy("session", "at").collect()]
    assert got == [("s", 1000.0, 0.0), ("s", 1030.0, 30.0), ("s", 2230.0, 150.0), ("s", 2235.0, 0.0), ("s", 2240.0, 0.0), ("t", 4.0, 0.0), ("t", 5.0, 1.0)]


def test_work_time_as_a_stream(spark, tmp_path):
    ticks = [("s", "a", 1000.0), ("s", "a", 1030.0), ("s", "a", 2230.0), ("s", "b", 2235.0), ("s", "a", 2240.0)]
    for i, part in enumerate((ticks[:2], ticks[2:])):
        spark.createDataFrame(part, "session string, key string, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = timer.work_time(spark.readStream.schema("session string, key string, at double").parquet(str(tmp_path / "in")), 120.0)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == (2, 5)[i]
    got = [r.active for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == [0.0, 30.0, 150.0, 0.0, 0.0]


def test_gold_upserts(spark):
    gold = gold_of(spark, [("r", 1, expected(), [expected(), expected(action_phrase="b")], "corrected", 10.0), ("r", 2, expected(), [], "corrected", 5.0)])
    edit = spark.createDataFrame([("r", 1, expected(action_phrase="new"), "me", "corrected", 7.0, "n", ""), ("r", 3, expected(), "me", "from_scratch", -4.0, "n", "")], f"recipe_id string, step_number int, expected {schema._EXPECTED}, annotator string, mode string, seconds double, notes string, seeded_from_run string").withColumn("edited_at", F.lit("2024-05-01").cast("timestamp"))
    out = {r.step_number: r for r in review.save_gold(gold, edit, "1").collect()}
    assert out[1].expected.action_phrase == "new" and out[1].seconds_spent == 17.0 and len(out[1].sub_steps) == 2
    assert out[3].seconds_spent == 0.0 and out[3].mode == "from_scratch" and out[2].seconds_spent == 5.0
    newer = {r.step_number: r for r in review.save_gold(gold, edit, "2").collect()}
    assert newer[1].seconds_spent == 7.0 and newer[1].sub_steps == [] and newer[1].definition_version == "2"
    split = spark.createDataFrame([("r", 2, [expected(), expected()], 3.0)], f"recipe_id string, step_number int, actions array<{schema._EXPECTED}>, seconds double")
    done = {r.step_number: r for r in review.save_split(gold, split, "1").collect()}
    assert len(done[2].sub_steps) == 2 and done[2].split_checked and done[2].split_seconds_spent == 3.0 and len(done[1].sub_steps) == 2
    with pytest.raises(Exception, match="current review"):
        review.save_split(gold, split, "2").collect()
    assert schema.violations(gold, schema.gold_checks(), ["recipe_id"]).isEmpty()


def test_metrics_of_a_small_review(spark):
    """Three steps: one kept with other wording and tools, one dropped as it should be, one missed."""
    gold = gold_of(spark, [("r", 1, expected(), [], "corrected", 40.0), ("r", 2, expected(in_scope=False), [], "corrected", 80.0), ("r", 3, expected(), [expected(), expected()], "from_scratch", 100.0)])
    auto = spark.createDataFrame([("r", 1, "kept", "", expected(action_phrase="Cook  EGGS", tools=["bowl"]), 1), ("r", 2, "dropped", "", expected(), 0)], f"recipe_id string, step_number int, status string, reason string, auto {schema._EXPECTED}, auto_actions int")
    rows = metrics.compare_steps(gold, auto)
    by = {r.step_number: r for r in rows.collect()}
    assert by[1].fields_changed == ["tools"] and by[2].unchanged and by[3].auto_status == "missing" and not by[3].scope_agrees
    acc = {r["mode"]: r for r in metrics.accuracy(rows).collect()}
    assert acc[None].scope_agreement_pct == 66.7 and acc[None].unchanged_pct == 33.3 and acc["corrected"].unchanged_pct == 50.0
    assert acc[None].tools_pct == 0.0 and acc[None].node_type_pct == 100.0 and acc[None].pre_conditions_f1 == 1.0 and acc[None].wrongly_dropped == 1
    eff = metrics.effort(rows).first()
    assert eff.total_edits == 2 and eff.scope_fixes == 1 and eff.edits_per_step == 0.67
    times = metrics.time_stats(rows)
    assert {r["mode"]: r.mean_seconds_per_step for r in times.collect()} == {"corrected": 60.0, "from_scratch": 100.0}
    save = metrics.savings(times, 3).first()
    assert (save.seconds_saved_per_step, save.pct_saved_per_step, save.by_hand_minutes) == (40.0, 40.0, 5.0)
    split = metrics.split_metrics(rows).first()
    assert split.actions_reviewer == 3 and split.steps_split_by_reviewer == 1 and split.action_count_agrees_pct == 100.0
    assert "| mode |" in sinks.markdown("Time", [r.asDict() for r in times.select("mode", "steps").collect()])
    assert sinks.step_table(rows).filter("step_number = 1").first().fields_changed == "tools"


def test_final_graph_from_reviews(spark):
    dims = Dims(**{**DIMS.__dict__, "classes": {"crack eggs": "crack", "mix eggs": "mix", "cook eggs": "cook", "serve eggs": "plate"}})
    e = lambda phrase, heat, before, after, **m: expected(action_phrase=phrase, has_safety_bound=heat, pre_conditions=[("egg", before)], post_conditions=[("egg", after)], **m)
    steps = spark.createDataFrame([("r1", 1, "Crack, mix."), ("r1", 2, "Cook it."), ("r2", 1, "Cook."), ("gone", 1, "x")], schema.STEP)
    gold = gold_of(spark, [("r1", 1, e("crack and mix", False, "liquid", "liquid"), [e("crack eggs", False, "liquid", "liquid"), e("mix eggs", True, "liquid", "liquid")], "corrected", 1.0), ("r1", 2, e("cook eggs", True, "liquid", "solid"), [], "corrected", 1.0), ("r2", 1, e("cook eggs", True, "liquid", "solid"), [], "corrected", 1.0)])
    timed = spark.createDataFrame([("r1", 1, 1, "Crack", (60.0, None))], "recipe_id string, step_number int, sub_step int, source_span string, timing struct<duration_s:double,deadline:string>")
    with pytest.raises(ValueError, match="unreviewed: 1"):
        build.finalise(gold, steps, dims)
    dims = Dims(**{**dims.__dict__, "excluded": {"gone": "x"}})
    g, _ = build.finalise(gold, steps, dims, extracted=timed)
    nodes = {r.action_phrase: r for r in g.nodes.collect()}
    assert set(nodes) == {"crack eggs", "mix eggs", "cook eggs", "serve eggs"} and nodes["cook eggs"].n_recipes == 2
    assert nodes["mix eggs"].timing.duration_s == 60.0 and nodes["crack eggs"].timing is None
    assert len(nodes["mix eggs"].safety_bounds) == 1 and not nodes["crack eggs"].safety_bounds
    ok, errors = build.validate(g, steps, dims)
    assert ok, errors.collect()
    left = gates.blockers(steps, gold, scope.apply_scope(actions_of(spark, [("r", 1, "Process", "x", None, None)]), dims), spark.createDataFrame([("r", 1, None)], "recipe_id string, step_number int, cls string"), spark.createDataFrame([], "recipe_id string, rule_id string, first long, then long"), spark.createDataFrame([("r", 2, "cook", False)], "recipe_id string, step_number int, action_phrase string, thermal boolean"))
    assert {r.kind for r in left.collect()} == {"unreviewed", "out of scope", "unclassified", "heat not ticked"}


def test_storing_a_graph(spark, tmp_path):
    g = build.fuse_graph(actions_of(spark, [("r1", 1, "Process", "cook o'eggs", "liquid", "solid"), ("r1", 2, "Plate", "serve \\eggs", "solid", "solid")]), DIMS)
    build.store(g, str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g"))
    assert back["nodes"].count() == 2 and back["edges"].count() == g.edges.count()
    script = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g" / "cypher")).collect())
    assert "cook o\\'eggs" in script and "serve \\\\eggs" in script and "[:NEXT {source_recipe_id: 'r1'}]" in script and "MERGE (n:SafetyBound" in script
    found = spark.createDataFrame([(f"// head\n{script}",)], "s string").select(sinks.statements(F.col("s"))).first()[0]
    assert len(found) == len(script.split(";")) - 1
    ran: list = []
    rows = sinks.cypher_rows(g.nodes, g.edges, g.ingredient_nodes, g.tool_nodes, g.bounds, g.provenance)

    def connect():
        def execute(s):
            if "Plate" in s:
                raise RuntimeError("refused")

        return execute

    errors = sinks.send(rows, connect)
    assert len(errors) == 1 and "refused" in errors[0] and not ran
    assert len(json.loads(sinks.graph_document(g.nodes, g.edges).first()[0])["nodes"]) == 2
    sinks.write_run(g.nodes.select("node_id"), str(tmp_path / "runs"), "run2")
    sinks.write_run(g.nodes.select("node_id").limit(1), str(tmp_path / "runs"), "run1")
    sinks.write_run(g.nodes.select("node_id").limit(1), str(tmp_path / "runs"), "run2")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2 and readers.runs(spark, str(tmp_path / "runs")) == ["run1", "run2"]
    assert len(sinks.schema_statements()) == 10


# pages and documents


def test_pages(spark):
    recipe = {"@type": "Recipe", "name": "Caf&eacute; eggs", "recipeIngredient": [" 2 eggs ", ""], "recipeInstructions": [{"text": "Whisk the eggs at 70 C for a while."}, "", "see also: others here", "Cook over low heat for 2 minutes."]}
    text = {"@type": "recipe", "recipeInstructions": "First line of the steps\n\nSecond line of the steps"}
    wrap = lambda x: f'<html><script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script></html>'
    tags = "<h1 class='page-title'>Eggs &amp; more</h1><ul><li class='ingredient'>2 eggs</li><li class='ingredient'> </li></ul><ol><li>Whisk the <b>eggs</b> until smooth<li>Cook the eggs slowly now</ol>"
    pages = [(1, wrap(recipe)), (2, wrap([{"@type": "Thing"}, recipe])), (3, wrap({"@graph": [recipe]})), (4, wrap("{broken") + wrap(text)), (5, tags), (6, "<p>nothing</p>"), (7, None), (8, wrap({"@type": ["Recipe"], "name": "list"}))]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r for r in html.parse(df).collect()}
    for i in (1, 2, 3):
        assert got[i].title == "Café eggs" and got[i].ingredients == ["2 eggs"] and got[i].via == "linked"
        assert [s.number for s in got[i].steps] == [1, 4] and got[i].dropped == 1 and got[i].enough
        assert got[i].temperatures_mentioned == ["70 C", "low heat"]
    assert [s.text for s in got[4].steps] == ["First line of the steps", "Second line of the steps"]
    assert got[5].title == "Eggs & more" and [s.text for s in got[5].steps] == ["Whisk the eggs until smooth", "Cook the eggs slowly now"] and got[5].ingredients == ["2 eggs"]
    assert not got[6].enough and not got[7].enough and got[8].via == "tags"
    enough, quarantine = build.ingest(df)
    assert enough.count() == 5 and quarantine.count() == 3
    fetched = readers.fetch(spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "bad")], "page_id long, url string"), lambda u: u.upper() if u != "bad" else 1 / 0, spark.createDataFrame([(1, "u1", "kept")], "page_id long, url string, html string"))
    assert {r.page_id: r.html for r in fetched.collect()} == {1: "kept", 2: "U2", 3: None}


def test_documents(spark, tmp_path):
    good = {"recipe_id": "a", "title": "A", "steps": [{"number": 1, "text": "x"}, {"number": 3, "text": "y"}]}
    for name, body in (("a", json.dumps(good)), ("b", json.dumps({**good, "recipe_id": "b", "gold": True})), ("c", "{broken"), ("d", json.dumps({**good, "recipe_id": "d"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "canonical.json").write_text(body)
    path = f"{tmp_path}/*/canonical.json"
    excluded = spark.createDataFrame([("d", "why")], "recipe_id string, reason string")
    found = readers.recipes(spark, path, excluded)
    assert sorted(r.recipe_id for r in found.collect()) == ["a", "b"] and found.count() == 2
    assert [r.recipe_id for r in readers.recipes(spark, path, excluded, gold_only=True).collect()] == ["b"]
    assert sorted((r.recipe_id, r.step_number) for r in readers.steps_of(found).collect()) == [("a", 1), ("a", 3), ("b", 1), ("b", 3)]
    bad = readers.bad_documents(spark, path, schema.RECIPE).collect()
    assert len(bad) == 1 and "broken" in bad[0]._bad
    assert tuple(metrics.schema_valid(readers.json_documents(spark, path, schema.RECIPE)).first()) == (4, 3, 75.0)


def test_dims_from_documents():
    d = from_documents(
        {"goal": {"entity": "egg", "k2_labels": ["solid"], "location": "plate"}, "inventory": {"ingredients": ["egg"], "utensils": ["pan"]}, "known_out_of_inventory": ["Milk"], "definition_version": "v"},
        {"k2_compile_map": {"liquid": ["Raw "]}, "canonical_entities": [{"canonical": "egg", "aliases": ["Eggs"]}]}, {"bounds": [{"id": "x", "label": "X", "temperature_c": 62}]},
        {"action_classes": {"c": ["Mix  Eggs"]}, "order_rules": [{"id": "r", "before": ["c"], "after": ["c"], "source": "curated"}], "preference_points": [{"id": "p", "kind": "structural", "alternatives": [{"choice": "a", "source": {"recipe_id": "r", "step": 1, "quote": "q"}}]}]},
        {"recipes": [{"recipe_id": "z", "excluded": "no"}, {"recipe_id": "y"}]},
    )
    assert d.states == {"raw": "liquid", "liquid": "liquid"} and d.aliases == {"egg": "egg", "eggs": "egg"} and d.classes == {"mix eggs": "c"}
    assert d.known_temperatures == [62.0] and d.excluded == {"z": "no"} and d.known_out == ("milk",) and d.preferences[0][6:] == ("r", 1, "q", False)


def test_checks_and_keys(spark):
    rows = actions_of(spark, [("r", 1, "Process", "x", None, None), ("r", 2, "Odd", "x", "liquid", "nope"), ("r", 3, "Transfer", "x", None, None)]).withColumn("confidence", F.when(F.col("step_number") == 3, 2.0).otherwise(1.0))
    got = {(r.step_number, r.check) for r in schema.violations(rows, schema.action_checks(), ["step_number"]).collect()}
    assert got == {(1, "process_has_states"), (2, "node_type_known"), (2, "label_known"), (3, "confidence_in_range")}
    assert gates.gate1(rows).count() == 4
    gap = actions_of(spark, [("r", 1, "Process", "x", "liquid", "solid")]).drop("sub_step").join(spark.createDataFrame([(1,), (2,), (4,)], "sub_step int"))
    assert readers.contiguous(gap).count() == 2


def test_boundaries(spark):
    scores = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.1, 0.9, 0.3, 0.4, 0.2, 0.8])], "g string, t int, s double")
    assert [r.t for r in timer.boundaries(scores, ["g"], "t", "s", 0.5).orderBy("t").collect()] == [1, 5]
