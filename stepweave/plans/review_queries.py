"""Queries of review, verification, scope, sinks and reports over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.functions.nested import CONDITIONS
from stepweave.operators import gates, graph, merge, review, scope, verify
from stepweave.plans import bindings as b
from stepweave.plans import metrics
from stepweave.plans.registry import query
from stepweave.sources import readers, schema, sinks

STATE = "array<struct<entity_id:string,k2_label:string>>"
WITH_ACTIONS = "WITH " + b.ACTIONS_SQL


def expected(node_type, phrase, pre, post, tools, heated, inside):
    """A reviewed action as a column; pre and post are lists of (entity, label) columns."""
    states = lambda xs: (F.array(*[F.struct(e.alias("entity_id"), l.alias("k2_label")) for e, l in xs]) if xs else F.array()).cast(STATE)
    return F.struct(node_type.alias("node_type"), phrase.alias("action_phrase"), states(pre).alias("pre_conditions"), states(post).alias("post_conditions"), F.array(*tools).cast("array<string>").alias("tools"), heated.alias("has_safety_bound"), inside.alias("in_scope"))


# Text


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(p_type)), '\\s+', ' ', 'g') OR p_size % 3 = 0 AS same FROM part")
def same_wording(spark, d):
    other = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), F.replace(F.upper("p_name"), F.lit(" "), F.lit(" \t")))).otherwise(F.col("p_type"))
    return b.table(spark, d, "part").select("p_partkey", tx.same_phrase(F.col("p_name"), other).alias("same"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round(100.0::DOUBLE * (o_custkey % 5) / (o_orderkey % 3), 1) END AS pct, round(100.0::DOUBLE * (o_custkey % 5) / greatest(o_orderkey % 3, 1), 1) AS pct_or_zero,
least(greatest(o_custkey % 200 - 50, 0), 120)::DOUBLE AS clamped FROM orders""")
def percentages(spark, d):
    part, whole = F.col("o_custkey") % 5, F.col("o_orderkey") % 3
    return b.table(spark, d, "orders").select("o_orderkey", tx.percent(part, whole).alias("pct"), tx.percent_or_zero(part, whole).alias("pct_or_zero"), tx.clamp(F.col("o_custkey") % 200 - 50, 0.0, 120.0).cast("double").alias("clamped"))


@query("""SELECT p_partkey, list_transform(['bolt:solid'] || CASE WHEN n IN ('bolt') THEN [] ELSE [n || ':solid'] END, lambda x: x)[1:2].array_to_string('|') AS pre, CASE WHEN n = 'ring' THEN 'ring' ELSE 'ring|' || n END AS tools, p_name AS phrase, p_size > 25 AS heated
FROM (SELECT *, split_part(p_name, ' ', 2) AS n FROM part)""")
def clean_review(spark, d):
    """A reviewer's entry tidied: blank and unknown states go, names are resolved, doubles go, wording is stripped."""
    aliases = b.DIMS.alias_map()
    pre = [(F.lit("Bolts"), F.lit(" solid ")), (F.lit(" "), F.lit("solid")), (F.lit("gear"), F.lit("unknown")), (F.col("noun"), F.lit("solid")), (F.lit("bolt"), F.lit("solid"))]
    raw = expected(F.lit(None).cast("string"), F.concat(F.lit("  "), "p_name", F.lit(" ")), pre, [], [F.lit("ring"), F.lit(" "), F.col("noun"), F.lit("RING")], F.when(F.col("p_size") > 25, True), F.lit(None).cast("boolean"))
    done = review.clean_expected(F.col("e"), aliases)
    rows = b.part_names(spark, d).select("p_partkey", raw.alias("e")).select("p_partkey", done.alias("e")).filter("e.node_type = 'Process' and e.in_scope and size(e.post_conditions) = 0")
    return rows.select("p_partkey", F.array_join(F.transform("e.pre_conditions", lambda c: F.concat_ws(":", c["entity_id"], c["k2_label"])), "|").alias("pre"), F.array_join("e.tools", "|").alias("tools"), F.col("e.action_phrase").alias("phrase"), F.col("e.has_safety_bound").alias("heated"))


# Review


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 > 0 THEN doc_id % 3 + 1 ELSE 0 END::BIGINT AS n_sub, doc_id % 4 = 0 AS split_checked,
CASE WHEN doc_id % 4 = 0 THEN 5.0 + greatest(doc_id % 7 - 2, 0) WHEN doc_id % 2 = 0 THEN 5.0 END::DOUBLE AS seconds FROM labels""")
def split_upsert(spark, d):
    """Splits into one to three actions (one clears) of every fourth step."""
    act = expected(F.lit("Process"), F.lit("a"), [], [], [], F.lit(False), F.lit(True))
    base = b.table(spark, d, "labels").select(F.lit("r").alias("recipe_id"), F.col("doc_id").cast("int").alias("step_number"), "doc_id")
    gold = base.select("recipe_id", "step_number", F.array().cast(f"array<{schema._EXPECTED}>").alias("sub_steps"), F.lit(False).alias("split_checked"), F.when(F.col("doc_id") % 2 == 0, 5.0).alias("split_seconds_spent"), F.lit("2").alias("definition_version"))
    splits = base.filter("doc_id % 4 = 0").select("recipe_id", "step_number", F.array_repeat(act, (F.col("doc_id") % 3 + 1).cast("int")).alias("actions"), (F.col("doc_id") % 7 - 2).cast("double").alias("seconds"))
    out = review.save_split(gold, splits, "2")
    return out.select(F.col("step_number").alias("doc_id"), F.size("sub_steps").alias("n_sub"), "split_checked", F.col("split_seconds_spent").alias("seconds"))


@query("""SELECT printf('a%08d__b%08d', p_partkey, p_partkey) AS pair_id, CASE WHEN p_partkey % 3 = 0 THEN 'different' ELSE 'same' END AS label,
CASE WHEN p_partkey % 3 = 0 THEN greatest(p_partkey % 5 - 1, 0) + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END ELSE 3 END::DOUBLE AS seconds FROM part WHERE p_partkey % 7 <> 0""")
def pair_labels(spark, d):
    """Labels of pairs after edits (two of a pair, in either order) and deletions; time stays with pairs still in the graph."""
    k = b.table(spark, d, "part").select("p_partkey", F.format_string("a%08d", "p_partkey").alias("a_id"), F.format_string("b%08d", "p_partkey").alias("b_id"))
    labels = k.select(tx.pair_id(F.col("a_id"), F.col("b_id")).alias("pair_id"), "a_id", "b_id", F.lit("same").alias("label"), F.lit(3.0).alias("seconds_spent"))
    nodes = k.select(F.col("a_id").alias("node_id")).union(k.filter("p_partkey % 2 = 0").select("b_id"))
    edit = lambda at, label, s: k.filter("p_partkey % 3 = 0").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.lit(label).alias("label"), s.cast("double").alias("seconds_spent"), F.timestamp_seconds(F.lit(at)).alias("edited_at"))
    saved = review.save_labels(labels, edit(1, "a_contains_b", F.lit(50)).union(edit(2, "different", F.col("p_partkey") % 5 - 1)), nodes)
    out = review.delete_labels(saved, labels.filter("cast(substring(a_id, 2, 8) as int) % 7 = 0"))
    return out.select("pair_id", "label", F.col("seconds_spent").alias("seconds"))


_COMPARED = """WITH c AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'dropped' ELSE 'kept' END AS auto_status, doc_id % 5 <> 0 AS gold FROM labels),
b AS (SELECT *, auto_status = 'kept' AS auto, auto_status = 'kept' AND gold AS kept FROM c) """


@query(_COMPARED + """SELECT doc_id, auto_status, auto = gold AS scope_agrees, CASE WHEN kept THEN array_to_string(list_filter([CASE WHEN quality <> 1 THEN 'node_type' END, CASE WHEN quality <> 1 OR doc_id % 2 = 0 THEN 'post_conditions' END, CASE WHEN toxic = 1 THEN 'has_safety_bound' END], lambda x: x IS NOT NULL), ';') ELSE '' END AS fields_changed,
CASE WHEN kept THEN CASE WHEN quality = 1 THEN 1 ELSE 0 END END::BIGINT AS tp, CASE WHEN kept THEN 1 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN quality = 1 THEN 1 ELSE 0 END END::BIGINT AS fp, CASE WHEN kept THEN CASE WHEN quality = 1 THEN 0 ELSE 1 END END::BIGINT AS fn,
CASE WHEN gold THEN 1 ELSE 0 END::BIGINT AS gold_actions, CASE WHEN auto THEN 1 ELSE 0 END::BIGINT AS auto_actions FROM b""")
def compared_steps(spark, d):
    """Reviewed steps against what the pipeline gave, field by field."""
    rows = b.table(spark, d, "labels").withColumns({"recipe_id": F.lit("r"), "step_number": F.col("doc_id")})
    egg, salt, solid = F.lit("egg"), F.lit("salt"), F.lit("solid")
    gold = rows.select(
        "recipe_id", "step_number", "doc_id", F.lit("corrected").alias("mode"), F.array().cast(f"array<{schema._EXPECTED}>").alias("sub_steps"),
        expected(F.when(F.col("quality") == 1, "Process").otherwise("Transfer"), F.lit("cook  Eggs"), [(egg, F.lit("liquid"))], [(egg, F.when(F.col("quality") == 1, "solid").otherwise("liquid"))], [F.lit("pan")], F.col("toxic") == 1, F.col("doc_id") % 5 != 0).alias("expected"),
    )
    post = F.when(F.col("doc_id") % 2 == 0, expected(egg, egg, [], [(egg, solid), (salt, solid)], [], F.lit(True), F.lit(True))["post_conditions"]).otherwise(expected(egg, egg, [], [(egg, solid)], [], F.lit(True), F.lit(True))["post_conditions"])
    auto = expected(F.lit("Process"), F.lit("Cook eggs"), [(egg, F.lit("liquid"))], [], [F.lit("pan"), F.lit("pan")], F.lit(False), F.lit(True)).withField("post_conditions", post)
    kept = F.col("doc_id") % 3 != 0
    found = rows.filter("doc_id % 7 <> 0").select("recipe_id", "step_number", F.when(kept, "kept").otherwise("dropped").alias("status"), auto.alias("auto"), kept.cast("int").alias("auto_actions"))
    out = metrics.compare_steps(gold, found)
    return out.select("doc_id", "auto_status", "scope_agrees", F.array_join("fields_changed", ";").alias("fields_changed"), *[F.col(f"post_conditions_{k}").alias(k) for k in ("tp", "fp", "fn")], "gold_actions", "auto_actions")


@query("""WITH g AS (SELECT l.doc_id, d.text FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 5 <> 0)
SELECT doc_id, 1::BIGINT AS sub_step, CASE WHEN doc_id % 3 = 0 THEN 'stir' ELSE 'mix' END AS action_phrase, md5(CASE WHEN doc_id % 3 = 0 OR text = '' THEN text ELSE substr(text, 1, 10) END) AS span, CASE WHEN doc_id % 3 > 0 THEN doc_id END::DOUBLE AS duration, false AS thermal FROM g
UNION ALL SELECT doc_id, 2, 'cook', md5(text), doc_id, true FROM g WHERE doc_id % 3 = 0""")
def reviewed_actions(spark, d):
    """Actions of reviewed steps: one, or the two of a split one, whose heated one takes the timing."""
    rows = b.table(spark, d, "labels").select(F.lit("r").alias("recipe_id"), F.col("doc_id").cast("int").alias("step_number"), "doc_id")
    egg, solid, yes, no = F.lit("egg"), F.lit("solid"), F.lit(True), F.lit(False)
    act = lambda phrase, heated, inside=yes: expected(F.lit("Process"), F.lit(phrase), [(egg, solid)], [(egg, solid)], [], heated, inside)
    kind = f"array<{schema._EXPECTED}>"
    gold = rows.select("recipe_id", "step_number", act("mix", no, F.col("doc_id") % 5 != 0).alias("expected"), F.when(F.col("doc_id") % 3 == 0, F.array(act("stir", no), act("cook", yes)).cast(kind)).otherwise(F.array().cast(kind)).alias("sub_steps"), F.lit("ann").alias("annotator"))
    docs = b.table(spark, d, "documents").select(F.lit("r").alias("recipe_id"), F.col("doc_id").cast("int").alias("step_number"), "text")
    extracted = docs.select("recipe_id", "step_number", F.lit(1).alias("sub_step"), F.substring("text", 1, 10).alias("source_span"), F.struct(F.col("step_number").cast("double").alias("duration_s"), F.lit(None).cast("string").alias("deadline")).alias("timing"))
    out = review.gold_actions(gold, docs, b.DIMS, extracted)
    return out.select(F.col("step_number").alias("doc_id"), "sub_step", "action_phrase", F.md5("source_span").alias("span"), F.col("timing.duration_s").alias("duration"), "thermal")


@query("""WITH p AS (SELECT printf('%08d', p_partkey) AS k, p_brand || ' ' || p_size AS b, p_partkey FROM part),
c AS (SELECT x.k || '__' || y.k AS pair_id, x.b AS block FROM p x JOIN p y ON x.b = y.b AND x.k < y.k),
h AS (SELECT k || '__' || printf('%08d', p_partkey + 1) AS pair_id FROM p WHERE p_partkey % 10 = 0)
SELECT pair_id, block FROM c UNION ALL SELECT pair_id, NULL FROM h WHERE pair_id NOT IN (SELECT pair_id FROM c)""")
def pair_queue(spark, d):
    """Pairs to be labelled: those of every block and those added by hand, each once."""
    p = b.table(spark, d, "part")
    rows = p.select(F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("block"), F.format_string("%08d", "p_partkey").alias("node_id"))
    a, z = F.format_string("%08d", "p_partkey"), F.format_string("%08d", F.col("p_partkey") + 1)
    hand = p.filter("p_partkey % 10 = 0").select(tx.pair_id(a, z).alias("pair_id"), z.alias("a_id"), a.alias("b_id"), F.lit(True).alias("added_by_hand"))
    return merge.block_queue(rows, hand).select("pair_id", "block")


@query("SELECT printf('%08d__%08d', a.p_partkey, b.p_partkey) AS pair_id, a.p_brand AS component FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_brand = b.p_brand WHERE a.p_partkey % 3 = 0")
def disagreeing_labels(spark, d):
    """Labels other than `same` inside a group."""
    p = b.table(spark, d, "part")
    a, z = F.format_string("%08d", "p_partkey"), F.format_string("%08d", F.col("p_partkey") + 1)
    labels = p.select(tx.pair_id(a, z).alias("pair_id"), a.alias("a_id"), z.alias("b_id"), F.when(F.col("p_partkey") % 3 == 0, "different").otherwise("same").alias("label"))
    return merge.not_transitive(labels, p.select(a.alias("node"), F.col("p_brand").alias("component"))).select("pair_id", "component")


@query("SELECT min(d.doc_id) AS doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.doc_id % 7 <> 0 WHERE l.doc_id IS NULL")
def next_open(spark, d):
    at = [F.lit("r").alias("recipe_id"), F.col("doc_id").alias("step_number")]
    gold = b.table(spark, d, "labels").select(*at, F.col("quality").alias("expected"), F.when(F.col("doc_id") % 7 == 0, "1").otherwise("2").alias("definition_version"))
    return review.first_open(b.table(spark, d, "documents").select(*at), gold, "2").select(F.col("step_number").alias("doc_id"))


# Scope


@query("""SELECT p_partkey, array_to_string(list_distinct_order(x), '|') AS ingredients, CASE WHEN n = 'plate' THEN 'ring|plate' ELSE 'ring' END AS tools, CASE WHEN n IN ('bolt', 'gear', 'rod', 'plate', 'ring') THEN 'widget' WHEN n = 'widget' THEN 'widget' ELSE n || '|widget' END AS removed
FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS n, CASE WHEN n IN ('gear', 'rod') THEN [n, 'bolt'] ELSE ['bolt'] END AS x FROM part)""".replace("list_distinct_order", ""))
def scope_trimming(spark, d):
    """What is left of actions whose names are partly outside the inventory, and what was taken from them."""
    none = F.array().cast(CONDITIONS)
    rows = b.part_names(spark, d).select(
        "p_partkey", F.lit("r").alias("recipe_id"), F.col("p_partkey").alias("step_number"), F.lit(1).alias("sub_step"), F.lit("Transfer").alias("node_type"), F.lit("move it").alias("action_phrase"), none.alias("pre"), none.alias("post"),
        F.array(F.col("noun"), F.lit("Bolts"), F.lit("widget")).alias("ingredients"), F.array(F.lit("ring"), F.col("noun")).alias("tools"), F.lit(True).alias("in_scope"),
    )
    out = scope.apply_scope(rows, b.DIMS).filter("reason is null")
    return out.select("p_partkey", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("tools", "|").alias("tools"), F.array_join("removed_entities", "|").alias("removed"))


@query(WITH_ACTIONS + """, g AS (SELECT recipe_id, bool_or(node_type = 'Plate' AND k < 3) AS plate, arg_max(post_label, step_number) AS last_state, max(step_number) AS last FROM act GROUP BY 1)
SELECT recipe_id, last + 1 AS step_number, 'Plate' AS node_type, 'close the case' AS action_phrase, last_state AS label, 'plate' AS tools FROM g WHERE NOT plate AND last_state IN ('coagulating', 'solid')""")
def goal_rows(spark, d):
    """The closing actions that the goal rule adds."""
    rows = b.actions(spark, d).withColumns({"node_type": F.when((F.col("node_type") == "Plate") & (F.col("k") >= 3), "Process").otherwise(F.col("node_type")), "post": nested.resolve_conditions(F.col("post"), nested.literal_map(b.ALIASES))})
    new = scope.complete_to_goal(rows, b.DIMS)[0].filter(F.col("extractor_model") == scope.RULE_MODEL)
    return new.select("recipe_id", "step_number", "node_type", "action_phrase", F.get("pre", F.lit(0))["k2_label"].alias("label"), F.array_join("tools", "|").alias("tools"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'dropped' ELSE 'kept' END AS status, CASE WHEN p_size % 4 = 0 THEN 'critic rejected the extraction' ELSE '' END AS reason, p_size % 4 <> 0 AS in_scope, p_size % 2 = 0 AS heated FROM part")
def shown_actions(spark, d):
    """What reviewers see of each action: status, reason, and the action in a review's shape."""
    p = b.table(spark, d, "part")
    state = F.array(F.struct(F.lit("bolt").alias("entity_id"), F.lit("hot").alias("physics_state"), F.lit("solid").alias("k2_label"))).cast(CONDITIONS)
    key = [F.lit("r").alias("recipe_id"), F.col("p_partkey").alias("step_number"), F.lit(1).alias("sub_step")]
    rows = p.select(*key, F.lit("Process").alias("node_type"), F.when(F.col("p_size") % 2 == 0, "heat it").otherwise("heating").alias("action_phrase"), state.alias("pre"), state.alias("post"), F.array(F.lit("ring")).alias("tools"), F.lit(None).cast("string").alias("reason"))
    verdicts = p.select(*key, F.lit(1).alias("pass"), F.lit("reject").alias("verdict")).union(p.filter("p_size % 4 <> 0").select(*key, F.lit(2).alias("pass"), F.lit("accept").alias("verdict")))
    out = review.auto_actions(rows, verdicts, b.DIMS.alias_map())
    return out.select(F.col("step_number").alias("p_partkey"), "status", "reason", F.col("expected.in_scope").alias("in_scope"), F.col("expected.has_safety_bound").alias("heated"))


# Verification


def checked_rows(spark, d):
    """(actions, steps): some with an invented temperature, some whose span isn't in their step."""
    rows = b.actions(spark, d).withColumns({"timing": F.lit(None).cast("struct<duration_s:double,deadline:string>"), "temperature_c": F.when(F.col("k") % 4 == 3, F.when(F.col("k") == 7, 70.0).otherwise(55.0)), "pre": nested.resolve_conditions(F.col("pre"), nested.literal_map({"eggs": "bolt"})), "post": nested.resolve_conditions(F.col("post"), nested.literal_map({"eggs": "gear"})), "ingredients": F.array(F.lit("bolt"))})
    rows = rows.withColumn("source_span", F.when(F.col("k") == 5, "not there").otherwise("step"))
    return rows, rows.select("recipe_id", "step_number", F.lit("a step").alias("text"))


@query(WITH_ACTIONS + """SELECT recipe_id, step_number, CASE WHEN k % 4 = 3 AND k <> 7 THEN 'reject' WHEN k = 5 THEN 'revise' END AS verdict FROM act WHERE (k % 4 = 3 AND k <> 7) OR k = 5""")
def deterministic_verdicts(spark, d):
    rows, steps = checked_rows(spark, d)
    return verify.deterministic(verify.checks(rows, steps, b.DIMS), b.DIMS)[0].select("recipe_id", "step_number", "verdict")


@query(WITH_ACTIONS + """SELECT count(*) AS actions, count(*) FILTER (WHERE k <> 5) AS grounded, round(100.0::DOUBLE * count(*) FILTER (WHERE k <> 5) / count(*), 1) AS grounded_pct, count(*) AS labels_valid, count(*) FILTER (WHERE k % 4 = 3 AND k <> 7) AS invented_temperatures FROM act""")
def extraction_quality(spark, d):
    rows, steps = checked_rows(spark, d)
    found = metrics.extraction_quality(verify.checks(rows, steps, b.DIMS), b.DIMS.known_temperatures)
    return found.select("actions", "grounded", "grounded_pct", "labels_valid", "invented_temperatures")


def _gate(row):
    """A stand-in for a gate model: sure of even steps, in doubt of odd ones, out of order at each fifth."""
    if row["step_number"] % 5 == 0:
        raise ConnectionError("no answer")
    p = 0.9 if row["step_number"] % 2 == 0 else 0.5
    return {q: {"noul": p} for q in verify.QUESTIONS} | {"verdict": {"choice": "accept", "probabilities": {"accept": 0.95}}}


def _critic(row):
    return {"verdict": "revise" if row["note"] else "accept", "issues": [row["note"] or ""], "revision_instructions": "again"}


_NOTE = ", ".join(f"{q}=0.50" for q in verify.QUESTIONS)


@query(WITH_ACTIONS + f"""SELECT recipe_id, step_number, CASE WHEN k % 4 = 3 AND k <> 7 THEN 'reject' WHEN k = 5 THEN 'revise' WHEN step_number % 5 = 0 THEN 'accept' WHEN step_number % 2 = 0 THEN 'accept' ELSE 'revise' END AS verdict,
CASE WHEN (k % 4 = 3 AND k <> 7) OR k = 5 THEN 'deterministic' WHEN step_number % 5 = 0 THEN 'critic' WHEN step_number % 2 = 0 THEN 'gate' ELSE 'critic' END AS critic_model,
CASE WHEN (k % 4 = 3 AND k <> 7) OR k = 5 OR step_number % 5 = 0 OR step_number % 2 = 0 THEN '' ELSE '{_NOTE}' END AS doubts FROM act""")
def verified_actions(spark, d):
    """The whole cascade: rules, a gate model that may fail, a critic that is told what the gate doubted."""
    rows, steps = checked_rows(spark, d)
    out = verify.verify(rows.select(*[f.split()[0] for f in ("recipe_id", "step_number", "sub_step", "node_type", "action_phrase", "pre", "post", "timing", "ingredients", "tools", "source_span", "in_scope", "temperature_c", "confidence", "extractor_model")]), steps, b.DIMS, _gate, [("critic", _critic)])
    return out.select("recipe_id", "step_number", "verdict", "critic_model", F.when(F.col("critic_model") == "critic", F.array_join("issues", "; ")).otherwise("").alias("doubts"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 10 < 8 THEN 'node_type_matches=0.' || (o_orderkey % 10) || '0' END, CASE WHEN o_orderstatus = 'F' THEN 'verdict=revise' END], lambda x: x IS NOT NULL), ', ') AS failed FROM orders""")
def failed_checks(spark, d):
    scores = F.create_map(*[x for q in verify.QUESTIONS for x in (F.lit(q), (F.col("o_orderkey") % 10) / F.lit(10.0) if q == verify.QUESTIONS[0] else F.lit(0.8))])
    choice = F.when(F.col("o_orderstatus") == "F", "revise").otherwise("accept")
    return b.table(spark, d, "orders").select("o_orderkey", F.array_join(verify.failed_checks(scores, choice, 0.8), ", ").alias("failed"))


def _two_actions(request):
    return [{"action_phrase": request["text"][:5], "pre": [("egg", "whisked", None)]}] * (1 + len(request["text"]) % 2)


def _down(request):
    raise TimeoutError("timeout")


@query("SELECT doc_id, unnest(range(1, 2 + length(text) % 2)) AS sub_step, substr(text, 1, 5) AS action_phrase, 'liquid' AS label, 'second' AS model, md5(text) AS span FROM documents WHERE text IS NOT NULL")
def extracted_actions(spark, d):
    """One or two actions a document by a stand-in model, after a first one that is always down."""
    steps = b.table(spark, d, "documents").filter("text is not null").select("source", F.col("doc_id").cast("int").alias("step_number"), "text").withColumnRenamed("source", "recipe_id")
    steps = steps.withColumn("recipe_id", F.coalesce("recipe_id", F.lit("")))
    out = verify.extract(steps, [("first", _down), ("second", _two_actions)], b.DIMS)
    return out.select(F.col("step_number").alias("doc_id"), "sub_step", "action_phrase", F.get("pre", F.lit(0))["k2_label"].alias("label"), F.col("extractor_model").alias("model"), F.md5("source_span").alias("span"))


@query(WITH_ACTIONS + "SELECT recipe_id, step_number, CASE WHEN k = 8 THEN 'revise' ELSE 'accept' END AS verdict FROM act WHERE k <> 9 AND k <> 1")
def not_rejected(spark, d):
    """Actions with a verdict that isn't a rejection; those without one (k = 1) go."""
    rows = b.actions(spark, d)
    return readers.not_rejected(rows.drop("verdict"), rows.filter("k <> 1").withColumn("pass", F.lit(1))).select("recipe_id", "step_number", "verdict")


# Linters


@query(WITH_ACTIONS + """, p(point, recipe) AS (VALUES ('pace', 'u1'), ('pace', 'u2'), ('pace', 'u3'), ('pace', 'u4'), ('pace', 'u5'), ('route', 'u2'), ('route', 'u5'), ('route', 'u6'), ('route', 'u1'), ('route', 'u999999999'))
SELECT DISTINCT point AS subject, 'unknown branch ' || recipe AS message FROM p WHERE recipe NOT IN (SELECT recipe_id FROM ev)
UNION ALL SELECT * FROM (VALUES ('bare', 'no reason'), ('bare', 'unknown class nowhere'), ('order rules', 'form a cycle: buy -> look -> buy'), ('rule bare', 'quote not found')) v""")
def rule_problems(spark, d):
    """Rules and preferences against the tables: one rule without reason, of an unknown class, with a quote that isn't there, and against another."""
    dims = replace(b.DIMS, rules=(*b.DIMS.rules, (2, "bare", ["buy"], ["look", "nowhere"], " ", "u1", 1, "not said", False)), preferences=(*b.DIMS.preferences[:3], (*b.DIMS.preferences[3][:4], ["u1", "u999999999"], *b.DIMS.preferences[3][5:])))
    steps = b.events(spark, d).select("recipe_id", "step_number", F.col("event_type").alias("text"))
    one = F.when(F.col("message").startswith("no step") | F.col("message").startswith("unknown branch u1"), F.lit(None)).otherwise(F.col("message"))
    return gates.check_rules(dims, spark, steps).withColumn("message", one).filter("message is not null")


@query("""SELECT kind, count(*) AS n FROM (
SELECT 'unreviewed' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'out of scope' FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'unclassified' FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT 'order violation' FROM documents WHERE doc_id % 40 = 0 UNION ALL SELECT 'heat not ticked' FROM documents WHERE doc_id % 20 = 0) GROUP BY kind""")
def final_blockers(spark, d):
    """What stands against a final graph, by kind."""
    docs = b.table(spark, d, "documents").select(F.lit("r").alias("recipe_id"), F.col("doc_id").alias("step_number"), "doc_id")
    reviewed = b.table(spark, d, "labels").select(F.lit("r").alias("recipe_id"), F.col("doc_id").alias("step_number"))
    every = lambda n, value: F.when(F.col("doc_id") % n == 0, value)
    broken = docs.filter("doc_id % 40 = 0").select("recipe_id", F.lit("rule").alias("rule_id"), F.col("doc_id").alias("first"), F.col("doc_id").alias("then"))
    found = gates.blockers(docs, reviewed, docs.withColumn("reason", every(50, "gone")), docs.withColumn("cls", F.when(F.col("doc_id") % 30 != 0, "c")), broken, docs.withColumns({"action_phrase": F.lit("cook it"), "thermal": F.col("doc_id") % 20 != 0}))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 3::BIGINT AS gate, count(*) AS errors FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 5, count(*) FROM part WHERE p_size % 5 = 0""")
def gate_errors(spark, d):
    """Errors by gate, of all gates together."""
    state = lambda label: F.array(F.struct(F.lit("bolt").alias("entity_id"), F.lit("x").alias("physics_state"), label.alias("k2_label"))).cast(CONDITIONS)
    nodes = b.table(spark, d, "part").select(F.format_string("%08d", "p_partkey").alias("node_id"), F.lit("Process").alias("node_type"), F.when(F.col("p_size") % 2 == 0, F.array().cast(CONDITIONS)).otherwise(state(F.lit("solid"))).alias("pre"), state(F.when(F.col("p_size") % 5 == 0, "odd").otherwise("solid")).alias("post"))
    ok, errors = gates.run_all([gates.gate3(nodes), gates.gate5(nodes)])
    return metrics.gate_summary(errors)


# Sinks and reports


def _folder(spark) -> str:
    return f"{graph.shared_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


@query("SELECT * FROM (VALUES ('one', 5::BIGINT), ('two', 10)) v(run_id, n)")
def stored_runs(spark, d):
    """Two runs of a table, one written again: it replaces that run only; runs are listed from the folder."""
    path, n = _folder(spark), b.table(spark, d, "nation")
    for run, most in (("one", 25), ("two", 10), ("one", 5)):
        sinks.write_run(n.filter(F.col("n_nationkey") < most), path, run)
    names = readers.runs(spark, path)
    return spark.read.parquet(path).filter(F.col("run_id").isin(*names)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT node_id, 'NEXT' AS edge_type FROM (SELECT printf('%08d', p_partkey) AS node_id FROM part)")
def stored_graph(spark, d):
    """A graph written as tables and read back, each node with its edge."""
    path, p = _folder(spark), b.table(spark, d, "part").select(F.format_string("%08d", "p_partkey").alias("node_id"))
    sinks.write_graph({"nodes": p, "edges": p.select(F.col("node_id").alias("from_id"), F.lit("z").alias("to_id"), F.lit("NEXT").alias("edge_type"))}, path)
    back = sinks.read_graph(spark, path, ("nodes", "edges"))
    return back["nodes"].join(back["edges"], F.col("node_id") == F.col("from_id")).select("node_id", "edge_type")


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, 1 + n_nationkey % 3 AS n_steps, n_nationkey % 2 = 0 AS gold, 25::BIGINT AS documents, 20::BIGINT AS valid, 80.0::DOUBLE AS valid_pct FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 7 > 0""".replace("1 + n_nationkey % 3", "(1 + n_nationkey % 3)::BIGINT"))
def json_recipes(spark, d):
    """One JSON file a recipe: broken ones are counted and left out, excluded ones go."""
    path, n = _folder(spark), b.table(spark, d, "nation")
    steps = F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 3 + 1), lambda i: F.struct(i.alias("number"), F.lit("a text").alias("text")))
    whole = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("recipe_id"), F.when(F.col("n_nationkey") % 2 == 0, True).alias("gold"), steps.alias("steps")))
    text = F.when(F.col("n_nationkey") % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    n.select(text.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    excluded = n.filter("n_nationkey % 7 = 0").select(F.col("n_nationkey").cast("string").alias("recipe_id"))
    found = readers.recipes(spark, path, excluded)
    total = metrics.schema_valid(readers.json_documents(spark, path, schema.RECIPE))
    return readers.steps_of(found).groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n_steps")).join(found.select("recipe_id", "gold"), "recipe_id").select(F.col("recipe_id").cast("long").alias("n_nationkey"), "n_steps", "gold").join(total, F.lit(True))


_LONG = "SELECT '{section}' AS section, '{name}' AS name, {value}::DOUBLE AS value FROM r"


@query("WITH r AS (SELECT l.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN 'from_scratch' ELSE 'corrected' END AS mode, quality = 1 AS gold, coalesce(n_chars >= 400, false) AS auto, CASE WHEN l.doc_id % 5 <> 0 THEN (l.doc_id % 97)::DOUBLE END AS s FROM labels l LEFT JOIN documents d USING (doc_id)) " + " UNION ALL ".join(_LONG.format(section=s, name=n, value=v) for s, n, v in (
    ("accuracy all", "steps", "count(*)"), ("accuracy all", "scope_agreement_pct", "round(100.0::DOUBLE * count(*) FILTER (WHERE auto = gold) / count(*), 1)"), ("accuracy all", "wrongly_kept", "count(*) FILTER (WHERE auto AND NOT gold)"),
    ("effort", "scope_fixes", "count(*) FILTER (WHERE auto <> gold)"), ("effort", "total_edits", "count(*) FILTER (WHERE auto <> gold)"),
    ("time corrected", "steps_timed", "count(s) FILTER (WHERE mode = 'corrected')"), ("time corrected", "median_seconds_per_step", "round(median(s) FILTER (WHERE mode = 'corrected'), 1)"))))
def correction_report(spark, d):
    """Sections of the report on corrections as rows (section, name, value)."""
    r = b.reviews(spark, d)
    auto, gold = F.coalesce(F.col("auto") == 1, F.lit(False)), F.col("quality") == 1
    none = {f"{s}_{k}": F.lit(0) for s in ("pre_conditions", "post_conditions") for k in ("tp", "fp", "fn")}
    rows = r.withColumns({"auto_in_scope": auto, "gold_in_scope": gold, "scope_agrees": auto == gold, "fields_changed": F.array().cast("array<string>"), "unchanged": auto == gold, "unchanged_ignoring_wording": auto == gold, **none})
    wanted = {"accuracy all": ("steps", "scope_agreement_pct", "wrongly_kept"), "effort": ("scope_fixes", "total_edits"), "time corrected": ("steps_timed", "median_seconds_per_step")}
    keep = None
    for section, names in wanted.items():
        test = (F.col("section") == section) & F.col("name").isin(*names)
        keep = test if keep is None else keep | test
    return metrics.correction(rows).filter(keep)
