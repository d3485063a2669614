"""Review of steps by people: keyed upserts, status, projections of what the pipeline did, active time, gold to actions.

There is no transactional table format here: an upsert reads, unites, ranks and overwrites. Batches of edits carry
`edited_at`, and of a key's edits the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.functions.nested import CONDITIONS
from stepweave.operators.dims import Dims

KEY = ["recipe_id", "step_number"]


def is_current(version: str) -> Column:
    return F.coalesce(F.col("definition_version") == version, F.lit(False))


def status(version: str) -> Column:
    return F.when(F.col("expected").isNull(), "open").when(~is_current(version), "outdated").otherwise("done")


def first_open(queue: DataFrame, gold: DataFrame, version: str) -> DataFrame:
    """The first step of the queue (KEY) that has no current review: one row, or none."""
    done = gold.filter(status(version) == "done").select(*KEY)
    return queue.join(done, KEY, "left_anti").orderBy(*KEY).limit(1)


def visible(actions: DataFrame, branch: str | None = None, node_types: tuple[str, ...] = (), blind: DataFrame | None = None) -> DataFrame:
    """Actions that a reviewer sees: of one branch or all, of some types or all, without the steps (KEY) to be done blind."""
    rows = actions.filter(F.col("recipe_id") == branch) if branch else actions
    rows = rows.filter(F.col("node_type").isin(*node_types)) if node_types else rows
    return rows.join(blind.select(*KEY), KEY, "left_anti") if blind is not None else rows


def clean_expected(expected: Column, aliases: Column) -> Column:
    conditions = lambda c: F.transform(nested.clean_conditions(F.transform(c, lambda x: F.struct(x["entity_id"].alias("entity_id"), x["k2_label"].alias("physics_state"), x["k2_label"].alias("k2_label"))), aliases), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["k2_label"].alias("k2_label")))
    return F.struct(
        F.coalesce(expected["node_type"], F.lit("Process")).alias("node_type"),
        tx.strip(F.coalesce(expected["action_phrase"], F.lit(""))).alias("action_phrase"),
        conditions(expected["pre_conditions"]).alias("pre_conditions"),
        conditions(expected["post_conditions"]).alias("post_conditions"),
        nested.clean_names(expected["tools"], aliases).alias("tools"),
        F.coalesce(expected["has_safety_bound"], F.lit(False)).alias("has_safety_bound"),
        F.coalesce(expected["in_scope"], F.lit(True)).alias("in_scope"),
    )


def save_gold(gold: DataFrame, edits: DataFrame, version: str) -> DataFrame:
    """gold after edits (KEY, expected, annotator, mode, seconds, edited_at, notes, seeded_from_run).

    The last edit of a key sets its row; time adds up over its edits and, if the old row is of this version, over that
    too. An earlier split stays only with such a row.
    """
    last = Window.partitionBy(*KEY).orderBy(F.desc("edited_at"))
    spent = F.sum(F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0))).over(Window.partitionBy(*KEY))
    new = edits.withColumns({"_turn": F.row_number().over(last), "_spent": spent}).filter("_turn = 1")
    old = gold.select(*KEY, F.col("seconds_spent").alias("_old"), F.col("sub_steps").alias("_subs"), F.col("split_checked").alias("_checked"), F.col("split_seconds_spent").alias("_split"), is_current(version).alias("_current"))
    joined = new.join(old, KEY, "left")
    stays = lambda c, empty: F.when(F.coalesce("_current", F.lit(False)), F.coalesce(c, empty)).otherwise(empty)
    kind = dict(gold.dtypes)
    value = {
        "expected": F.col("expected"), "sub_steps": stays(F.col("_subs"), F.array().cast(kind["sub_steps"])), "split_checked": stays(F.col("_checked"), F.lit(False)), "split_seconds_spent": stays(F.col("_split"), F.lit(None).cast("double")),
        "annotator": F.col("annotator"), "annotation_date": F.col("edited_at").cast("date").cast("string"), "notes": F.col("notes"), "mode": F.col("mode"),
        "seconds_spent": F.col("_spent") + stays(F.col("_old"), F.lit(0.0)), "seeded_from_run": F.col("seeded_from_run"), "definition_version": F.lit(version),
    }
    row = joined.select(*KEY, *[value[c].cast(kind[c]).alias(c) for c in gold.columns if c not in KEY])
    return gold.join(edits.select(*KEY).distinct(), KEY, "left_anti").unionByName(row)


def save_split(gold: DataFrame, splits: DataFrame, version: str) -> DataFrame:
    """gold after splits (KEY, actions, seconds): two or more actions are stored, one clears; only current rows, and only
    named actions, can be split."""
    fine = F.forall("actions", lambda a: tx.strip(F.coalesce(a["action_phrase"], F.lit(""))) != "")
    joined = gold.join(splits.select(*KEY, "actions", F.col("seconds").alias("_s")), KEY, "left")
    asked = F.col("actions").isNotNull()
    checked = F.when(asked, F.assert_true(is_current(version) & fine, "a split needs a current review and named actions").isNull()).otherwise(True)
    some = F.when(F.size("actions") >= 2, F.col("actions")).otherwise(F.array().cast(dict(gold.dtypes)["sub_steps"]))
    return joined.withColumns({
        "sub_steps": F.when(asked & checked, some).otherwise(F.col("sub_steps")),
        "split_checked": F.when(asked, True).otherwise(F.col("split_checked")),
        "split_seconds_spent": F.when(asked, F.coalesce("split_seconds_spent", F.lit(0.0)) + F.greatest("_s", F.lit(0.0))).otherwise(F.col("split_seconds_spent")),
    }).select(gold.columns)


def save_labels(labels: DataFrame, edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pair labels after edits (the label's columns and edited_at), by pair_id; time carries over if the old label's nodes
    are still in the graph. Sorted by pair_id."""
    from stepweave.operators.merge import current_labels

    last = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("edited_at")))
    new = edits.withColumn("pair_id", tx.pair_id(F.col("a_id"), F.col("b_id"))).withColumn("_turn", last).filter("_turn = 1").drop("_turn")
    old = current_labels(labels, nodes).select("pair_id", F.col("seconds_spent").alias("_old"))
    new = new.join(old, "pair_id", "left").withColumn("seconds_spent", F.greatest(F.coalesce("seconds_spent", F.lit(0.0)), F.lit(0.0)) + F.coalesce("_old", F.lit(0.0)))
    return labels.join(new.select("pair_id"), "pair_id", "left_anti").unionByName(new.select(labels.columns)).orderBy("pair_id")


def delete_labels(labels: DataFrame, pair_ids: DataFrame) -> DataFrame:
    return labels.join(pair_ids.select("pair_id"), "pair_id", "left_anti").orderBy("pair_id")


def work_time(ticks: DataFrame, by: list[str], key: str, at: str, cap: float, order: list[str] = ()) -> DataFrame:
    """ticks with `active`: seconds since the key was taken up, gaps cut at cap, by session.

    Another key starts at 0, and so does a key that is taken up again. `at` is in seconds.
    """
    w = Window.partitionBy(*by).orderBy(at, *order)
    changed = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = ticks.withColumn("_new", F.when(first, 1).otherwise(changed)).withColumn("_gap", tx.clamp(F.col(at) - F.lag(at).over(w), 0.0, cap))
    marked = marked.withColumn("_spell", F.sum("_new").over(w))
    return marked.withColumn("active", F.sum(F.when(F.col("_new") == 1, 0.0).otherwise(F.col("_gap"))).over(Window.partitionBy(*by, "_spell").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_gap", "_spell")


def auto_actions(scoped: DataFrame, verdicts: DataFrame, aliases: Column) -> DataFrame:
    """What the pipeline did with each action: status kept or dropped, reason, and `expected` in the shape of a review."""
    key = [*KEY, "sub_step"]
    from stepweave.sources.readers import latest_verdicts

    rows = scoped.join(latest_verdicts(verdicts).select(*key, F.col("verdict").alias("_v")), key, "left")
    rejected = F.coalesce(F.col("_v") == "reject", F.lit(False))
    conditions = lambda c: F.transform(nested.clean_conditions(F.col(c), aliases), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["k2_label"].alias("k2_label")))
    expected = F.struct(
        F.col("node_type"), F.col("action_phrase"), conditions("pre").alias("pre_conditions"), conditions("post").alias("post_conditions"), nested.clean_names(F.col("tools"), aliases).alias("tools"),
        ((F.col("node_type") == "Process") & tx.is_thermal(F.col("action_phrase"))).alias("has_safety_bound"), (F.col("reason").isNull() & ~rejected).alias("in_scope"),
    )
    reason = F.when(rejected, "critic rejected the extraction").otherwise(F.coalesce("reason", F.lit("")))
    return rows.select(*key, F.when(rejected | F.col("reason").isNotNull(), "dropped").otherwise("kept").alias("status"), reason.alias("reason"), expected.alias("expected"))


def auto_steps(actions: DataFrame) -> DataFrame:
    """One row a step: its first kept action (else its first), and n_actions kept. Only sub-steps up to the first gap."""
    from stepweave.sources.readers import contiguous

    lead = F.struct((F.col("status") != "kept").alias("later"), "sub_step")
    return contiguous(actions).groupBy(*KEY).agg(F.min_by(F.struct("status", "reason", "expected"), lead).alias("f"), F.count_if(F.col("status") == "kept").alias("auto_actions")).select(*KEY, "f.status", "f.reason", F.col("f.expected").alias("auto"), "auto_actions")


def gold_actions(gold: DataFrame, steps: DataFrame, dims: Dims, extracted: DataFrame | None = None) -> DataFrame:
    """In-scope actions of reviewed, in-scope steps, as the fusion takes them, with `thermal` from the reviewer's heat tick.

    An unsplit step quotes the extraction's span where the text has it, else the whole text; a split step the whole text.
    The extraction's timing goes to the unsplit step, or to the first heated action of a split one.
    """
    acts = nested.actions_of(F.col("expected"), F.col("sub_steps"))
    rows = gold.filter("expected.in_scope").join(steps, KEY).withColumns({"_acts": acts, "_split": F.size("sub_steps") > 0})
    if extracted is None:
        rows = rows.withColumns({"_span": F.lit(None).cast("string"), "_timing": F.lit(None).cast("struct<duration_s:double,deadline:string>")})
    else:
        rows = rows.join(extracted.filter("sub_step = 1").select(*KEY, F.col("source_span").alias("_span"), F.col("timing").alias("_timing")), KEY, "left")
    heated = F.array_position(F.transform("_acts", lambda a: F.coalesce(a["has_safety_bound"], F.lit(False))), True)
    rows = rows.withColumn("_timed", F.when(F.col("_split"), heated).otherwise(1))
    rows = rows.select("*", F.posexplode("_acts").alias("_i", "a")).filter("a.in_scope")
    states = lambda c: F.transform(F.col(f"a.{c}"), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["k2_label"].alias("physics_state"), x["k2_label"].alias("k2_label"))).cast(CONDITIONS)
    entities = F.transform(F.concat("a.pre_conditions", "a.post_conditions"), lambda c: c["entity_id"])
    grounded = ~F.col("_split") & (F.coalesce("_span", F.lit("")) != "") & F.contains("text", F.coalesce("_span", F.lit("")))
    return rows.select(
        "recipe_id", "step_number", (F.col("_i") + 1).alias("sub_step"), F.col("a.node_type").alias("node_type"), F.col("a.action_phrase").alias("action_phrase"), states("pre_conditions").alias("pre"), states("post_conditions").alias("post"),
        F.when(F.col("_i") + 1 == F.col("_timed"), F.col("_timing")).alias("timing"), F.array_distinct(F.filter(entities, lambda e: e.isin(*dims.ingredients))).alias("ingredients"), F.col("a.tools").alias("tools"),
        F.when(grounded, F.col("_span")).otherwise(F.col("text")).alias("source_span"), F.lit(True).alias("in_scope"), F.lit(1.0).alias("confidence"), F.concat(F.lit("human/"), "annotator").alias("extractor_model"),
        F.lit("accept").alias("verdict"), F.col("a.has_safety_bound").alias("thermal"),
    )
