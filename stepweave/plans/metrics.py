"""Evaluation: what extraction, verification and fusion gave, and how far reviewers had to correct it.

Every block is one aggregation; accuracy over all steps, corrected ones and those from scratch is one pass with grouping
sets. Ratios are rounded like the reports show them; the counts behind them are there too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.operators.dims import resolve_join

FIELDS = ("node_type", "action_phrase", "pre_conditions", "post_conditions", "tools", "has_safety_bound")
KEY = ["recipe_id", "step_number"]


def ingest_stats(parsed: DataFrame) -> DataFrame:
    kept, dropped = F.sum(F.size("steps")), F.sum("dropped")
    return parsed.agg(F.count(F.lit(1)).alias("recipes"), F.count_if("enough").alias("recipes_enough"), kept.alias("steps_kept"), dropped.alias("steps_dropped"), tx.percent_or_zero(dropped, kept + dropped).alias("junk_drop_pct"))


def schema_valid(documents: DataFrame) -> DataFrame:
    """documents, valid, valid_pct for a permissive read with `_bad`."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("_bad").isNull())
    return documents.agg(n.alias("documents"), ok.alias("valid"), tx.percent_or_zero(ok, n).alias("valid_pct"))


def verdict_histogram(verdicts: DataFrame) -> DataFrame:
    """First-pass verdicts: one row with counts and percentages."""
    n = F.count(F.lit(1))
    parts = {v: F.count_if(F.col("verdict") == v) for v in ("accept", "revise", "reject")}
    return verdicts.filter("pass = 1").agg(n.alias("verdicts"), *[c.alias(v) for v, c in parts.items()], *[tx.percent_or_zero(c, n).alias(f"{v}_pct") for v, c in parts.items()])


def extraction_quality(checked: DataFrame, known: list[float]) -> DataFrame:
    """Actions with their text (verify.checks): grounded spans, valid labels, invented temperatures."""
    n = F.count(F.lit(1))
    grounded = F.count_if(F.contains("text", F.col("source_span")))
    valid = F.count_if(F.forall(F.concat("pre", "post"), lambda c: F.coalesce(c["k2_label"].isin(*tx.LABELS), F.lit(False))))
    texts = nested.free_texts(F.col("action_phrase"), F.col("source_span"), F.col("pre"), F.col("post"), F.col("timing.deadline"))
    invented = F.sum(F.size(nested.invented_temperatures(F.col("temperature_c"), texts, F.col("text"), known)))
    return checked.agg(n.alias("actions"), grounded.alias("grounded"), tx.percent_or_zero(grounded, n).alias("grounded_pct"), valid.alias("labels_valid"), tx.percent_or_zero(valid, n).alias("labels_valid_pct"), F.coalesce(invented, F.lit(0)).alias("invented_temperatures"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = ("NEXT", "REQUIRES", "HAS_SAFETY_BOUND", "INGREDIENT_OF", "USES_TOOL")
    by = edges.agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("edge_type") == k).alias(k.lower()) for k in kinds])
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n_recipes") > 1).alias("shared")).join(by, F.lit(True))


def alias_accuracy(gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """gold (alias, canonical_gold) through the resolver: pairs, right, accuracy_pct."""
    rows = resolve_join(gold.withColumnRenamed("alias", "name"), "name", aliases)
    right = F.count_if(F.col("canonical") == F.col("canonical_gold"))
    return rows.agg(F.count(F.lit(1)).alias("pairs"), right.alias("right"), tx.percent(right, F.count(F.lit(1))).alias("accuracy_pct"))


def non_canonical(nodes: DataFrame, canonical: list[str]) -> DataFrame:
    """Entity ids of nodes that no dimension knows, each once."""
    return nodes.select(F.explode(F.concat("pre", "post")).alias("c")).select(F.col("c.entity_id").alias("entity_id")).distinct().filter(~F.col("entity_id").isin(*canonical)).orderBy("entity_id")


def gate_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("gate").agg(F.count(F.lit(1)).alias("errors")).orderBy("gate")


def _equal(field: str) -> Column:
    a, g = F.col(f"auto.{field}"), F.col(f"gold.{field}")
    if field.endswith("conditions"):
        return nested.condition_pairs(a) == nested.condition_pairs(g)
    if field == "tools":
        return nested.same_set(a, g)
    if field == "action_phrase":
        return tx.same_phrase(a, g)
    return a.eqNullSafe(g)


def compare_steps(gold: DataFrame, auto: DataFrame) -> DataFrame:
    """One row for each reviewed step: scope outcome, fields changed, tp/fp/fn of states, numbers of actions, time.

    auto has (KEY, status, auto, auto_actions); a step without it is missing.
    """
    rows = gold.withColumn("gold", F.col("expected")).join(auto, KEY, "left")
    rows = rows.withColumn("auto_status", F.coalesce("status", F.lit("missing")))
    rows = rows.withColumns({"auto_in_scope": F.col("auto_status") == "kept", "gold_in_scope": F.coalesce("gold.in_scope", F.lit(True))})
    both = F.col("auto_in_scope") & F.col("gold_in_scope")
    changed = F.array_compact(F.array(*[F.when(~_equal(f), F.lit(f)) for f in FIELDS]))
    rows = rows.withColumn("fields_changed", F.when(both, changed).otherwise(F.array().cast("array<string>")))
    neither = ~F.col("auto_in_scope") & ~F.col("gold_in_scope")
    wording = F.size(F.array_remove("fields_changed", "action_phrase")) == 0
    counts = {}
    for side in ("pre_conditions", "post_conditions"):
        for name, c in zip(("tp", "fp", "fn"), nested.set_counts(nested.condition_pairs(F.col(f"auto.{side}")), nested.condition_pairs(F.col(f"gold.{side}"))), strict=True):
            counts[f"{side}_{name}"] = F.when(both, c)
    acts = nested.actions_of(F.col("gold"), F.col("sub_steps"))
    rows = rows.withColumns({
        "mode": F.coalesce("mode", F.lit("corrected")), "scope_agrees": F.col("auto_in_scope") == F.col("gold_in_scope"), **counts,
        "unchanged": (both & (F.size("fields_changed") == 0)) | neither, "unchanged_ignoring_wording": (both & wording) | neither,
        "gold_actions": F.when(F.col("gold_in_scope"), F.size(F.filter(acts, lambda a: F.coalesce(a["in_scope"], F.lit(True))))).otherwise(0), "auto_actions": F.coalesce("auto_actions", F.lit(0)).cast("int"),
    }).withColumn("split_agrees", F.col("gold_actions") == F.col("auto_actions"))
    return rows.drop("expected", "gold", "auto", "status")


def accuracy(rows: DataFrame) -> DataFrame:
    """mode (null: all steps): agreement on scope, each field's accuracy, micro-averaged scores of states, unchanged steps."""
    n, kept = F.count(F.lit(1)), F.count_if(F.col("auto_in_scope") & F.col("gold_in_scope"))
    aggs = [n.alias("steps"), tx.percent(F.count_if("scope_agrees"), n).alias("scope_agreement_pct"), F.count_if(F.col("auto_in_scope") & ~F.col("gold_in_scope")).alias("wrongly_kept"), F.count_if(~F.col("auto_in_scope") & F.col("gold_in_scope")).alias("wrongly_dropped"), kept.alias("steps_kept_by_both")]
    for f in FIELDS:
        right = F.count_if(F.col("auto_in_scope") & F.col("gold_in_scope") & ~F.array_contains("fields_changed", f))
        aggs.append(tx.percent(right, kept).alias(f"{f}_pct"))
    for side in ("pre_conditions", "post_conditions"):
        tp, fp, fn = (F.coalesce(F.sum(f"{side}_{k}"), F.lit(0)) for k in ("tp", "fp", "fn"))
        for name, v in zip(("precision", "recall", "f1"), tx.precision_recall_f1(tp, fp, fn), strict=True):
            aggs.append(F.round(v, 3).alias(f"{side}_{name}"))
    aggs += [tx.percent(F.count_if(c), n).alias(f"{c}_pct") for c in ("unchanged", "unchanged_ignoring_wording")]
    return rows.rollup("mode").agg(*aggs)


def effort(rows: DataFrame) -> DataFrame:
    fixes, n = F.count_if(~F.col("scope_agrees")), F.count(F.lit(1))
    by = {f: F.count_if(F.array_contains("fields_changed", f)) for f in FIELDS}
    total = F.sum(F.size("fields_changed")) + fixes
    return rows.agg(total.alias("total_edits"), F.round(total / n, 2).alias("edits_per_step"), fixes.alias("scope_fixes"), *[c.alias(f) for f, c in by.items()])


def edits_by_field(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("fields_changed").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("edits"))


def time_stats(rows: DataFrame) -> DataFrame:
    s = F.col("seconds_spent")
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("steps"), F.count(s).alias("steps_timed"), F.round(F.sum(s) / 60, 1).alias("total_minutes"), F.round(F.avg(s), 1).alias("mean_seconds_per_step"), F.round(F.median(s), 1).alias("median_seconds_per_step"))


def savings(times: DataFrame, total_steps: int) -> DataFrame:
    """Seconds and share that corrections save against work from scratch; both are rounded before the share is taken."""
    at = lambda m: F.max(F.when(F.col("mode") == m, F.col("mean_seconds_per_step")))
    row = times.agg(at("corrected").alias("c"), at("from_scratch").alias("s")).filter("c is not null and s is not null")
    per = F.col("s") - F.col("c")
    return row.select(F.round(per, 1).alias("seconds_saved_per_step"), tx.percent(F.round(per), F.round("s")).alias("pct_saved_per_step"), F.round(F.col("s") * total_steps / 60, 1).alias("by_hand_minutes"), F.round(F.col("c") * total_steps / 60, 1).alias("corrected_minutes"))


def nodes_of_steps(provenance: DataFrame) -> DataFrame:
    """recipe_id, step_number, node_id: of a step's observations the last one counts."""
    return provenance.groupBy(*KEY).agg(F.max_by("node_id", "seq").alias("node_id"))


def safety_coverage(gold: DataFrame, provenance: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reviewed steps that need a safety bound, and those whose node in the graph has one."""
    wanted = gold.filter("expected.in_scope and expected.has_safety_bound").select(*KEY)
    rows = wanted.join(nodes_of_steps(provenance), KEY, "left").join(nodes.select("node_id", (F.size("safety_bounds") > 0).alias("_has")), "node_id", "left")
    has = F.count_if(F.coalesce("_has", F.lit(False)))
    return rows.agg(F.count(F.lit(1)).alias("safety_expected"), has.alias("safety_present"), tx.percent(has, F.count(F.lit(1))).alias("safety_pct"))


def in_rows(block: DataFrame, section: str) -> DataFrame:
    """section, name, value of a block of one row, a row for each of its numbers."""
    numbers = [c for c, t in block.dtypes if t in ("int", "bigint", "double") or t.startswith("decimal")]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numbers])
    return block.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")


def correction(rows: DataFrame, queue: DataFrame | None = None, gold: DataFrame | None = None, version: str = "", run_id: str = "", auto_graph: tuple[DataFrame, DataFrame] | None = None, final_graph: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The whole report on compared steps as rows (section, name, value): accuracy over all steps and by mode, effort, time
    by mode, savings; with the queue and gold coverage; with graphs (nodes, edges) their summaries and difference."""
    by_mode = accuracy(rows)
    parts = [in_rows(by_mode.filter(F.col("mode").isNull()), "accuracy all")]
    times = time_stats(rows)
    for mode in ("corrected", "from_scratch"):
        parts += [in_rows(by_mode.filter(F.col("mode") == mode), f"accuracy {mode}"), in_rows(times.filter(F.col("mode") == mode), f"time {mode}")]
    parts += [in_rows(effort(rows), "effort")]
    if queue is not None and gold is not None:
        parts += [in_rows(savings(times, queue.count()), "savings"), in_rows(coverage(queue, gold, version, run_id), "coverage")]
    if auto_graph and final_graph:
        parts += [in_rows(graph_summary(*auto_graph), "graph auto"), in_rows(graph_summary(*final_graph), "graph final"), in_rows(graph_diff(auto_graph[0], final_graph[0]), "graph difference")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(sections: DataFrame, title: str = "Report") -> str:
    """Rows (section, name, value) as a text of one table a section: what an evaluation prints."""
    from stepweave.sources.sinks import markdown

    by: dict[str, list[dict]] = {}
    for r in sections.orderBy("section", "name").collect():  # a few numbers
        by.setdefault(r["section"], []).append({"name": r["name"], "value": r["value"]})
    return "\n".join([f"# {title}", "", *(markdown(s, rows) for s, rows in by.items())])


def coverage(queue: DataFrame, gold: DataFrame, version: str, run_id: str) -> DataFrame:
    from stepweave.operators.review import is_current

    rows = queue.join(gold.withColumn("_have", F.lit(True)).withColumn("_now", is_current(version)), KEY, "left")
    n, done = F.count(F.lit(1)), F.count_if(F.coalesce("_now", F.lit(False)))
    other = F.count_if(F.coalesce(F.col("_now") & (F.col("seeded_from_run") != "") & (F.col("seeded_from_run") != run_id), F.lit(False)))
    return rows.agg(F.count_distinct("recipe_id").alias("recipes_in_queue"), n.alias("steps_in_queue"), done.alias("steps_reviewed"), tx.percent(done, n).alias("steps_reviewed_pct"), F.count_if(F.col("_have") & ~F.col("_now")).alias("gold_files_out_of_date"), other.alias("reviewed_against_another_run"))


def split_metrics(rows: DataFrame) -> DataFrame:
    both = (F.col("gold_actions") > 0) & (F.col("auto_actions") > 0)
    s = F.col("split_seconds_spent")
    return rows.agg(
        F.count_if("split_checked").alias("steps_checked"), F.count_if(F.col("gold_actions") > 1).alias("steps_split_by_reviewer"), F.count_if(F.col("auto_actions") > 1).alias("steps_split_by_pipeline"), F.sum("gold_actions").alias("actions_reviewer"), F.sum("auto_actions").alias("actions_pipeline"),
        F.count_if(both).alias("steps_kept_by_both"), tx.percent(F.count_if(both & F.col("split_agrees")), F.count_if(both)).alias("action_count_agrees_pct"), F.round(F.sum(s) / 60, 1).alias("split_minutes"), F.round(F.avg(s), 1).alias("mean_split_seconds_per_checked_step"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n_recipes") > 1).alias("shared")).join(edges.agg(F.count_if(F.col("edge_type") == "NEXT").alias("next_edges")), F.lit(True))


def graph_diff(auto: DataFrame, final: DataFrame) -> DataFrame:
    """Node ids of two graphs: in both, only in one, and the share of the first that stays."""
    rows = auto.select("node_id").distinct().withColumn("_a", F.lit(True)).join(final.select("node_id").distinct().withColumn("_f", F.lit(True)), "node_id", "full_outer")
    a, f = F.col("_a").isNotNull(), F.col("_f").isNotNull()
    return rows.agg(F.count_if(a & f).alias("kept"), F.count_if(a & ~f).alias("removed"), F.count_if(~a & f).alias("added"), tx.percent(F.count_if(a & f), F.count_if(a)).alias("kept_pct"))


def gold_comparison(rows: DataFrame) -> DataFrame:
    """Precision and recall of node types: a mismatch counts against both, a missing step against recall."""
    both = F.col("auto_in_scope") & F.col("gold_in_scope")
    same = both & ~F.array_contains("fields_changed", "node_type")
    tp, wrong, missing = F.count_if(same), F.count_if(both & ~same), F.count_if(~F.col("auto_in_scope") & F.col("gold_in_scope"))
    p, r, _ = tx.precision_recall_f1(tp, wrong, wrong + missing)
    return rows.agg(tp.alias("tp"), wrong.alias("fp"), (wrong + missing).alias("fn"), p.alias("precision"), r.alias("recall"))
