"""The engine's verbs from a shell: python -m stepweave.cli VERB ...

Tables are Parquet, dimension files a folder (see dims.from_folder), results go under --out. Models are named as
module:function and take what verify and extract give them; without one the rules alone decide.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import dims as dm
from stepweave.operators import gates, merge, review, scope, verify
from stepweave.plans import build, metrics
from stepweave.plans.query_api import GraphQuery
from stepweave.sources import readers, sinks


def model(name: str | None):
    """The callable that module:function names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def steps(spark: SparkSession, path: str) -> DataFrame:
    return readers.steps_of(spark.read.parquet(path))


def ingest(spark, a, d):
    good, bad = (rows.withColumn("recipe_id", F.col("page_id").cast("string")) for rows in build.ingest(readers.pages(spark, a.pages)))
    good.write.mode("overwrite").parquet(f"{a.out}/recipes")
    bad.write.mode("overwrite").parquet(f"{a.out}/quarantine")
    sinks.write_report(metrics.ingest_stats(good.unionByName(bad)), f"{a.out}/ingest_stats")


def extract(spark, a, d):
    verify.extract(steps(spark, a.recipes), [(n, model(n)) for n in a.models], d).write.mode("overwrite").parquet(f"{a.out}/actions")


def verdicts(spark, a, d):
    kept, found = verify.verify_with_revision(readers.actions(spark, a.actions), steps(spark, a.recipes), d, [(n, model(n)) for n in a.models], model(a.gate), [(n, model(n)) for n in a.critics], a.threshold, bool(a.models))
    kept.write.mode("overwrite").parquet(f"{a.out}/kept")
    found.write.mode("overwrite").parquet(f"{a.out}/verdicts")


def fuse(spark, a, d):
    g, report, goal = build.fuse_verified(readers.actions(spark, a.actions), spark.read.parquet(a.verdicts), d)
    build.store(g, a.out)
    for name, rows in (("scope_report", report), ("goal_completion", goal), ("removed_edges", g.removed_edges), ("order_report", g.violations)):
        sinks.write_report(rows, f"{a.out}/{name}")


def validate(spark, a, d):
    t = sinks.read_graph(spark, a.graph, ("nodes", "edges", "provenance", "ingredient_nodes", "tool_nodes"))
    found = [gates.gate2(t["edges"]), gates.gate3(t["nodes"]), gates.gate4(t["nodes"], t["edges"]), gates.gate5(t["nodes"]), gates.gate6(t["provenance"], steps(spark, a.recipes)), gates.gate7(t["nodes"], t["provenance"], t["ingredient_nodes"], t["tool_nodes"], d)]
    ok, errors = gates.run_all(found)
    sinks.write_report(errors, f"{a.out}/validation_report")
    print("passed" if ok else "failed")
    return int(not ok)


def check(spark, a, d):
    rows = [r.asDict() for r in gates.check_rules(d, spark, steps(spark, a.recipes)).collect()]
    print(sinks.markdown("Problems of the dimension files", rows))
    return int(bool(rows))


def finalise(spark, a, d):
    labels = spark.read.parquet(a.labels) if a.labels else None
    g, report = build.finalise(readers.gold(spark, a.gold), steps(spark, a.recipes), d, labels, a.allow_unreviewed)
    build.store(g, a.out)
    print(json.dumps(report))


def conflicts(spark, a, d):
    t = sinks.read_graph(spark, a.graph, ("nodes", "edges"))
    found = merge.conflicts(t["nodes"], t["edges"], spark.read.parquet(a.labels))
    print(json.dumps(found))
    return int(bool(found))


def evaluate(spark, a, d):
    gold, queue = readers.gold(spark, a.gold), steps(spark, a.recipes)
    scoped = scope.apply_scope(readers.actions(spark, a.actions), d)
    auto = review.auto_steps(review.auto_actions(scoped, spark.read.parquet(a.verdicts), d.alias_map()))
    rows = metrics.compare_steps(gold.filter(review.is_current(d.definition_version)), auto)
    sections = metrics.correction(rows, queue, gold, d.definition_version, a.run or "")
    sinks.write_report(sections, f"{a.out}/correction")
    sinks.write_step_csv(rows, f"{a.out}/correction_steps")
    print(metrics.report(sections, "Corrections"))


def query(spark, a, d):
    t = sinks.read_graph(spark, a.graph, ("nodes", "edges"))
    q = GraphQuery(t["nodes"], t["edges"], d.preferences_df(spark))
    if a.node:
        print(json.dumps({"next": q.next_node_ids(a.node, a.branch), "required_before": [r.asDict() for r in q.required_before(a.node).collect()]}))
    elif a.branch:
        print(json.dumps({"walk": q.walk(a.branch), "preferences": [r["choice"] for r in q.preferences(a.branch).collect()]}))
    else:
        print(json.dumps(q.branches()))


#: Verb -> what it does and the options it needs beside --config and --out (a trailing ? marks those that may be left out).
VERBS = {
    "ingest": (ingest, ("pages",)), "extract": (extract, ("recipes", "models*")), "verify": (verdicts, ("recipes", "actions", "models*", "critics*", "gate?")), "fuse": (fuse, ("actions", "verdicts")), "validate": (validate, ("graph", "recipes")),
    "check": (check, ("recipes",)), "finalise": (finalise, ("gold", "recipes", "labels?")), "conflicts": (conflicts, ("graph", "labels")), "eval": (evaluate, ("gold", "recipes", "actions", "verdicts", "run?")), "query": (query, ("graph", "branch?", "node?")),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stepweave", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, (run, options) in VERBS.items():
        p = verbs.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--out", default=".")
        for o in options:
            p.add_argument(f"--{o.rstrip('?*')}", required=o[-1] not in "?*", **({"nargs": "*", "default": []} if o[-1] == "*" else {}))
        if name == "verify":
            p.add_argument("--threshold", type=float, default=0.8)
        if name == "finalise":
            p.add_argument("--allow-unreviewed", action="store_true")
        p.set_defaults(do=run)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("stepweave").getOrCreate()
    return a.do(spark, a, dm.from_folder(a.config)) or 0


if __name__ == "__main__":
    sys.exit(main())
