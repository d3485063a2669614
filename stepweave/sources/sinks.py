"""Sinks: tables, one-document JSON, a Cypher script and its statements, CSV and JSON reports, a graph database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels that the script creates, and the properties that name their nodes: what a database needs constraints for.
GRAPH_LABELS = ("Process", "Transfer", "Plate", "Ingredient", "Tool", "SafetyBound")
INDEXED = (("Process", "canonical_action"), ("Transfer", "canonical_action"), ("Plate", "canonical_action"), ("Process", "node_type"))


def schema_statements() -> list[str]:
    """One uniqueness constraint a label, and the indexes."""
    unique = [f"CREATE CONSTRAINT {label.lower()}_id IF NOT EXISTS FOR (n:{label}) REQUIRE n.node_id IS UNIQUE" for label in GRAPH_LABELS]
    return unique + [f"CREATE INDEX {label.lower()}_{prop} IF NOT EXISTS FOR (n:{label}) ON (n.{prop})" for label, prop in INDEXED]


def write_graph(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """A graph as one Parquet table for each part (nodes, edges, provenance, ...)."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: tuple[str, ...] = ("nodes", "edges", "provenance")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A snapshot of a table under its run; another write of the run replaces that run only."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, one JSON text of a small graph. For graphs of any size use write_graph or json_lines."""
    fold = lambda df, name, by: df.agg(F.array_sort(F.collect_list(F.struct(*by, F.to_json(F.struct(*df.columns)).alias("j")))).alias(name))
    n, e = fold(nodes, "n", ["node_id"]).first()[0], fold(edges, "e", ["edge_type", "from_id", "to_id"]).first()[0]
    text = '{"nodes":[' + ",".join(r["j"] for r in n) + '],"edges":[' + ",".join(r["j"] for r in e) + "]}"
    return nodes.sparkSession.createDataFrame([(text,)], "document string")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def escape(value: Column) -> Column:
    return F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def property_map(values: list[tuple[str, Column, str]]) -> Column:
    """{name: value, ...} without nulls. Kinds: text, number, bool, list (each value once)."""
    quote = lambda c: F.concat(F.lit("'"), escape(c), F.lit("'"))
    kinds = {
        "text": quote,
        "number": lambda c: c.cast("string"),
        "bool": lambda c: F.lower(c.cast("string")),
        "list": lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_distinct(c), quote), ", "), F.lit("]")),
    }
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), kinds[kind](c))) for name, c, kind in values]), F.lit("}"))


def cypher_rows(nodes: DataFrame, edges: DataFrame, ingredient_nodes: DataFrame, tool_nodes: DataFrame, bounds: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """section, place, statement: nodes, ingredients, tools, bounds, edges. Each is a MERGE that can run again."""
    c = F.col
    if provenance is not None:
        branches = provenance.groupBy("node_id").agg(F.array_sort(F.collect_set("recipe_id")).alias("source_recipe_ids"))
        nodes = nodes.join(branches, "node_id", "left")
    have = lambda name, kind: [(name, c(name), kind)] if name in nodes.columns else []
    props = [("node_id", c("node_id"), "text"), ("node_type", c("node_type"), "text"), ("action_phrase", c("action_phrase"), "text"), ("canonical_action", c("canonical_action"), "text"), ("mean_confidence", F.round("mean_confidence", 4), "number"), *have("source_recipe_ids", "list")]
    if "variant_phrases" in nodes.columns:
        props.append(("variant_phrases", F.when(F.size("variant_phrases") > 0, c("variant_phrases")), "list"))
    if "timing" in nodes.columns:
        props += [("timing_duration_s", c("timing.duration_s"), "number"), ("timing_deadline", F.when(c("timing.deadline") != "", c("timing.deadline")), "text")]
    merge = lambda label, key, p: F.concat(F.lit("MERGE (n:"), label, F.lit(" {node_id: '"), escape(key), F.lit("'}) SET n += "), p, F.lit(";"))
    named = lambda df, label, section: df.select(F.lit(section).alias("section"), c("id").alias("place"), merge(F.lit(label), c("id"), property_map([("name", c("name"), "text"), ("node_id", c("id"), "text")])).alias("statement"))
    bound_id = F.concat(F.lit("bound_"), "bound_id")
    bound_props = property_map([("node_id", bound_id, "text"), ("bound_id", c("bound_id"), "text"), ("label", c("label"), "text"), ("severity", c("severity"), "text"), ("temperature_c", c("temperature_c"), "number"), ("k2_transition", F.when(c("k2_transition") != "", c("k2_transition")), "text")])
    rel = property_map([("source_recipe_id", F.when(c("recipe_id") != "", c("recipe_id")), "text"), ("weight", F.when(c("weight") != 1.0, c("weight")), "number"), *[(k, c(k), "number" if k == "temperature_c" else "text") for k in ("rule_id", "reason", "bound_id", "temperature_c", "severity", "k2_transition")]])
    link = F.concat(F.lit("MATCH (a {node_id: '"), escape(c("from_id")), F.lit("'}), (b {node_id: '"), escape(c("to_id")), F.lit("'}) MERGE (a)-[:"), c("edge_type"), F.when(rel == "{}", "").otherwise(F.concat(F.lit(" "), rel)), F.lit("]->(b);"))
    parts = [
        nodes.select(F.lit(1).alias("section"), c("node_id").alias("place"), merge(c("node_type"), c("node_id"), property_map(props)).alias("statement")),
        named(ingredient_nodes, "Ingredient", 2),
        named(tool_nodes, "Tool", 3),
        bounds.dropDuplicates(["bound_id"]).select(F.lit(4).alias("section"), c("bound_id").alias("place"), merge(F.lit("SafetyBound"), bound_id, bound_props).alias("statement")),
        edges.select(F.lit(5).alias("section"), F.concat_ws("|", "edge_type", "from_id", "to_id", "recipe_id").alias("place"), link.alias("statement")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_cypher(rows: DataFrame, path: str) -> None:
    """The script as text files, in order across their names."""
    rows.orderBy("section", "place").select("statement").write.mode("overwrite").text(path)


def statements(script: Column) -> Column:
    """Array of a script's statements: cut at semicolons, comment lines dropped one by one, blank ones left out."""
    def clean(chunk: Column) -> Column:
        lines = F.filter(F.split(chunk, "\r?\n"), lambda x: ~x.rlike(r"(?U)^\s*//"))
        return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")

    return F.filter(F.transform(F.split(script, ";"), clean), lambda x: x != "")


def send(rows: DataFrame, connect: Callable[[], Callable[[str], None]], clear: bool = False) -> list[str]:
    """Run statements against a graph database, a connection for each partition; what failed, as messages.

    connect() runs on the executors and returns a function that runs one statement. Sections go one after the other, so
    edges find their nodes. clear first removes nodes of this engine's labels only.
    """
    errors: list[str] = []
    driver = connect() if clear else None
    for label in GRAPH_LABELS if clear else ():
        driver(f"MATCH (n:{label}) DETACH DELETE n")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            execute, failed = connect(), []
            for s in pdf["statement"]:
                try:
                    execute(s)
                except Exception as e:  # noqa: BLE001  reported, as a warning
                    failed.append(f"{type(e).__name__}: {e}: {s[:80]}")
            yield pd.DataFrame({"error": pd.Series(failed, dtype=object)})

    for section in range(1, 6):
        errors += [r[0] for r in rows.filter(F.col("section") == section).select("statement").mapInPandas(run, "error string").collect()]
    return errors


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Columns of the table of reviewed steps, in order; a list is joined by semicolons.
STEP_COLUMNS = ("recipe_id", "step_number", "mode", "auto_status", "auto_in_scope", "gold_in_scope", "scope_agrees", "fields_changed", "unchanged", "unchanged_ignoring_wording", "gold_actions", "auto_actions", "split_agrees", "seconds_spent", "seeded_from_run")


def step_table(rows: DataFrame) -> DataFrame:
    present = [c for c in STEP_COLUMNS if c in rows.columns]
    return rows.select(*[F.array_join(c, ";").alias(c) if c == "fields_changed" else F.col(c) for c in present])


def write_step_csv(rows: DataFrame, path: str) -> None:
    step_table(rows).write.mode("overwrite").option("header", True).csv(path)


def markdown(title: str, rows: list[dict]) -> str:
    """A table for a report, from a few collected rows."""
    if not rows:
        return f"## {title}\n\nNothing.\n"
    names = list(rows[0])
    show = lambda v: "n/a" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows), ""])
