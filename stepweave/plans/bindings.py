"""The driver's tables in the shapes that the operators take: branches of steps, actions, reviews, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.functions.nested import CONDITIONS
from stepweave.operators.dims import Dims

#: A small domain over the words of part names and the kinds of events.
DIMS = Dims(
    aliases={"bolts": "bolt", "small bolt": "bolt", "large bolt": "bolt", "gears": "gear", "red gear": "gear", "hot plate": "plate", "cold plate": "plate", "old rod": "rod", "new rod": "rod", "bolt": "bolt", "gear": "gear", "plate": "plate", "rod": "rod"},
    states={"new": "liquid", "old": "solid", "hot": "coagulating", "cold": "solid", "red": "scorched"},
    ingredients=("bolt", "gear", "rod"),
    utensils=("plate", "ring"),
    known_out=("gizmo", "anvil", "blue"),
    classes={"signup": "start", "view": "look", "click": "look", "purchase": "buy"},
    bounds=((0, "onset", "Onset", 62.0, "first change", "liquid -> coagulating", "egg", "suggestion"), (1, "full", "Full", 70.0, "last change", "coagulating -> solid", "egg", "alert"), (2, "smoke", "Smoke point", 150.0, "too hot", None, "bolt", "alert"), (3, "weep", "Weeping", None, "over-contraction", "solid -> scorched", "gear", "alert")),
    rules=((0, "start_first", ["start"], ["look", "buy"], "an account comes first", None, None, None, True), (1, "look_first", ["look"], ["buy"], "nothing is bought unseen", None, None, None, True)),
    preferences=((0, "pace", "parametric", "slow", ["u1", "u2", "u3"], None, None, None, None, False), (1, "pace", "parametric", "fast", ["u4", "u5"], "done sooner", None, None, None, False), (2, "route", "structural", "direct", ["u2", "u5", "u6"], None, None, None, None, False), (3, "route", "structural", "around", ["u1"], "more seen", None, None, None, False)),
    excluded={"u7": "out of order", "u9": "no variation"},
    goal_entity="egg", goal_labels=("coagulating", "solid"), goal_location="plate", goal_action="close the case", default_entity="egg", definition_version="2",
)

#: The same actions in SQL; every query that uses them begins with it.
ACTIONS_SQL = r"""
ev AS (
  SELECT 'u' || user_id AS recipe_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_number, event_type, value, event_id, epoch_us(ts) AS us, (props->>'k')::INT AS k FROM events),
act AS (
  SELECT recipe_id, step_number, event_type, event_id, k, us, value,
         CASE event_type WHEN 'purchase' THEN 'Plate' WHEN 'click' THEN 'Transfer' ELSE 'Process' END AS node_type,
         event_type || ' Hot  Item ' || (k % 3) AS action_phrase, lower(event_type) || '_hot_item_' || (k % 3) AS canonical_action,
         CASE WHEN value < 50 THEN 'liquid' WHEN value < 100 THEN 'coagulating' ELSE 'solid' END AS pre_label,
         CASE WHEN k % 2 = 0 THEN 'coagulating' ELSE 'solid' END AS post_label, k / 10.0::DOUBLE AS confidence FROM ev),
fp AS (SELECT *, substr(sha256(node_type || '|' || canonical_action || '|egg:' || pre_label || '|egg:' || post_label), 1, 16) AS node_id FROM act)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines have one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 1), line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, step_number, event_type, value, event_id, us (microseconds), k."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("recipe_id"), F.row_number().over(w).alias("step_number"), "event_type", "value", "event_id", us.alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on one entity, with a state before and one after."""
    state = lambda label: F.array(F.struct(F.lit("Eggs").alias("entity_id"), label.alias("physics_state"), label.alias("k2_label"))).cast(CONDITIONS)
    pre = F.when(F.col("value") < 50, "liquid").when(F.col("value") < 100, "coagulating").otherwise("solid")
    post = F.when(F.col("k") % 2 == 0, "coagulating").otherwise("solid")
    kind = F.when(F.col("event_type") == "purchase", "Plate").when(F.col("event_type") == "click", "Transfer").otherwise("Process")
    verdict = F.when(F.col("k") == 9, "reject").when(F.col("k") == 8, "revise").otherwise("accept")
    return events(spark, sf_dir).select(
        "recipe_id", "step_number", F.lit(1).alias("sub_step"), kind.alias("node_type"), F.concat("event_type", F.lit(" Hot  Item "), (F.col("k") % 3).cast("string")).alias("action_phrase"), state(pre).alias("pre"), state(post).alias("post"),
        F.array(F.lit("egg"), F.when(F.col("k") > 5, "bolt").otherwise("gear")).alias("ingredients"), F.array(F.lit("plate")).alias("tools"), F.concat(F.lit("step "), F.col("k").cast("string")).alias("source_span"),
        F.lit(True).alias("in_scope"), (F.col("k") / F.lit(10.0)).alias("confidence"), F.lit("rule").alias("extractor_model"), verdict.alias("verdict"), "event_type", "event_id", "us", "value", "k",
    )


ALIASES = {"eggs": "egg", "egg": "egg"}


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with seq and node_id."""
    from stepweave.functions.nested import literal_map
    from stepweave.operators import fuse

    return fuse.fingerprints(fuse.with_seq(actions(spark, sf_dir)), literal_map(ALIASES))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_name, p_brand, p_size, adjective, noun."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.get(words, F.lit(0)).alias("adjective"), F.get(words, F.lit(1)).alias("noun"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed documents: what a rule says (auto) and what labels say (gold), with mode and time."""
    rule = (F.col("n_chars") >= 400).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", rule.alias("auto"))
    mode = F.when(F.col("doc_id") % 3 == 0, "from_scratch").otherwise("corrected")
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").withColumns({"mode": mode, "seconds_spent": F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 97).cast("double"))})
