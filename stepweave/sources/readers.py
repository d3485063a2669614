"""Scans of recipes, actions, verdicts, labels and dimension files.

JSON is read with declared schemas in permissive mode: a document that doesn't parse is a row with `_bad`, which readers
drop (and `bad_documents` lists). Inside the engine tables are Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.sources import schema as sc


def json_documents(spark: SparkSession, paths: str | list[str], ddl: str) -> DataFrame:
    """One row for each JSON file: the declared fields, `_path`, and `_bad` with the text of a file that doesn't parse."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("_path"))
    parsed = F.from_json("value", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return sc.with_defaults(raw.select(parsed.alias("d"), "_path").select("d.*", "_path"))


def good_documents(spark: SparkSession, paths: str | list[str], ddl: str) -> DataFrame:
    return json_documents(spark, paths, ddl).filter("_bad is null").drop("_bad", "_path")


def bad_documents(spark: SparkSession, paths: str | list[str], ddl: str) -> DataFrame:
    return json_documents(spark, paths, ddl).filter("_bad is not null").select("_path", "_bad")


def recipes(spark: SparkSession, paths: str | list[str], excluded: DataFrame | None = None, gold_only: bool = False) -> DataFrame:
    """Recipes that parse and aren't excluded; only those held out for review if asked."""
    out = good_documents(spark, paths, sc.RECIPE)
    if excluded is not None:
        out = out.join(excluded.select("recipe_id"), "recipe_id", "left_anti")
    return out.filter("gold") if gold_only else out


def steps_of(recipes_: DataFrame) -> DataFrame:
    """recipe_id, step_number, text; numbers as they are, gaps stay."""
    return recipes_.select("recipe_id", F.explode("steps").alias("s")).select("recipe_id", F.col("s.number").alias("step_number"), F.col("s.text").alias("text"))


def actions(spark: SparkSession, path: str, recipe_id: str | None = None) -> DataFrame:
    """Actions ordered by step and sub-step; one recipe is one partition."""
    out = sc.with_defaults(spark.read.schema(sc.ACTION).parquet(path))
    out = out.filter(F.col("recipe_id") == recipe_id) if recipe_id else out
    return out.orderBy("recipe_id", "step_number", "sub_step")


def contiguous(actions_: DataFrame) -> DataFrame:
    """Sub-steps 1, 2, 3 ... of each step up to the first that is missing."""
    turn = F.row_number().over(Window.partitionBy("recipe_id", "step_number").orderBy("sub_step"))
    return actions_.withColumn("_turn", turn).filter("_turn = sub_step").drop("_turn")


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """Of each action the verdict of its last pass."""
    key = ["recipe_id", "step_number", "sub_step"]
    rest = [c for c in verdicts.columns if c not in (*key, "pass")]
    return verdicts.groupBy(*key).agg(F.max("pass").alias("pass"), F.max_by(F.struct(*rest), "pass").alias("v")).select(*key, "pass", "v.*")


def not_rejected(actions_: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Actions with a verdict that isn't a rejection; without a verdict an action goes."""
    key = ["recipe_id", "step_number", "sub_step"]
    return actions_.join(latest_verdicts(verdicts).filter("verdict <> 'reject'").select(*key, "verdict"), key)


def gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    out = good_documents(spark, paths, sc.GOLD)
    return out.withColumn("sub_steps", F.coalesce("sub_steps", F.array().cast(out.schema["sub_steps"].dataType)))


def gold_of(gold_: DataFrame, recipe_id: str, step_number: int) -> DataFrame:
    """No row or one: a missing or unreadable label is no label."""
    return gold_.filter((F.col("recipe_id") == recipe_id) & (F.col("step_number") == step_number))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html). Fetching itself is outside the engine: `fetch` fills such a table."""
    return spark.read.parquet(path)


def fetch(urls: DataFrame, get, cached: DataFrame | None = None) -> DataFrame:
    """Pages for (page_id, url): cached ones as they are, others by get(url) -> html on the executors.

    get brings its own politeness and time-outs; a page that fails has a null html and can be asked for again.
    """
    have = cached.select("page_id", "url", "html") if cached is not None else None
    wanted = urls.join(have.select("page_id"), "page_id", "left_anti") if have is not None else urls

    def run(batches):
        for pdf in batches:
            html = []
            for url in pdf["url"]:
                try:
                    html.append(get(url))
                except Exception:  # noqa: BLE001  any failure of a site
                    html.append(None)
            yield pdf[["page_id", "url"]].assign(html=html)

    page = urls.schema["page_id"].dataType.simpleString()
    new = wanted.select("page_id", "url").mapInPandas(run, f"page_id {page}, url string, html string")
    return have.unionByName(new) if have is not None else new


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs under a folder partitioned by run_id, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(conf).listStatus(root) if s.isDirectory()]
    return sorted(n.removeprefix("run_id=") for n in names)
