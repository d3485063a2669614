"""Documents to packed sequences: STAGES, each over all that the one before kept, through Parquet in the shared folder.

In every stage a null text is an empty one, texts of any length are taken whole, rows that repeat are rows of their own, an
empty table stays empty, and columns beside doc_id, text and source pass through under their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import jaccard, mixing, packing, quality, secrets
from stepweave.llm.common import stored


def carried(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with private names for the columns that a stage only carries, and these names; a stage's own can't clash with them."""
    others = [f for f in docs.columns if f not in ("doc_id", "text", "source")]
    return docs.select("doc_id", "text", "source", *[F.col(f).alias(f"_own_{f}") for f in others]), ("text", *[f"_own_{f}" for f in others])


def given_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in its order, from rows that carry them."""
    return rows.select(*[F.col(f) if f in ("doc_id", "text", "source") else F.col(f"_own_{f}").alias(f) for f in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go: null and empty texts with them (fewer words than the rules
    ask for); a null source is a host of its own. Rows that repeat stay or go alike."""
    own, carry = carried(docs)
    return given_back(quality.judge(own, carry=carry).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: the least doc_id (null last), of ties the least text hash, then
    any. Repeated rows are similar; documents without words link with nothing and stay."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced, n_chars follows; no document goes. Of secrets that overlap the longer is replaced."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept, or repeated once, as the mix takes them. Documents without words count as taken like
    their source's others; rows that repeat are taken one by one; a null source is a source."""
    own, carry = carried(docs)
    mixed = mixing.mix(own, carry=carry).filter("copies > 0")
    return given_back(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack_windows),
]

#: Hashes, a trained forest and tokenizer ids decide the rows; SQL can't express that. tests/llm test it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
