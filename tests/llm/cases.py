"""Small documents tables for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], schema)


def clashing(docs):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "shard", "slot", "start", "length", "copies", "taken", "target", "kept", "n_words", "count", "_rank", "_w", "_src", "_host", "h", "bucket", "rep", "sig", "component_id", "feature", "media", "spans", "conv_id", "turn", "words", "hash", "label"]
    return docs.withColumns({n: F.lit("clash") for n in names})
