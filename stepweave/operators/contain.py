"""Texts that hold other texts: terms of a table as whole words, passages as they are.

Both meet through hashes of short pieces, so only texts that have a piece are compared, and the pieces of texts leave the
scan only where the other side (as small as it may be) is too large to be sent to the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions import text as tx

#: Words of a piece of a passage; characters where a passage has no inner word.
GRAM, CHARS = 6, 8


def mentioned_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term: the terms (column term) that a text (column text) has as whole words, in any case, each once.

    Texts are cut into their distinct words and joined with the terms' first words; a term of one word is found by that,
    any other is looked for in the text. Blank terms are never found; terms without a word character in front are looked
    for under their first word. A null text has none.
    """
    word = r"(?U)\w+"
    known = terms.select(F.lower("term").alias("term")).filter(F.col("term").rlike(word)).distinct()
    known = known.withColumns({"word": F.regexp_extract("term", word, 0), "_one": F.col("term").rlike(r"(?U)^\w+$")})
    own = docs.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)))).alias("word"))
    met = own.join(known, "word")
    several = met.filter("not _one").select(key, "term").join(docs.select(key, "text"), key).filter(tx.mentions(F.col("term"), F.col("text"))).select(key, "term")
    return met.filter("_one").select(key, "term").unionByName(several).distinct()


def containing(passages: DataFrame, docs: DataFrame, item: str = "item_id", key: str = "doc_id") -> DataFrame:
    """item, key: passages (column text) and the texts (column text) that hold them, each pair once.

    A passage is looked up by its inner words (the outer ones may be cut), up to GRAM of them; one without inner words by
    its first characters, up to CHARS; an empty one is in every text. Only piece lengths that some passage has are made.
    Nulls hold and are held by nothing.
    """
    words = lambda t: F.split(t, " ")
    asked = passages.select(item, F.col("text").alias("_passage")).filter("_passage is not null")
    inner = F.size(words(F.col("_passage"))) - 2
    asked = asked.withColumns({"_kind": F.when(inner > 0, "w").otherwise("c"), "_n": F.when(inner > 0, F.least(inner, F.lit(GRAM))).otherwise(F.least(F.length("_passage"), F.lit(CHARS)))})
    piece = F.when(F.col("_kind") == "w", F.array_join(F.slice(words(F.col("_passage")), F.lit(2), F.greatest(F.col("_n"), F.lit(1))), " ")).otherwise(F.left("_passage", F.col("_n")))
    asked = asked.withColumn("_key", F.xxhash64("_kind", "_n", piece))
    bodies = docs.select(F.col(key), F.col("text").alias("_body")).filter("_body is not null")
    hits = None
    for kind, n in sorted(tuple(r) for r in asked.select("_kind", "_n").distinct().collect()):  # GRAM + CHARS + 1 at most
        mine = asked.filter((F.col("_kind") == kind) & (F.col("_n") == n)).select("_key", item)
        found = _pieces(bodies, key, kind, n).join(mine, "_key").select(item, key)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return asked.select(item).join(bodies.select(key), F.lit(False))
    hits = hits.distinct()
    return hits.join(asked.select(item, "_passage"), item).join(bodies, key).filter(F.contains("_body", F.col("_passage"))).select(item, key).distinct()


def _pieces(bodies: DataFrame, key: str, kind: str, n: int) -> DataFrame:
    """key, _key: the distinct runs of n words ("w") or characters ("c") of each text, hashed."""
    if kind == "w":
        rows = bodies.withColumn("_w", F.split("_body", " ")).filter(F.size("_w") >= n)
        runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))
    else:
        rows, runs = bodies, F.regexp_extract_all("_body", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit(""))
    return rows.select(key, F.explode(F.array_distinct(F.transform(runs, lambda p: F.xxhash64(F.lit(kind), F.lit(n), p)))).alias("_key"))
