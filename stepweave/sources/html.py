"""Recipes from pages: linked data first, then tags and classes.

Linked data stays in the JVM: script bodies by pattern, parsed to VARIANT. The fall-back needs an HTML parser and runs in
Arrow batches over the pages that linked data didn't settle; of the CSS selectors only tag, class part and itemprop occur.
"""

from __future__ import annotations

import html as html_lib
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.functions import text as tx

SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
# Where pages keep titles, ingredients and steps, as (tag, part of class, itemprop, inside tag); first that matches wins.
TITLES = (("h1", "title", None, None), ("h1", "recipe", None, None), ("h1", None, None, None))
INGREDIENTS = ((None, "ingredient", None, None), (None, None, "recipeIngredient", None), ("li", "ingredient", None, None))
STEPS = ((None, "instruction", None, None), (None, "step", None, None), (None, None, "recipeInstructions", None), ("li", "step", None, None), ("li", None, None, "ol"))
PARSED = "title string, ingredients array<string>, tools array<string>, steps array<string>"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """Elements with their attributes, ancestors' tags and texts; forgiving about tags that don't close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.all: list[dict] = []

    def handle_starttag(self, tag, attrs):
        e = {"tag": tag, "attrs": dict(attrs), "above": [x["tag"] for x in self.open], "texts": []}
        self.all.append(e)
        if tag not in VOID:
            if tag == "li" and any(x["tag"] == "li" for x in self.open) and self.open[-1]["tag"] not in ("ol", "ul"):
                while self.open and self.open.pop()["tag"] != "li":
                    pass
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not any(x["tag"] in ("script", "style") for x in self.open):
            for e in self.open:
                e["texts"].append(data.strip())

    def select(self, rule: tuple) -> list[dict]:
        tag, part, prop, inside = rule
        hit = lambda e: (not tag or e["tag"] == tag) and (not part or part in (e["attrs"].get("class") or "")) and (not prop or e["attrs"].get("itemprop") == prop) and (not inside or inside in e["above"])
        return [e for e in self.all if hit(e)]


def parse_tags(page: str) -> dict:
    tree = Tree()
    tree.feed(page or "")
    tree.close()
    found = lambda rules, least: next((x for x in map(tree.select, rules) if len(x) >= least), [])
    title = found(TITLES, 1)
    return {
        "title": "".join(title[0]["texts"]) if title else "Unknown Recipe",
        "ingredients": [t for e in found(INGREDIENTS, 1) if (t := "".join(e["texts"]))],
        "tools": [],
        "steps": [" ".join(e["texts"]) for e in found(STEPS, 2)],
    }


def by_tags(pages: DataFrame) -> DataFrame:
    """page_id and what tags and classes give (PARSED)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([{"page_id": i, **parse_tags(h)} for i, h in zip(pdf["page_id"], pdf["html"], strict=True)], columns=["page_id", "title", "ingredients", "tools", "steps"])

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {PARSED}")


@F.pandas_udf(T.StringType())
def unescape(text):
    return text.map(lambda x: None if x is None else html_lib.unescape(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_all(texts):
    return texts.map(lambda xs: None if xs is None else [html_lib.unescape(x) for x in xs])


def linked_recipe(page: Column) -> Column:
    """VARIANT of the first linked-data object whose type is the string Recipe: alone, in a list, or in @graph."""
    is_recipe = lambda v: F.try_variant_get(v, "$['@type']", "string").isin("Recipe", "recipe")
    items = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    bodies = F.transform(F.regexp_extract_all(page, F.lit(SCRIPT), F.lit(1)), F.try_parse_json)
    flat = F.flatten(F.transform(F.filter(bodies, lambda v: v.isNotNull()), lambda v: F.concat(items(v, "$"), F.array(v), items(v, "$['@graph']"))))
    return F.get(F.filter(flat, is_recipe), F.lit(0))


def instructions(value: Column) -> Column:
    """Steps of a VARIANT: a text by lines, or a list of texts and of objects with a text. Nested sections aren't entered."""
    single = F.filter(F.transform(F.split(F.try_variant_get(value, "$", "string"), "\n"), tx.strip), lambda x: x != "")
    listed = F.try_variant_get(value, "$", "array<variant>")
    one = lambda v: tx.strip(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.text", "string")))
    many = F.filter(F.transform(listed, one), lambda x: x.isNotNull())
    return F.when(F.schema_of_variant(value) == "STRING", single).when(listed.isNotNull(), many).otherwise(F.array().cast("array<string>"))


def by_linked_data(pages: DataFrame) -> DataFrame:
    """page_id and what linked data gives (PARSED), for pages that have it."""
    found = pages.select("page_id", linked_recipe(F.col("html")).alias("_v")).filter("_v is not null")
    texts = lambda path: F.coalesce(F.try_variant_get("_v", path, "array<string>"), F.array().cast("array<string>"))
    named = F.filter(F.transform(unescape_all(texts("$.recipeIngredient")), tx.strip), lambda x: x != "")
    steps = instructions(F.try_variant_get("_v", "$.recipeInstructions", "variant"))
    return found.select(
        "page_id",
        unescape(F.coalesce(F.try_variant_get("_v", "$.name", "string"), F.lit("Unknown Recipe"))).alias("title"),
        named.alias("ingredients"),
        texts("$.tool").alias("tools"),
        unescape_all(F.coalesce(steps, F.array().cast("array<string>"))).alias("steps"),
    )


def parse(pages: DataFrame) -> DataFrame:
    """page_id, via (linked or tags), title, ingredients, tools, steps: numbered lines that aren't junk, dropped, enough.

    Step numbers are those before blank and junk lines go, so gaps stay. A page with fewer than two steps left is not
    `enough`: its rows are for quarantine.
    """
    linked = by_linked_data(pages).withColumn("via", F.lit("linked"))
    rest = pages.join(linked.select("page_id"), "page_id", "left_anti")
    raw = linked.unionByName(by_tags(rest).withColumn("via", F.lit("tags")))
    numbered = F.filter(F.transform("steps", lambda t, i: F.struct((i + 1).alias("number"), t.alias("text"))), lambda s: s["text"] != "")
    out = raw.withColumn("_all", numbered).withColumn("steps", F.filter("_all", lambda s: ~tx.is_junk(s["text"])))
    out = out.withColumns({"dropped": F.size("_all") - F.size("steps"), "enough": F.size("steps") >= 2}).drop("_all")
    joined = F.array_join(F.transform("steps", lambda s: s["text"]), " ")
    return out.withColumns({"temperatures_mentioned": tx.temperature_mentions(joined), "timings_mentioned": tx.time_mentions(joined)})
