"""Dimension tables of a domain: entities, labels, bounds, inventory, classes, rules, preferences.

They come from data, so no operator knows a dish. Small ones (names, labels, terms) become literals of a plan; bounds,
rules and preferences are DataFrames. `from_folder` reads them from YAML or JSON files where a YAML reader is installed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import nested

BOUND = "seq int, bound_id string, label string, temperature_c double, description string, k2_transition string, entity string, severity string"
RULE = "rule_seq int, rule_id string, before array<string>, after array<string>, reason string, source_recipe string, source_step int, quote string, curated boolean"
PREFERENCE = "seq int, point string, kind string, choice string, recipes array<string>, outcome string, source_recipe string, source_step int, quote string, curated boolean"


@dataclass(frozen=True)
class Dims:
    aliases: dict[str, str] = field(default_factory=dict)
    states: dict[str, str] = field(default_factory=dict)
    ingredients: tuple[str, ...] = ()
    utensils: tuple[str, ...] = ()
    known_out: tuple[str, ...] = ()
    classes: dict[str, str] = field(default_factory=dict)
    bounds: tuple[tuple, ...] = ()
    rules: tuple[tuple, ...] = ()
    preferences: tuple[tuple, ...] = ()
    excluded: dict[str, str] = field(default_factory=dict)
    goal_entity: str = ""
    goal_labels: tuple[str, ...] = ()
    goal_location: str = ""
    goal_action: str = "serve"
    #: Bounds of this entity hold for every thermal action.
    default_entity: str = ""
    definition_version: str = ""

    @property
    def inventory(self) -> tuple[str, ...]:
        return self.ingredients + self.utensils

    @property
    def known_temperatures(self) -> list[float]:
        return [b[3] for b in self.bounds if b[3] is not None]

    def alias_map(self) -> Column:
        return nested.literal_map({**{v.lower(): v for v in self.aliases.values()}, **{k.lower(): v for k, v in self.aliases.items()}})

    def bounds_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.bounds), BOUND)

    def rules_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rules), RULE)

    def preferences_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.preferences), PREFERENCE)

    def excluded_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.excluded.items()), "recipe_id string, reason string")

    def class_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.classes.items()), "phrase string, cls string")


def state_map(groups: dict[str, list[str]]) -> dict[str, str]:
    """State -> label, each label being a state of its own too."""
    return {**{s.lower().strip(): label for label, states in groups.items() for s in states}, **{label.lower(): label for label in groups}}


def alias_map(entities: list[dict]) -> dict[str, str]:
    return {a.lower(): e["canonical"] for e in entities for a in [e["canonical"], *e.get("aliases", [])]}


def load_document(path: Path) -> dict:
    if path.suffix == ".json":
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML reader is installed; give the dimension files as JSON") from e
    return yaml.safe_load(path.read_text())


def _source(source) -> tuple:
    if isinstance(source, dict):
        return source.get("recipe_id"), source.get("step"), source.get("quote"), False
    return None, None, None, source == "curated"


def from_documents(dish: dict, ontology: dict, bounds: dict, variation: dict, recipes: dict, goal_action: str = "serve", default_entity: str | None = None) -> Dims:
    """Dims from the parsed dimension documents (inventory and goal; labels and aliases; bounds; classes, rules, preferences; recipes)."""
    goal, inventory = dish.get("goal", {}), dish.get("inventory", {})
    return Dims(
        aliases=alias_map(ontology.get("canonical_entities", [])),
        states=state_map(ontology.get("k2_compile_map", {})),
        ingredients=tuple(inventory.get("ingredients", [])),
        utensils=tuple(inventory.get("utensils", [])),
        known_out=tuple(t.lower() for t in dish.get("known_out_of_inventory", [])),
        classes={" ".join(p.lower().split()): c for c, ps in (variation.get("action_classes") or {}).items() for p in ps or []},
        bounds=tuple((i, b["id"], b["label"], None if b.get("temperature_c") is None else float(b["temperature_c"]), b.get("description"), b.get("k2_transition"), b.get("entity"), b.get("severity")) for i, b in enumerate(bounds.get("bounds", []))),
        rules=tuple((i, r["id"], list(r.get("before") or []), list(r.get("after") or []), r.get("reason"), *_source(r.get("source"))) for i, r in enumerate(variation.get("order_rules") or [])),
        preferences=tuple((n, p["id"], p.get("kind"), a.get("choice"), list(a.get("recipes") or []), a.get("outcome"), *_source(a.get("source"))) for n, (p, a) in enumerate((p, a) for p in variation.get("preference_points") or [] for a in p.get("alternatives") or [])),
        excluded={r["recipe_id"]: r["excluded"] for r in recipes.get("recipes", []) if r.get("excluded")},
        goal_entity=goal.get("entity", ""), goal_labels=tuple(goal.get("k2_labels", [])), goal_location=goal.get("location", ""), goal_action=goal_action,
        default_entity=goal.get("entity", "") if default_entity is None else default_entity,
        definition_version=str(dish.get("definition_version", "")),
    )


def from_folder(folder: str, names: tuple[str, ...] = ("dish", "ontology", "physics_bounds", "variation_points", "recipes"), **more) -> Dims:
    found = []
    for name in names:
        path = next((p for ext in (".yaml", ".yml", ".json") if (p := Path(folder) / f"{name}{ext}").exists()), None)
        found.append(load_document(path) or {} if path else {})
    return from_documents(*found, **more)


def resolve_join(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Add `canonical` to names by a table (alias, canonical) too large for a literal: two keys, then the name itself."""
    from stepweave.functions.text import entity_keys

    raw, spaced = entity_keys(F.col(column))
    keyed = names.withColumns({"_raw": raw, "_spaced": spaced})
    first = aliases.select(F.lower("alias").alias("_raw"), F.col("canonical").alias("_c1"))
    second = aliases.select(F.lower("alias").alias("_spaced"), F.col("canonical").alias("_c2"))
    return keyed.join(first, "_raw", "left").join(second, "_spaced", "left").withColumn("canonical", F.coalesce("_c1", "_c2", "_raw")).drop("_raw", "_spaced", "_c1", "_c2")
