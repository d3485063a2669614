"""Functions over arrays of conditions (entity_id, physics_state, k2_label) and of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.functions import text as tx

CONDITIONS = "array<struct<entity_id:string,physics_state:string,k2_label:string>>"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def resolve(name: Column, aliases: Column) -> Column:
    """A name's canonical entity by its two keys; an unknown name is its own lower-case self."""
    raw, spaced = tx.entity_keys(name)
    return F.coalesce(F.try_element_at(aliases, raw), F.try_element_at(aliases, spaced), raw)


def resolve_conditions(conditions: Column, aliases: Column) -> Column:
    return F.transform(conditions, lambda c: c.withField("entity_id", resolve(c["entity_id"], aliases)))


def conditions_key(conditions: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(conditions, lambda c: F.concat_ws(":", c["entity_id"], c["k2_label"]))), "|")


def block_key(node_type: Column, pre: Column, post: Column) -> Column:
    return F.concat(node_type, F.lit(" | "), conditions_key(pre), F.lit(" -> "), conditions_key(post))


def first_conditions(conditions: Column) -> Column:
    """The first condition of each (entity, label), in order."""
    earlier = lambda c, i: F.exists(F.slice(conditions, 1, i), lambda d: (d["entity_id"] == c["entity_id"]) & (d["k2_label"] == c["k2_label"]))
    return F.filter(conditions, lambda c, i: ~earlier(c, i))


def clean_conditions(conditions: Column, aliases: Column, labels: tuple[str, ...] = tx.LABELS) -> Column:
    """Without blank or unknown rows, names resolved, each (entity, label) once."""
    usable = F.filter(conditions, lambda c: (tx.strip(F.coalesce(c["entity_id"], F.lit(""))) != "") & F.coalesce(tx.strip(c["k2_label"]).isin(*labels), F.lit(False)))
    return first_conditions(F.transform(usable, lambda c: c.withField("entity_id", resolve(c["entity_id"], aliases)).withField("k2_label", tx.strip(c["k2_label"]))))


def clean_names(names: Column, aliases: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(names, lambda n: tx.strip(F.coalesce(n, F.lit(""))) != ""), lambda n: resolve(n, aliases)))


def condition_pairs(conditions: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(conditions, lambda c: F.concat_ws(":", c["entity_id"], c["k2_label"]))))


def set_counts(found: Column, gold: Column) -> tuple[Column, Column, Column]:
    """True positives, false positives and false negatives of two arrays taken as sets."""
    return F.size(F.array_intersect(found, gold)), F.size(F.array_except(found, gold)), F.size(F.array_except(gold, found))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def free_texts(phrase: Column, span: Column, pre: Column, post: Column, deadline: Column) -> Column:
    states = F.transform(F.concat(pre, post), lambda c: c["physics_state"])
    return F.array_compact(F.concat(F.array(phrase, span), states, F.array(deadline)))


def invented_temperatures(temperature: Column, texts: Column, step_text: Column, known: list[float]) -> Column:
    """Temperatures of an action that neither its step's text nor the known values have: the own field first."""
    said = F.flatten(F.transform(texts, tx.temperatures))
    all_ = F.array_distinct(F.concat(F.array_compact(F.array(temperature)), said))
    return F.array_except(all_, F.concat(tx.temperatures(step_text), F.array(*[F.lit(float(k)) for k in known]).cast("array<double>")))


def outside_entities(pre: Column, post: Column, ingredients: Column, tools: Column, aliases: Column, inventory: list[str]) -> Column:
    """Names as written that don't resolve into the inventory."""
    names = F.concat(F.transform(F.concat(pre, post), lambda c: c["entity_id"]), ingredients, tools)
    return F.filter(F.array_distinct(names), lambda n: ~resolve(n, aliases).isin(*inventory))


def scope_issues(phrase: Column, outside: Column, known_out: list[str]) -> Column:
    """Terms outside the inventory that the phrase still names."""
    return tx.mentioned(phrase, known_out, F.transform(outside, lambda n: F.replace(n, F.lit("_"), F.lit(" "))))


def actions_of(expected: Column, sub_steps: Column) -> Column:
    return F.when(F.size(sub_steps) > 0, sub_steps).otherwise(F.array(expected))
