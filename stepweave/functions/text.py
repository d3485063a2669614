"""Scalar text functions as column expressions.

White space, word characters and case are those of Unicode throughout: every pattern carries (?U). `trim` would only know
the space character.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of step lines that are no steps, and the least length of a step.
JUNK = (
    r"[Oo]ther\s+\w+\s+[Rr]ecipes",
    r"[Ss]ee\s+also",
    r"[Tt]ry\s*:",
    r"[Pp]rint\s+[Rr]ecipe",
    r"[Ss]ubscribe",
    r"[Pp]in\s+[Tt]his",
    r"(?i)^\s*notes?\s*:?\s*$",
)
MIN_STEP_CHARS = 15
# Mentions of temperatures and times, numbers with a unit, words of heat, joiners of actions.
TEMPERATURE_MENTION = r"(?iU)\b(\d{2,3})\s*°?\s*[CF]\b|\b(low|medium|high)\s+heat\b"
TIME_MENTION = r"(?iU)\b(\d+)\s*(second|minute|hour|sec|min|hr)s?\b|\b(constantly|until set|until firm)\b"
TEMPERATURE = r"(?iU)\b(\d{1,4})\s*(?:°\s*)?([CF])\b"
THERMAL = r"(?iU)\b(heat|cook|warm|melt|fry|saut|simmer|boil|scorch|burn|flame|brown|toast)\b"
COMPOUND = r"(?iU)\band\b|,|\bthen\b|;"
# Typographic characters and what they are compared as, one for one.
TYPOGRAPHIC, PLAIN = "’‘ʼ“” –—", "'''\"\" --"
# Parts of a state's wording that give its label, in this order; a state with none is the default label.
STATE_HINTS = (
    ("liquid", ("liquid", "raw", "whisk", "beat", "fluid")),
    ("coagulating", ("coagulat", "gel", "soft", "creamy", "thicken")),
    ("solid", ("solid", "set", "firm", "cooked", "toast", "baked")),
    ("scorched", ("scorch", "burn", "brown", "rubber", "dry", "over")),
)
LABELS = tuple(label for label, _ in STATE_HINTS)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", by)


def canonical_action(phrase: Column) -> Column:
    """Lower case, outer white space off, inner runs as one underscore."""
    return collapse(F.lower(phrase), "_")


def normal_phrase(phrase: Column) -> Column:
    return collapse(F.lower(phrase))


def same_phrase(a: Column, b: Column) -> Column:
    return normal_phrase(a) == normal_phrase(b)


def entity_keys(name: Column) -> tuple[Column, Column]:
    """The two spellings under which a name is looked up: as written, and with _ and - as spaces."""
    raw = strip(F.lower(name))
    return raw, collapse(F.translate(raw, "_-", "  "))


def is_junk(text: Column, patterns: tuple[str, ...] = JUNK, min_chars: int = MIN_STEP_CHARS) -> Column:
    found = F.length(strip(text)) < min_chars
    for p in patterns:
        found |= text.rlike(f"(?U){p}")
    return found


def mentions(term: str | Column, text: Column) -> Column:
    """Whether text has the term as whole words, in any case. Term is taken literally."""
    if isinstance(term, str):
        return text.rlike(rf"(?iU)(?<!\w){re.escape(term)}(?!\w)")
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.regexp_like(text, quoted)


def mentioned(text: Column, terms: list[str], more: Column | None = None) -> Column:
    """The terms (and those of the array `more`) that text has as whole words, in order, each once.

    Patterns of `terms` are compiled once; those of `more` for each row.
    """
    known = F.array_compact(F.array(*[F.when(mentions(t, text), F.lit(t)) for t in dict.fromkeys(t for t in terms if t)])) if terms else F.array().cast("array<string>")
    if more is None:
        return known
    extra = F.filter(F.transform(more, F.lower), lambda t: (t != "") & mentions(t, text))
    return F.array_distinct(F.concat(known, extra))


def is_thermal(phrase: Column) -> Column:
    return phrase.rlike(THERMAL)


def may_be_compound(phrase: Column, containing: list[str] = ()) -> Column:
    """Joins several verbs, or is one of the phrases that a label says contain another step."""
    hint = phrase.rlike(COMPOUND)
    return hint | phrase.isin(list(containing)) if containing else hint


def temperature_mentions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TEMPERATURE_MENTION), F.lit(0))))


def time_mentions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TIME_MENTION), F.lit(0))))


def temperatures(text: Column) -> Column:
    """Distinct numbers with a unit, as doubles, in order of the text. The unit isn't converted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TEMPERATURE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("double")))


def ground_span(span: Column, text: Column) -> Column:
    """The slice of text that span stands for if they match with typographic characters made plain, else span."""
    place = F.position(F.translate(span, TYPOGRAPHIC, PLAIN), F.translate(text, TYPOGRAPHIC, PLAIN))
    return F.when(F.contains(text, span) | (place < 1), span).otherwise(F.substring(text, place, F.length(span)))


def compile_label(state: Column, known: dict[str, str], hints=STATE_HINTS) -> Column:
    """The label of a free-text state: by its normalised wording, its own wording, a hint in it, or the first label."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None
    low = F.lower(state)
    key = F.translate(strip(low), " -", "__")
    by_hint = F.lit(hints[0][0])
    for label, parts in reversed(hints):
        by_hint = F.when(low.rlike("|".join(map(re.escape, parts))), F.lit(label)).otherwise(by_hint)
    if table is None:
        return by_hint
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, strip(low)), by_hint)


def fingerprint(node_type: Column, phrase: Column, pre_key: Column, post_key: Column) -> Column:
    """16 hex digits for what an action does: type, canonical wording, states before and after."""
    return F.substring(F.sha2(F.concat_ws("|", node_type, canonical_action(phrase), pre_key, post_key), 256), 1, 16)


def artifact_key(recipe: Column, step: Column, sub: Column) -> Column:
    stem = F.format_string("%s_step%02d", recipe, step)
    return F.when(sub > 1, F.concat(stem, F.lit("."), sub.cast("string"))).otherwise(stem)


def pair_id(a: Column, b: Column) -> Column:
    """An id for two nodes in either order; a node has none with itself."""
    return F.when(F.assert_true(a != b, "a node cannot be paired with itself").isNull(), F.concat(F.least(a, b), F.lit("__"), F.greatest(a, b)))


def oriented_label(label: Column, stored_first: Column, shown_first: Column) -> Column:
    """A stored pair label as seen with `shown_first` in front."""
    turned = F.when(label == "a_contains_b", "b_contains_a").when(label == "b_contains_a", "a_contains_b").otherwise(label)
    return F.when(stored_first == shown_first, label).otherwise(turned)


def model_provider(slug: Column, providers: tuple[str, ...], default: str) -> tuple[Column, Column]:
    """Provider and model of a slug `provider/model`: a known prefix names the provider, else the default takes it whole."""
    which, rest = F.lit(default), slug
    for p in providers:
        which = F.when(slug.startswith(f"{p}/"), F.lit(p)).otherwise(which)
        rest = F.when(slug.startswith(f"{p}/"), F.substring(slug, len(p) + 2, 1 << 30)).otherwise(rest)
    return which, rest


def percent(part: Column, whole: Column) -> Column:
    """One decimal; null of nothing."""
    return F.round(F.try_divide(part * 100.0, whole), 1)


def percent_or_zero(part: Column, whole: Column) -> Column:
    return F.round(part * 100.0 / F.greatest(whole, F.lit(1)), 1)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Null where a denominator is 0; F1 is null too where precision or recall is 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def today() -> Column:
    return F.current_date().cast("string")
