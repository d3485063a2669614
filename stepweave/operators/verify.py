"""Extraction and verification with models behind plain interfaces, cheapest checks first.

A model is any callable that executors can pickle; none is bundled but deterministic stand-ins. Each stage of the cascade
sees only rows that no earlier stage decided, and answers are tables keyed by step and hint, so nothing is asked twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.operators.dims import Dims
from stepweave.sources import schema as sc

KEY = ["recipe_id", "step_number", "sub_step"]
# The keys under which a gate model's answer has the scores of its five questions, and its choices.
QUESTIONS = ("node_type_matches", "preconditions_supported", "postconditions_supported", "entities_are_objects", "action_faithful")
CHOICES = ("accept", "revise", "reject")
# Parts of the names of errors, and of their messages, after which the next model is asked.
RETRYABLE_TYPES = ("RateLimitError", "ServiceUnavailableError", "Timeout", "APIConnectionError", "InternalServerError", "OverloadedError", "NotFoundError", "InstructorRetryException", "IncompleteOutputException")
RETRYABLE_WORDS = ("rate limit", "ratelimit", "too many requests", "resource_exhausted", "server error", "service unavailable", "overloaded", "timeout", "connection", "502", "503", "529", "not a valid model", "model not found")

#: What each question asks of an action: the request that a gate model gets beside the action itself.
ASKED = {
    "node_type_matches": "Is the type of the action (a change of state, a move, or serving) the one that the step's text describes?",
    "preconditions_supported": "Does the text say or clearly presuppose every state before the action?",
    "postconditions_supported": "Does this action itself, as the text has it, bring about every state after it?",
    "entities_are_objects": "Is every entity a thing of its own under its base name, and none a mere state or form of another?",
    "action_faithful": "Does the phrase name only what the text says is done?",
    "verdict": "Taken by itself, is the action to be accepted, revised or rejected?",
}


def request(step_text: str, action: dict, hint: str | None = None) -> dict:
    """What a gate or critic model is asked: questions with their kind (a probability or a choice), text, action, hint."""
    kind = {q: {"type": "noul", "instructions": ASKED[q]} for q in QUESTIONS} | {"verdict": {"type": "choice", "instructions": ASKED["verdict"], "choices": list(CHOICES)}}
    return {"questions": kind, "step_text": step_text, "extraction": action, **({"revision_hint": hint} if hint else {})}


class Retryable(Exception):
    """A failure that another try or another model may not have."""


def is_retryable(error: Exception) -> bool:
    """By type or wording: overload, time-outs, lost connections, answers that don't fit, models that aren't there."""
    named = any(t in type(error).__name__ for t in RETRYABLE_TYPES)
    return isinstance(error, (Retryable, TimeoutError, ConnectionError)) or named or any(w in str(error).lower() for w in RETRYABLE_WORDS)


def call_with_fallback(models: list[tuple[str, Callable]], request, tries: int = 2, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep):
    """(name, answer) of the first model that answers: each is tried a few times, waiting longer each time; an error that
    neither a retry nor another model can mend ends the call."""
    last: Exception | None = None
    for name, model in models:
        for turn in range(tries):
            try:
                return name, model(request)
            except Exception as e:  # noqa: BLE001  models fail in any way
                if not is_retryable(e):
                    raise
                last = e
                if delay:
                    sleep(delay * (turn + 1))
    raise RuntimeError(f"all {len(models)} models failed") from last


def extract(steps: DataFrame, models: list[tuple[str, Callable]], dims: Dims, cached: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """Actions of steps, one or more each, numbered; spans grounded, labels compiled. Steps in `cached` aren't asked again.

    A model takes {"recipe_id", "step_number", "text", "hint"} and returns a list of dicts of ACTION fields.
    """
    todo = steps if cached is None else steps.join(cached.select("recipe_id", "step_number").distinct(), ["recipe_id", "step_number"], "left_anti")
    names = [f.split()[0] for f in ("recipe_id", "step_number", "sub_step", "node_type", "action_phrase", "pre", "post", "timing", "ingredients", "tools", "source_span", "in_scope", "temperature_c", "confidence", "extractor_model")]
    hinted = "hint" in steps.columns

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                name, found = call_with_fallback(models, {"recipe_id": r["recipe_id"], "step_number": r["step_number"], "text": r["text"], "hint": r.get("hint") or hint})
                if not found:
                    raise ValueError(f"no action for {r['recipe_id']} step {r['step_number']}")
                rows += [{"node_type": "Process", "action_phrase": "", "pre": [], "post": [], "timing": None, "ingredients": [], "tools": [], "source_span": r["text"], "in_scope": True, "temperature_c": None, "confidence": 1.0, **a, "recipe_id": r["recipe_id"], "step_number": r["step_number"], "sub_step": i + 1, "extractor_model": name} for i, a in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    raw = todo.select("recipe_id", "step_number", "text", *(["hint"] if hinted else [])).mapInPandas(run, sc.ACTION)
    labelled = lambda c: F.transform(c, lambda x: x.withField("k2_label", tx.compile_label(F.coalesce(x["physics_state"], F.lit("")), dims.states)))
    done = raw.join(todo.select("recipe_id", "step_number", "text"), ["recipe_id", "step_number"]).withColumns({"source_span": tx.ground_span(F.col("source_span"), F.col("text")), "pre": labelled("pre"), "post": labelled("post")}).select(names)
    return done if cached is None else cached.select(names).unionByName(done)


def checks(actions: DataFrame, steps: DataFrame, dims: Dims) -> DataFrame:
    """Actions with their step's text and `issues` found without a model, in this order: span, labels, temperatures, scope."""
    rows = actions.join(steps, ["recipe_id", "step_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    aliases = dims.alias_map()
    conditions = F.concat("pre", "post")
    bad = F.transform(F.filter(conditions, lambda c: ~F.coalesce(c["k2_label"].isin(*tx.LABELS), F.lit(False))), lambda c: F.format_string("Invalid label '%s' on entity '%s'", c["k2_label"], c["entity_id"]))
    texts = nested.free_texts(F.col("action_phrase"), F.col("source_span"), F.col("pre"), F.col("post"), F.col("timing.deadline"))
    invented = F.transform(nested.invented_temperatures(F.col("temperature_c"), texts, F.col("text"), dims.known_temperatures), lambda t: F.format_string("Invented temperature %s C", t.cast("string")))
    outside = nested.outside_entities(F.col("pre"), F.col("post"), F.col("ingredients"), F.col("tools"), aliases, list(dims.inventory))
    named = nested.scope_issues(F.col("action_phrase"), outside, list(dims.known_out))
    span = F.when(~F.contains("text", F.col("source_span")), F.concat(F.lit("source span not found in step text: '"), F.substring("source_span", 1, 60), F.lit("'")))
    scope = F.when(F.size(named) > 0, F.concat(F.lit("action names items outside the inventory: "), F.array_join(named, ", ")))
    return rows.withColumn("issues", F.concat(F.array_compact(F.array(span)), bad, invented, F.array_compact(F.array(scope))))


def deterministic(checked: DataFrame, dims: Dims) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rows that no rule decides). Rows marked out of scope are accepted if their step names something known to
    be outside, else to be revised; an invented temperature is rejected, any other issue to be revised."""
    known = F.size(tx.mentioned(F.col("text"), list(dims.known_out))) > 0
    wrong = F.exists("issues", lambda i: F.contains(i, F.lit("Invented temperature")))
    verdict = F.when(~F.col("in_scope"), F.when(known, "accept").otherwise("revise")).when(wrong, "reject").when(F.size("issues") > 0, "revise")
    rows = checked.withColumn("verdict", verdict)
    advice = F.when(~F.col("in_scope"), "The step names nothing outside the inventory. Set in_scope to true and extract it.").otherwise(F.concat(F.lit("Fix the following: "), F.array_join("issues", "; ")))
    unsupported = F.array(F.lit("in_scope is false but the step text names no known out-of-inventory item"))
    issues = F.when(F.col("in_scope"), F.col("issues")).when(F.col("verdict") == "accept", F.array().cast("array<string>")).otherwise(unsupported)
    decided = rows.filter("verdict is not null").select(*KEY, "verdict", F.substring("text", 1, 80).alias("grounding_quote"), issues.alias("issues"), F.lit("deterministic").alias("critic_model"), F.when(F.col("verdict") == "revise", advice).alias("revision_instructions"), F.lit(None).cast("map<string,double>").alias("scores"))
    return decided, rows.filter("verdict is null").drop("verdict")


def gate_accepts(scores: Column, choice: Column, threshold: float) -> Column:
    """All questions, the choice, and the choice's own probability (where given) clear the threshold, which counts itself."""
    probability = F.coalesce(F.try_element_at(scores, F.lit("verdict_accept")), F.lit(1.0))
    return F.forall(F.array(*map(F.lit, QUESTIONS)), lambda q: F.coalesce(F.try_element_at(scores, q) >= threshold, F.lit(False))) & (choice == "accept") & (probability >= threshold)


def failed_checks(scores: Column, choice: Column, threshold: float) -> Column:
    low = F.filter(F.array(*map(F.lit, QUESTIONS)), lambda q: F.try_element_at(scores, q) < threshold)
    said = F.transform(low, lambda q: F.concat(q, F.lit("="), F.format_string("%.2f", F.try_element_at(scores, q))))
    return F.concat(said, F.array_compact(F.array(F.when(choice != "accept", F.concat(F.lit("verdict="), choice)))))


def score_map(answers: dict) -> dict[str, float]:
    """Flat scores of a gate model's answer {question: {"noul": p}, "verdict": {"choice", "probabilities"}}; its shape is checked."""
    missing = [q for q in QUESTIONS if "noul" not in (answers.get(q) or {})]
    if missing or (answers.get("verdict") or {}).get("choice") not in CHOICES:
        raise ValueError(f"the gate model's answer lacks {missing or 'verdict'}")
    sure = (answers["verdict"].get("probabilities") or {}).get("accept")
    return {q: float(answers[q]["noul"]) for q in QUESTIONS} | {"verdict_accept": float(sure) if sure is not None else float(answers["verdict"]["choice"] == "accept")}


def gate(open_: DataFrame, model: Callable | None) -> DataFrame:
    """Rows with scores (map) and choice of the gate model; null where there is none or it fails: these fall through."""
    if model is None:
        return open_.withColumns({"scores": F.lit(None).cast("map<string,double>"), "choice": F.lit(None).cast("string")})
    columns = open_.columns

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            scores, choice = [], []
            for r in pdf.to_dict("records"):
                try:
                    answer = model(r)
                    scores.append(score_map(answer))
                    choice.append(answer["verdict"]["choice"])
                except Exception:  # noqa: BLE001  an outage of the gate is no verdict
                    scores.append(None)
                    choice.append(None)
            yield pdf[KEY].assign(scores=scores, choice=choice)

    small = open_.select(*KEY, "action_phrase", "source_span", "text")
    asked = small.mapInPandas(run, "recipe_id string, step_number int, sub_step int, scores map<string,double>, choice string")
    return open_.join(asked, KEY, "left").select(*columns, "scores", "choice")


def verify(actions: DataFrame, steps: DataFrame, dims: Dims, gate_model: Callable | None, critics: list[tuple[str, Callable]], threshold: float = 0.8, cached: DataFrame | None = None) -> DataFrame:
    """Verdicts of actions: cached ones, then rules, then the gate model's acceptance, then a critic model.

    A critic takes the row (action_phrase, source_span, text, note) and returns {"verdict", "issues",
    "revision_instructions", "grounding_quote"}; note says what the gate model doubted.
    """
    names = [*KEY, "verdict", "grounding_quote", "issues", "critic_model", "revision_instructions", "scores"]
    todo = actions if cached is None else actions.join(cached.select(*KEY), KEY, "left_anti")
    decided, open_ = deterministic(checks(todo, steps, dims), dims)
    rated = gate(open_, gate_model)
    fine = F.coalesce(gate_accepts(F.col("scores"), F.col("choice"), threshold), F.lit(False))
    accepted = rated.filter(fine).select(*KEY, F.lit("accept").alias("verdict"), F.col("source_span").alias("grounding_quote"), F.array().cast("array<string>").alias("issues"), F.lit("gate").alias("critic_model"), F.lit(None).cast("string").alias("revision_instructions"), "scores")
    doubts = F.array_join(failed_checks(F.col("scores"), F.col("choice"), threshold), ", ")
    left = rated.filter(~fine).select(*KEY, "action_phrase", "source_span", "text", "scores", F.when(F.col("scores").isNotNull(), F.when(doubts != "", doubts).otherwise("verdict did not clear the accept threshold")).alias("note"))

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                name, a = call_with_fallback(critics, r)
                rows.append({**{k: r[k] for k in KEY}, "verdict": a["verdict"], "grounding_quote": a.get("grounding_quote", r["source_span"]), "issues": a.get("issues", []), "critic_model": name, "revision_instructions": a.get("revision_instructions"), "scores": r["scores"]})
            yield pd.DataFrame(rows, columns=names)

    judged = left.mapInPandas(ask, "recipe_id string, step_number int, sub_step int, verdict string, grounding_quote string, issues array<string>, critic_model string, revision_instructions string, scores map<string,double>")
    out = decided.select(names).unionByName(accepted.select(names)).unionByName(judged.select(names))
    return out if cached is None else cached.select(names).unionByName(out)


def steps_to_revise(verdicts: DataFrame) -> DataFrame:
    """recipe_id, step_number, hint: a step with any action to revise is revised whole; hints in order of actions."""
    advice = F.coalesce("revision_instructions", F.array_join("issues", "; "))
    asked = F.when(F.col("verdict") == "revise", F.struct("sub_step", advice.alias("t")))
    by = verdicts.groupBy("recipe_id", "step_number").agg(F.array_sort(F.collect_list(asked)).alias("a"))
    return by.filter(F.size("a") > 0).select("recipe_id", "step_number", F.array_join(F.transform("a", lambda x: x["t"]), " / ").alias("hint"))


def verify_with_revision(actions: DataFrame, steps: DataFrame, dims: Dims, extractors: list[tuple[str, Callable]], gate_model: Callable | None, critics: list[tuple[str, Callable]], threshold: float = 0.8, revise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(actions that stay, verdicts with pass). One round of revision: steps to revise are extracted again with the hint and
    judged again; of those anything not rejected stays. Without revision only accepted actions stay."""
    from stepweave.operators.graph import cut

    first = cut(verify(actions, steps, dims, gate_model, critics, threshold).withColumn("pass", F.lit(1)))
    if not revise:
        return actions.join(first.filter("verdict = 'accept'").select(*KEY), KEY, "left_semi"), first
    again = steps_to_revise(first)
    redone = cut(extract(steps.join(again, ["recipe_id", "step_number"]), extractors, dims))
    second = cut(verify(redone, steps, dims, gate_model, critics, threshold).withColumn("pass", F.lit(2)))
    at = ["recipe_id", "step_number"]
    old = actions.join(again.select(*at), at, "left_anti").join(first.filter("verdict = 'accept'").select(*KEY), KEY, "left_semi")
    new = redone.join(second.filter("verdict <> 'reject'").select(*KEY), KEY, "left_semi")
    return old.unionByName(new.select(old.columns)), first.unionByName(second)
