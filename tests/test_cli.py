"""The verbs from a shell, over files in a folder."""

import json

from stepweave import cli

PAGE = '<script type="application/ld+json">{"@type": "Recipe", "name": "x", "recipeInstructions": ["crack eggs in a bowl", "cook eggs until firm"]}</script>'
CONFIG = {
    "dish": {"goal": {"entity": "egg", "k2_labels": ["solid"], "location": "plate"}, "inventory": {"ingredients": ["egg"], "utensils": ["bowl", "plate"]}, "definition_version": "1"},
    "ontology": {"canonical_entities": [{"canonical": "egg", "aliases": ["eggs"]}], "k2_compile_map": {"liquid": ["raw"], "solid": ["firm"]}},
    "physics_bounds": {"bounds": [{"id": "onset", "label": "Onset", "temperature_c": 62, "entity": "egg", "severity": "alert"}]},
    "variation_points": {"action_classes": {"crack": ["crack eggs"], "cook": ["cook eggs"], "plate": ["serve"]}, "order_rules": [{"id": "crack_first", "before": ["crack"], "after": ["cook"], "reason": "shells", "source": "curated"}]},
    "recipes": {"recipes": []},
}


def crack_or_cook(request):
    crack = request["text"].startswith("crack")
    return [{"action_phrase": "crack eggs" if crack else "cook eggs", "pre": [("eggs", "raw", None)], "post": [("eggs", "raw" if crack else "firm", None)], "ingredients": ["egg"], "source_span": request["text"][:5]}]


def agree(row):
    return {"verdict": "accept"}


def test_verbs(spark, tmp_path, capsys, monkeypatch):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    here, at = __name__, lambda name: str(tmp_path / name)
    for name, document in CONFIG.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    run = lambda *args: cli.main([args[0], "--config", str(tmp_path), "--out", at("out"), *args[1:]], spark)
    spark.createDataFrame([("r1", "u", PAGE), ("r2", "u", PAGE), ("r3", "u", "<p>nothing</p>")], "page_id string, url string, html string").write.parquet(at("pages"))
    assert run("ingest", "--pages", at("pages")) == 0
    assert spark.read.parquet(at("out/recipes")).count() == 2 and spark.read.parquet(at("out/quarantine")).count() == 1
    assert run("extract", "--recipes", at("out/recipes"), "--models", f"{here}:crack_or_cook") == 0
    assert run("verify", "--recipes", at("out/recipes"), "--actions", at("out/actions"), "--critics", f"{here}:agree") == 0
    assert run("fuse", "--actions", at("out/kept"), "--verdicts", at("out/verdicts")) == 0
    assert run("validate", "--graph", at("out"), "--recipes", at("out/recipes")) == 0 and "passed" in capsys.readouterr().out
    assert run("check", "--recipes", at("out/recipes")) == 0
    capsys.readouterr()
    assert run("query", "--graph", at("out")) == 0 and json.loads(capsys.readouterr().out) == ["r1", "r2"]
    assert run("query", "--graph", at("out"), "--branch", "r1") == 0 and len(json.loads(capsys.readouterr().out)["walk"]) == 3
    node = spark.read.parquet(at("out/nodes")).filter("action_phrase = 'cook eggs'").first().node_id
    assert run("query", "--graph", at("out"), "--node", node) == 0 and json.loads(capsys.readouterr().out)["required_before"][0]["rule_id"] == "crack_first"
