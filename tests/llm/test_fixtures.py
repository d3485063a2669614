"""The queries over planted tables, where the method has to decide: a failing host, quoted threads, secrets among look-alikes."""

import random

import pytest
from pyspark.sql import functions as F

from stepweave.llm import chat, pii, quality, secrets

WORDS = "the of and river stone light green house walk over under quiet morning paper small round table bread water cloud".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


def test_a_failing_host(spark, tmp_path):
    """A host of which most documents fail loses the others too; small hosts and the large clean one keep theirs."""
    rng = random.Random(1)
    bad = lambda: " ".join(["buy this cheap thing now"] * 20)
    rows = [(f"bad{i}", bad(), "spam") for i in range(180)] + [(f"hidden{i}", prose(rng, 60), "spam") for i in range(20)]
    rows += [(f"good{i}", prose(rng, 60), f"host{i % 20}") for i in range(2000)] + [(f"slip{i}", bad(), f"host{i % 20}") for i in range(40)]
    rows += [("lone bad", bad(), "tiny"), ("lone good", prose(rng, 60), "tiny")]
    docs = [(i, t, "en", s, len(t)) for i, (_, t, s) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {rows[r.doc_id][0]: r for r in quality.query(spark, str(tmp_path)).collect()}
    assert not any(got[f"hidden{i}"].kept or got[f"hidden{i}"].base_failed for i in range(20))
    assert all(got[f"good{i}"].kept for i in range(2000)) and got["lone good"].kept
    assert not any(got[k].kept for k in got if k.startswith(("bad", "slip", "lone bad")))


def test_hosts_of_pages(spark):
    urls = [("http://www.A.org/x", "a.org"), ("https://a.org:8080/y?z=1", "a.org"), ("not a url", None), (None, None)]
    got = spark.createDataFrame([(u,) for u, _ in urls], "u string").select("u", quality.domain(F.col("u")).alias("h")).collect()
    assert [(r.u, r.h) for r in got] == urls
    rows = [(i, " ".join(["buy this cheap thing now"] * 20), "s", "http://spam.net/" + str(i)) for i in range(90)] + [(100 + i, prose(random.Random(i), 50), "s", f"http://{'spam.net' if i < 5 else f'h{i % 9}.org'}/{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, url string")
    kept = {r.doc_id for r in quality.judge(docs, host=quality.domain(F.col("url"))).collect() if r.kept}
    assert kept == set(range(105, 300))


def test_quoted_threads(spark, tmp_path):
    """Replies quote earlier messages, in any case and with other white space; the query links them and orders by threads."""
    rows = [
        (1, 0, "user", "How do I bake bread?\nI have flour."), (1, 1, "assistant", "Mix it with water.\n\nThen wait an hour."), (1, 2, "user", "And another thing: what is a river?"),
        (1, 3, "user", "Ann wrote:\n> then   WAIT an hour.\nWhy an hour?"), (1, 4, "assistant", "> And another thing: what is a river?\nWater that flows."), (1, 5, "assistant", ">> Then wait an hour.\n> Why an hour?\nSo that it rises."), (1, 6, "user", "> nobody said this\nHello"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: None, 2: None, 3: 1, 4: 2, 5: 3, 6: None}
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1].position)] == [0, 1, 3, 5, 2, 4, 6]
    assert {t: (r.thread, r.depth) for t, r in got.items()} == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (1, 1), 4: (2, 1), 5: (1, 2), 6: (6, 0)}
    texts = {r.turn: r.text for r in chat.reply_ordered(spark.read.parquet(str(tmp_path / "conversations.parquet"))).collect()}
    assert texts[3] == "Why an hour?" and texts[5] == "So that it rises."


def test_a_long_quote(spark):
    """100,000 quoted lines: each is sliced once."""
    import time

    body = "\n".join(f"> line {i}" for i in range(100_000))
    rows = [(1, 0, "user", body.replace("> ", "")), (1, 1, "user", body + "\nyes")]
    begun = time.time()
    got = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert got[1].reply_to == 0 and got[1].text == "yes" and got[1].n_quoted == 100_000 and time.time() - begun < 90


@pytest.fixture(scope="module")
def planted():
    """(text, secret or None): half of them look like secrets and are none."""
    rng = random.Random(31)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for i in range(400):
        value = [pick(hexa, 40), pick(b62, 32), "AKIA" + pick(b62[:26] + "234567", 16), "ghp_" + pick(b62, 36), pick(b62, 20) + "/" + pick(b62, 19)][i % 5]
        lead = ['api_key = "{}"', "export API_TOKEN={}", "aws key {}", "token: {}", 'secret_key="{}"'][i % 5]
        out.append((f"{prose(rng, 30)} {lead.format(value)} {prose(rng, 30)}", value))
    for i in range(400):
        value = [f"commit {pick(hexa, 40)}", f"sha256: {pick(hexa, 64)}", f"request id {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", f"/usr/share/{prose(rng, 3).replace(' ', '/')}/page{i}.html", 'api_key = "YOUR_API_KEY_HERE_123"', f"image {pick(hexa, 20)}.png", "getUserAccountSettings2Handler(", f"order {pick('0123456789', 18)}"][i % 8]
        out.append((f"{prose(rng, 30)} {value} {prose(rng, 30)}", None))
    return out


def test_secrets_among_look_alikes(spark, planted, tmp_path):
    """Precision and recall through the query; the figures are those of the README."""
    rows = [(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(planted)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.query(spark, str(tmp_path)).collect()}
    hit = wrong = 0
    for i, (text, value) in enumerate(planted):
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s]
        found = {text[a:b] for a, b in spans}
        hit += value in found if value else 0
        wrong += len(found - {value})
    candidates = sum(r.n_candidates for r in got.values())
    print(f"secrets: candidates {candidates}, recall {hit / 400:.3f}, precision {hit / (hit + wrong):.3f}")
    assert candidates > 650 and hit >= 380 and wrong <= 12


def test_personal_data_among_look_alikes(spark, tmp_path):
    rng = random.Random(13)
    fresh = pii.labelled_texts(1500, seed=501)
    rows = [(i, f"{prose(rng, 20)} {t} {prose(rng, 20)}", "en", "s", 0) for i, (t, _) in enumerate(fresh)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    caught = [got[i].n_spans > 0 for i, (_, gold) in enumerate(fresh) if gold]
    print(f"personal data: recall {sum(caught) / len(caught):.3f}")
    assert sum(caught) / len(caught) >= 0.9
