"""Personal data against Python's own regular expressions, and the trees on labels they have not seen."""

import hashlib
import random
import re
from collections import Counter

import pytest
from cases import clashing, docs_of
from pyspark.sql import functions as F

from stepweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        if kind == "email" and "@" not in (text or ""):
            continue  # this plain search takes a time that grows with the square of a word
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(d) <= 19 and d == pii.luhn_fixed(d) if d else False, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def noisy(odd_rows):
    rng = random.Random(9)
    bits = ["a.b@c.d", "@", ".", "1.2.3.4", "255", "256", "+", "+1 (743) 555-3824", "4785380592391139", "4785 3805 9239 1139", "-", " ", "é", "x_d@e.f", "b.c_d@e.f", "0", "00", "7", "(", "\x01", "日", "a", "\n", "999.1.1.1", "1.2.3.4.5.6.7.8"]
    rows = [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40))), "s") for i in range(1500)]
    return [*odd_rows, *rows, (5000, "1 " * 40_000, "s"), (5001, "9" * 120_000, "s"), (5002, "a" * 120_000 + "@b" + ".c" * 30_000, "s"), (5003, "1.2.3.4 " * 500, "s"), (5004, "+1" + "(" * 50_000, "s")]


def test_base_spans(spark, noisy, no_docs):
    got = pii.detect(clashing(docs_of(spark, noisy)))
    rows = [(r.doc_id, r.text, tuple(map(tuple, r.base))) for r in pii.detect(docs_of(spark, noisy), carry=("text",)).collect()]
    assert len(rows) == len(noisy)
    for doc_id, text, base in rows:
        assert list(base) == plain(text), (doc_id, text)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in noisy)
    assert pii.detect(no_docs).collect() == []


def test_query_digests(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.query(spark, sf).collect():
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(digest(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, digest(base).split(","))) <= set(filter(None, r.spans.split(",")))


def test_trees_on_unseen_labels(spark):
    fresh = pii.labelled_texts(1200, seed=77)
    got = pii.detect(docs_of(spark, [(i, t, "s") for i, (t, _) in enumerate(fresh)])).collect()
    hit = wrong = 0
    for r in got:
        base = set(map(tuple, r.base))
        added = {(s, e) for s, k, e in map(tuple, r.spans) if (s, k, e) not in base}
        gold = set(fresh[r.doc_id][1])
        hit += len(added & gold)
        wrong += len(added - gold)
    total = sum(len(s) for _, s in fresh)
    assert hit / total > 0.75 and wrong <= 0.04 * hit


def test_clean_prose_stays_clean(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 8))) for _ in range(300)) + " in 1984, at 10:30, 3.14 and 12 345" for _ in range(50)]
    assert all(not r.spans for r in pii.detect(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect())


def test_redact(spark):
    rows = [(1, "é mail a.b@c.de now 1.2.3.4", "s"), (2, None, "s"), (3, "call (743) 555-3824 now", "s"), (4, "", "s")]
    out = pii.redact(docs_of(spark, rows).withColumn("spans", F.lit(1)))
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == [*docs_of(spark, rows).columns, "spans"]
    assert got == {1: "é mail [EMAIL] now [IP]", 2: None, 3: "call [PHONE] now", 4: ""}


def test_recall_by_kind(spark):
    assert all(limit < float("inf") for limit in pii.fit(spark)[1].values())
    fresh = pii.labelled_texts(3000, seed=78)
    hit, total, wrong = Counter(), Counter(), Counter()
    for r in pii.detect(docs_of(spark, [(i, t, "s") for i, (t, _) in enumerate(fresh)])).collect():
        base, gold = set(map(tuple, r.base)), set(fresh[r.doc_id][1])
        hit.update(pii.KINDS[k] for s, k, e in map(tuple, r.spans) if (s, e) in gold)
        wrong.update(pii.KINDS[k] for s, k, e in map(tuple, r.spans) if (s, k, e) not in base and (s, e) not in gold)
        for s, e in gold:
            v = fresh[r.doc_id][0][s:e]
            total["email" if re.search("@|at", v) else "ip" if ":" in v else "card" if len(re.sub("[^0-9]", "", v)) == 16 else "phone"] += 1
    assert all(hit[k] / total[k] >= 0.9 and wrong[k] <= 0.04 * hit[k] for k in pii.KINDS), (hit, wrong, total)


def test_separated_cards_and_short_addresses(spark):
    values = ["4111.1111.1111.1111", "4111_1111_1111_1111", "4111/1111/1111/1111", "2001:db8::8a2e:370:7334", "fe80::1", "2001:db8:85a3::", "::ffff:192.0.2.128"]
    clean = ["Face::Bed", "1:2:3:4:5:6:7::8:9", "1::2::3", "std::dec", "fe80::1x"]
    lead = {"card": "pay with card ", "ip": "ping host "}
    kind = lambda v: "ip" if ":" in v else "card"
    rows = [(i, f"{lead[kind(v)]}{v} dear son", "s") for i, v in enumerate(values)] + [(100 + i, f"lorem dear {v} son", "s") for i, v in enumerate(clean)]
    got = {r.doc_id: {(rows[r.doc_id][1][s:e], pii.KINDS[k]) for s, k, e in map(tuple, r.spans)} if r.doc_id < 100 else r.spans for r in pii.detect(docs_of(spark, rows)).collect()}
    assert all((v, kind(v)) in got[i] for i, v in enumerate(values)), got
    assert all(not got[i] for i in got if i >= 100), got


def test_labels_without_a_threshold(spark):
    with pytest.raises(ValueError, match="card"):
        pii.fit(spark, pii.labelled_texts(600, seed=3))


def test_many_matches_in_one_text(spark):
    """200,000 matches of every kind of work: places, base spans over candidates, and cuts of the text."""
    import time

    unit = "a.b@c.de 1.2.3.4 fe80::1 x(at)y.com "
    text, begun = "é" + unit * 50_000, time.time()
    docs = docs_of(spark, [(1, text, "s")])
    r = pii.detect(docs).collect()[0]
    assert len(r.base) == 100_000 and [tuple(x) for x in r.base[:2]] == [(1, 0, 9), (10, 1, 17)] and tuple(r.base[-1]) == (1 + len(unit) * 49_999 + 9, 1, 1 + len(unit) * 49_999 + 16)
    assert len(r.spans) >= 150_000
    assert pii.redact(docs).collect()[0].text.startswith("é[EMAIL] [IP] ")
    assert time.time() - begun < 120


def test_running_and_uncovered(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 129, 4096, 4097, 20_000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<long>")
    import itertools

    got = df.select("i", F.expr(pii.running("v", pii.add)).alias("sums"), F.expr(pii.running("v", pii.most)).alias("tops")).collect()
    for r in got:
        assert r.sums == list(itertools.accumulate(rows[r.i])) and r.tops == list(itertools.accumulate(rows[r.i], max))

    def spans(n):
        out = sorted((s, s + rng.randrange(1, 12)) for s in (rng.randrange(300) for _ in range(n)))
        return [(a, b, "", "", "") for a, b in out]

    pairs = [(i, spans(rng.randrange(0, 200)), [(a, 0, b) for a, b, *_ in spans(rng.randrange(0, 100))]) for i in range(40)]
    df = spark.createDataFrame(pairs, f"i int, found {pii.SPAN}, base array<struct<start:int,k:int,end:int>>")
    for r in df.select("i", F.expr(pii.uncovered("found", "base")).alias("kept")).collect():
        _, found, base = pairs[r.i]
        assert sorted((k.start, k.end) for k in r.kept) == sorted((a, b) for a, b, *_ in found if not any(x <= a and y >= b for x, _, y in base))


def test_redaction_against_plain(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("aé日\U0001f600 \n") for _ in range(rng.choice([0, 5, 511, 512, 513, 3000])))
        spots = sorted((a, k, min(len(text), a + rng.randint(1, 700))) for a, k in ((rng.randrange(len(text)), rng.randrange(4)) for _ in range(rng.randint(1, 9)))) if text else []
        rows.append((i, text, spots))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,k:int,end:int>>").filter("size(spans) > 0")
    for r in df.select("i", pii.redacted("text", "spans").alias("out")).collect():
        _, text, spots = rows[r.i]
        out, at = "", 0
        for a, k, b in spots:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        assert r.out == out + text[at:]
