"""The stages against plain Python, each on what the one before kept."""

import re
import time
from collections import Counter

import corpus_pipeline
import pytest
from cases import docs_of
from pyspark.sql import functions as F
from test_jaccard import brute
from test_tables import check_packing, check_mix, library, plain_quality  # noqa: F401

from stepweave.llm import jaccard, mixing, quality, secrets
from stepweave.llm.common import release, stored


@pytest.mark.parametrize("odd", [False, True], ids=["documents", "odd rows"])
def test_stages(spark, sf, odd_docs, library, odd):  # noqa: F811
    docs = odd_docs if odd else spark.read.parquet(f"{sf}/documents.parquet")
    row = lambda r: (r.doc_id, r.text, r.source)
    before = [row(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        got = out.collect()
        after = Counter(row(r) for r in got)
        if name == "quality_rules":
            ok = lambda t: (lambda n, _, __, ___, k: n >= 10 and 100 * k <= 20 * n)(*plain_quality(t))
            assert after == Counter(r for r in before if ok(r[1]))
        elif name == "ngram_jaccard":
            classes = {d: c for d, n, c in brute(before) if n}
            ids = Counter(r[0] for r in after.elements())
            assert set(ids) == set(classes.values()) and set(ids.values()) == {1}
            assert not after - Counter(before)
        elif name == "secret_scan":
            assert Counter(r[0] for r in after.elements()) == Counter(r[0] for r in before)
            changed = Counter(before) - after
            assert all("[SECRET]" in r[1] for r in (after - Counter(before)))
            found = {r.doc_id for r in secrets.scan(docs).collect() if r.n_secrets}
            assert {r[0] for r in changed} == found
            assert all(r.n_chars == len(r.text) for r in got)
        else:
            copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
            assert after == Counter({r: copies[r[0], r[2]] for r in before if copies[r[0], r[2]]})
            check_mix(mixing.mix(docs).collect(), before)
        docs, before = out, [row(r) for r in got]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(packed, before, library)


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "secret_scan", "source_mix", "packing"]


def test_no_documents(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
    assert docs_of(spark, []).count() == 0


def test_stages_keep_clashing_columns(spark, odd_docs):
    from cases import clashing

    wide = clashing(odd_docs).withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce("text", F.lit(""))) for n in ("size", "target", "source_size", "word_chars", "n_words", "base_failed", "kept", "copies", "_copy", "_host", "_own_size")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        narrow = Counter((r.doc_id, r.text, r.source) for r in stage(spark, odd_docs, "").collect())
        out = stage(spark, wide, "")
        assert out.columns == wide.columns
        got = out.collect()
        assert Counter((r.doc_id, r.text, r.source) for r in got) == narrow, name
        if name != "secret_scan":
            assert all(r[n] == f"{n} {r.text or ''}" for r in got for n in ("size", "target", "source_size", "n_words", "kept", "_copy", "_own_size")), name
        assert all(r["taken"] == "clash" for r in got), name


def test_quality_rules_write_no_texts(spark, sf, monkeypatch):
    """A copy of the texts would stay beside the stage's result until the job ends."""
    docs, written = spark.read.parquet(f"{sf}/documents.parquet"), []
    monkeypatch.setattr(quality, "stored", lambda df, name="table": written.append((df.columns, out := stored(df, name), out.count())) or out)
    assert 0 < corpus_pipeline.quality_rules(spark, docs, "").count() < docs.count()
    assert written and all(not any("text" in c for c in columns) for columns, _, _ in written)
    assert all(n <= docs.select("source").distinct().count() for _, _, n in written)


def test_near_duplicates_leave_no_shuffle_files(spark, sf, monkeypatch):
    """After each shuffle of about the input's size its files go, without waiting for the driver to run out of memory."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    data = lambda: {f for f in re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(","))}
    seen = []

    def noted(session):
        before = data() - others
        release(session)
        for _ in range(30):
            if before - data():
                break
            time.sleep(0.1)
        seen.append(before - data())

    release(spark)
    time.sleep(1)
    others = data()
    monkeypatch.setattr(jaccard, "release", noted)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < corpus_pipeline.near_duplicates(spark, docs, "").count() <= docs.count()
    assert len(seen) == 3 and any(seen), seen


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_near_duplicates_move_few_texts(spark, sf, monkeypatch, bits):
    """Rows that one look at a small map tells to stay don't go through a shuffle; with a tiny map all do, with one result."""
    monkeypatch.setattr(jaccard, "MOVED_BITS", bits)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.union(docs.limit(50)).union(docs.limit(20).withColumn("text", F.lit(None).cast("string")))
    got = Counter(corpus_pipeline.near_duplicates(spark, twice, "").select("doc_id", "text").collect())
    rows = [(r.doc_id, r.text, r.source) for r in twice.collect()]
    classes = {d: c for d, n, c in brute(rows) if n}
    assert Counter(d for (d, t) in got.elements() if t) == Counter(set(classes.values()))
    assert Counter(d for (d, t) in got.elements() if t is None) == Counter(d for d, t, _ in rows if t is None)
    stays = jaccard.one_of_each(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert stays.startswith("Union") and stays.count("Window") == 1
