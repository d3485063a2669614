"""Sharding, packing, mixing, token files and quality rules against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import clashing, docs_of

from stepweave.llm import mixing, packing, quality, sharding, token_files, tokens

key = lambda x: (x is not None, x)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def all_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# sharding


def check_shards(rows, n):
    """rows: (doc_id, size, shard, slot)."""
    by = defaultdict(list)
    for doc_id, size, shard, slot in rows:
        by[shard].append((slot, doc_id, size))
    total, largest = sum(r[1] for r in rows), max(r[1] for r in rows)
    last = None
    for shard in sorted(by):
        assert 0 <= shard < n
        got = sorted(by[shard], key=lambda x: x[0])
        assert [g[0] for g in got] == list(range(len(got)))
        assert abs(sum(g[2] for g in got) - total / n) <= largest
        ids = [g[1] for g in got]
        assert ids == sorted(ids, key=key)
        assert last is None or key(last) <= key(ids[0])
        last = ids[-1]


def test_shards_are_contiguous_and_balanced(all_docs, odd_docs, odd_rows):
    got = sharding.shard_documents(all_docs, 40).collect()
    check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in got], 40)
    got = sharding.shard_documents(clashing(odd_docs), 7).collect()
    check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in got], 7)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_shards_of_nothing_and_of_one(spark, no_docs):
    assert sharding.shard_documents(no_docs, 40).collect() == []
    got = sharding.shard_documents(docs_of(spark, [(1, "a", "s")]), 40).collect()
    assert len(got) == 1 and got[0].slot == 0


def test_written_shards_hold_all_texts(spark, odd_docs, odd_rows, tmp_path):
    sharding.write_shards(odd_docs, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t) for i, t, _ in odd_rows)


# tokens and packing


def test_chunk_encoder_equals_the_library(library, odd_rows, monkeypatch):
    import random

    rng = random.Random(1)
    alphabet = list("ab 'sé  　\t\n1.,<日\u0085") + ["  ", " x", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + [t or "" for _, t, _ in odd_rows]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    enc = tokens.Encoder(tokens.default_path())
    for block in (256, 1 << 21):
        monkeypatch.setattr(tokens, "BLOCK", block)
        ids, first = enc.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == library(text)


def check_packing(got, rows, library, window=1024):
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*library(text), 0], "<u4")
        for s in range(0, len(ids), window):
            want[doc_id, s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by) == list(range(len(by)))
    return sum(r.length for r in got) / (len(by) * window)


def test_packing(all_docs, odd_docs, odd_rows, no_docs, library):
    rows = [(r.doc_id, r.text, None) for r in all_docs.collect()]
    assert check_packing(packing.pack(all_docs).collect(), rows, library) > 0.95
    check_packing(packing.pack(clashing(odd_docs)).collect(), odd_rows, library)
    assert packing.pack(no_docs).collect() == []


def test_packing_in_many_parts(spark, library, monkeypatch):
    """One row that is two thirds of all, and more parts than the least number."""
    monkeypatch.setattr(packing, "SALTS", 2)
    monkeypatch.setattr(packing, "PART", 20)
    rows = [(7, "a b c " * 700, "s")] * 200 + [(i, "d e " * (i % 50), "s") for i in range(100)]
    check_packing(packing.pack(docs_of(spark, rows).repartition(4)).collect(), rows, library)


def test_plan_places_every_piece_and_fills_windows():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 1025, 200_000).tolist())
    plan = packing.make_plan(dict(counts), 1024)
    placed = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 1024
        for v in lengths:
            placed[v] += n
    assert placed == counts
    sequences = sum(n for _, n in plan)
    assert sum(k * v for k, v in counts.items()) / (1024 * sequences) > 0.97
    solved = sum(n for lengths, n in plan if sum(lengths) == 1024)
    assert solved > 0.8 * sequences


# token files


def check_token_files(spark, docs, rows, library, uri, n_shards=None):
    got = token_files.read(token_files.write(docs, uri, n_shards=n_shards), uri).collect()
    order = sorted(rows, key=lambda r: key(r[0]))
    want, at = {}, 0
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        by[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r[0] for r in order]
    want = defaultdict(list)
    for doc_id, text, _ in rows:
        ids = np.array([*library(text), 2], "<u4")
        want[doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}


def test_token_files(spark, all_docs, odd_docs, odd_rows, no_docs, library, tmp_path):
    check_token_files(spark, all_docs, [(r.doc_id, r.text, None) for r in all_docs.collect()], library, f"file://{tmp_path}/a")
    uri = f"file://{tmp_path}/b"
    check_token_files(spark, clashing(odd_docs), odd_rows, library, uri, 3)
    text = next(t for i, t, _ in odd_rows if i == 63)
    assert token_files.lookup(uri, 63).tolist() == [*library(text), 2]
    assert token_files.lookup(uri, 5, 2) is not None and token_files.lookup(uri, 5, 3) is None
    assert token_files.lookup(uri, 10**9) is None
    uri = f"file://{tmp_path}/c"
    assert token_files.read(token_files.write(no_docs, uri), uri).collect() == []
    assert token_files.lookup(uri, 1) is None


def test_token_files_of_one_repeated_key(spark, library, tmp_path):
    """A doc_id that most rows share takes several shards; its rows are numbered on from shard to shard."""
    rows = [(5, f"text {i}", "s") for i in range(900)] + [(i, "other", "s") for i in range(40)] + [(None, "none", "s")] * 300
    uri = f"file://{tmp_path}/a"
    docs = docs_of(spark, rows).repartition(6)
    keys = token_files.write(docs, uri, n_shards=6)
    assert Counter((r.doc_id, r.occurrence) for r in keys.collect()) == Counter([(5, k) for k in range(901)] + [(i, 0) for i in range(40) if i != 5] + [(None, k) for k in range(300)])
    assert len(list((tmp_path / "a").glob("shard-*.ids"))) >= 4
    check_token_files(spark, docs, rows, library, f"file://{tmp_path}/b", 6)
    assert sorted(token_files.lookup(uri, 5, k).tolist() for k in range(901)) == sorted([*library(t), 2] for i, t, _ in rows if i == 5)
    assert token_files.lookup(uri, 5, 901) is None and token_files.lookup(uri, None, 299).tolist() == [*library("none"), 2]


def test_token_files_of_string_keys(spark, library, tmp_path):
    rows = [(f"doc-{i:03d}", f"text {i}", "s") for i in range(50)] + [(None, "x", "s"), ("", "y", "s"), ("doc-001", "again", "s")]
    uri = f"file://{tmp_path}/a"
    check_token_files(spark, spark.createDataFrame(rows, "doc_id string, text string, source string"), rows, library, uri, 3)
    assert token_files.lookup(uri, "doc-007").tolist() == [*library("text 7"), 2] and token_files.lookup(uri, "doc-999") is None
    with pytest.raises(Exception, match="whole numbers or strings"):
        token_files.write(spark.createDataFrame([(1.5, "x")], "doc_id double, text string"), f"file://{tmp_path}/c")


def test_perfect_hash_is_minimal_and_rejects_strangers(tmp_path):
    h = tokens.mix64(np.arange(1, 20_001, dtype=np.uint64))
    levels, rest = token_files.build(h)
    slots = token_files.Mph(levels, rest).slots(h)
    assert sorted(slots.tolist()) == list(range(len(h)))
    assert sum(w.nbytes for w in levels) * 8 < 5 * len(h)
    (tmp_path / "index").mkdir()
    n = np.arange(len(h))
    token_files.save_bucket(f"file://{tmp_path}", 0, h, n, n, n)
    found = token_files.find(f"file://{tmp_path}", 1, h)
    assert (found["n"] == n).all()
    strangers = token_files.find(f"file://{tmp_path}", 1, tokens.mix64(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64)))
    assert (strangers["n"] == np.iinfo(np.uint64).max).mean() > 0.999


# mixing


def check_mix(got, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1e-6
    return {s: abs(taken[s] - target[s]) for s in names}


def test_mix(all_docs, odd_docs, odd_rows, no_docs):
    got = mixing.mix(all_docs).collect()
    check_mix(got, [(r.doc_id, r.text, r.source) for r in all_docs.collect()])
    again = mixing.mix(all_docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    got = mixing.mix(clashing(odd_docs)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in odd_rows)
    check_mix(got, odd_rows)
    assert mixing.mix(no_docs).collect() == []


def test_mix_refines_only_the_boundary_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 4)
    monkeypatch.setattr(mixing, "LEVELS", 6)
    rows = [(i, "a " * (1 + i % 7), f"s{min(i % 9, 3)}") for i in range(3000)]
    off = check_mix(mixing.mix(docs_of(spark, rows)).collect(), rows)
    assert max(off.values()) <= 7


def test_mix_takes_repeated_rows_one_by_one(spark, sf):
    """A row that a third of a source repeats: targets are met to half a row, however rows are dealt, as in the SQL."""
    rows = [(7, "a b c d e f g", "s1")] * 700 + [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(1400)] + [(None, None, None)] * 30
    got = mixing.mix(docs_of(spark, rows).repartition(5)).collect()
    assert max(check_mix(got, rows).values()) <= 4.5
    seen = lambda xs: Counter(tuple(r) for r in xs)
    assert seen(got) == seen(mixing.mix(docs_of(spark, rows).repartition(2)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == Counter((i, n, m, round(t, 6), k) for i, n, m, t, k in con.execute(mixing.ORACLE).fetchall())


# quality


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd_docs, odd_rows, no_docs):
    more = [(100 + i, t, "src1") for i, t in enumerate(["a b c d e " * 4, "a b c d e f a b c d e f", "l\nl\nl\n \n \n#$%", "a a a a a a", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"])]
    docs = odd_docs.unionByName(docs_of(spark, more))
    got = quality.judge(clashing(docs)).collect()
    measures = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert Counter(map(measures, got)) == Counter((i, *plain_quality(t)) for i, t, _ in odd_rows + more)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(no_docs).collect() == []


def test_a_failing_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "bad", f"h{i % 5}") for i in range(500)] + [(1000 + i, good if i % 10 == 0 else "bad", "worst") for i in range(200)] + [(2000, "bad", "small"), (2001, good, "small")]
    kept = {r.doc_id: r.kept for r in quality.judge(docs_of(spark, rows)).collect()}
    assert all(kept[i] == (i % 10 != 0) for i in range(500))
    assert not any(kept[1000 + i] for i in range(200))
    assert kept[2001] and not kept[2000]


@pytest.mark.parametrize("module", [sharding, mixing, quality], ids=["sharding", "mixing", "quality"])
def test_sql_agrees(spark, sf, module):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want, got = con.execute(module.ORACLE), module.query(spark, sf)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(names).collect())
