"""The n-gram Jaccard join against all pairs."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import clashing, docs_of

from stepweave.llm import jaccard


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            posts[g].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in posts[g]:
                shared[j] += j < i
        for j, k in shared.items():
            if j < i and 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)].append(doc_id)
    return sorted(((d, len(s), min(least[top(i)], default=None) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=260):
    """Groups of near copies around the limit, a hot group, a common passage, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    prose = lambda k: [word() for _ in range(k)]
    passage, texts = prose(60), []
    while len(texts) < n:
        base = prose(rng.randint(4, 150))
        if rng.random() < 0.3:
            at = rng.randint(0, len(base))
            base = base[:at] + passage + base[at:]
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: rng.randint(1, len(copy))]
            texts.append(" ".join(copy).upper() if rng.random() < 0.1 else " \n".join(copy))
    base = prose(80)
    for _ in range(120):  # a hot group in which few pairs are similar by themselves
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
    for k in range(1, 8):
        texts += [" ".join(prose(k))] * 2 + [" ".join(passage[:k])]
    rng.shuffle(texts)
    return [(1000 - i, t, "s") for i, t in enumerate(texts)]


def got_of(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("most", "block"), [(1 << 24, 1 << 22), (0, 1 << 22), (50, 200), (1000, 1)], ids=["pairs", "singles", "large blocks", "all by joins"])
def test_components(spark, monkeypatch, most, block):
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", most)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rows = corpus(most + block)
    assert got_of(jaccard.near_duplicates(docs_of(spark, rows).repartition(3))) == brute(rows)


@pytest.mark.parametrize(("rounds", "pairs", "size"), [(0, 0, 4), (1, 0, 3), (0, 1 << 30, 4)], ids=["four tokens", "three tokens", "pairs only"])
def test_large_blocks_by_longer_combinations(spark, monkeypatch, rounds, pairs, size):
    for name, value in (("BLOCK_TOKENS", 1), ("PIVOT_ROUNDS", rounds), ("PAIRS", pairs), ("MAX_COMBINED", size)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(3)
    assert got_of(jaccard.near_duplicates(docs_of(spark, rows).repartition(3))) == brute(rows)


def test_tokens_shared_by_chance_bring_nothing_together(spark, monkeypatch):
    """Every document shares passages with the next one, and none is similar to another: no set is fetched, no block is made."""
    rng, rows = random.Random(8), {}
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(301)]
    docs = [(i, f"{words[i]} {words[i + 1]}", "s") for i in range(300)] + [(300, f"{words[7]} {words[8]} end", "s")]
    stored = jaccard.stored

    def noted(df, name="table"):
        out = stored(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", noted)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 0)  # as in a large corpus, tokens of few documents count as rare
    assert got_of(jaccard.near_duplicates(docs_of(spark, docs).repartition(3))) == brute(docs)
    assert rows["sets"] == 2 and rows["block_nodes"] == 2


@pytest.mark.parametrize(("most", "rows"), [(4, 1), (4, 7), (4, 1000), (2, 3), (32, 5)])
def test_candidates_of_sorted_lists(most, rows):
    rng = random.Random(most * rows)
    at = sorted((rng.randint(-9, 9) * 3, rng.randint(-30, 30) * 256 + rng.choice([3, 5, 40])) for _ in range(120))
    batches = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["sig", "node"]) for part in (at[i : i + rows] for i in range(0, len(at), rows))]
    got = {(r["a"], r["b"], r["sure"]) for batch in jaccard.met(iter(batches), most) for r in batch.to_pylist()}
    lists, want = defaultdict(set), set()
    for s, n in at:
        lists[s].add(n)
    for nodes in map(sorted, lists.values()):
        pairs = [(x, y) for k, x in enumerate(nodes) for y in nodes[k + 1 :]]
        want |= {(x, y, True) for x, y in pairs if x == nodes[0]} if len(nodes) > most else {(x, y, False) for x, y in pairs if abs(x % 256 - y % 256) <= 5}
    assert got == want


@pytest.mark.parametrize("n", [1, 4, 9, 60, 64, 65, 130, 700])
def test_marks_and_sizes_rule_out_no_similar_pair(n):
    rng, ruled_out = np.random.default_rng(n), 0
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n + 3, dtype=np.uint64))
        x = rng.permutation(pool)[:n]
        y = np.concatenate([x[rng.integers(0, n // 4 + 1) :], rng.permutation(np.setdiff1d(pool, x))[: rng.integers(0, n // 3 + 1)]])
        may = jaccard.may_be_similar(jaccard.mark_of(x), n, jaccard.mark_of(y), len(y))
        if jaccard.similar(len(np.intersect1d(x, y)), n, len(y)):
            assert may and jaccard.may_be_similar(jaccard.mark_of(y), len(y), jaccard.mark_of(x), n)
            assert abs((jaccard.node_of(np.sort(x)) & 255) - (jaccard.node_of(np.sort(y)) & 255)) <= jaccard.SIZE_CODES
        z = rng.permutation(np.setdiff1d(pool, x))[:n]
        ruled_out += not jaccard.may_be_similar(jaccard.mark_of(x), n, jaccard.mark_of(z), n)
    assert n < 60 or ruled_out == 200


def test_counts_in_a_byte():
    n = np.unique(np.concatenate([np.arange(1, 2000), 2 ** np.arange(1, 45), 2 ** np.arange(1, 45) - 1]))
    code = jaccard.coded(n)
    assert (np.diff(code.astype(int)) >= 0).all() and (code[n < 128] == n[n < 128]).all() and jaccard.coded(np.array([2**38]))[0] < jaccard.coded(np.array([2**38 * 2]))[0]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert got_of(jaccard.near_duplicates(clashing(odd_docs))) == brute(odd_rows)
    assert jaccard.near_duplicates(no_docs).collect() == []
    assert jaccard.one_of_each(no_docs).collect() == []


def test_one_of_each(spark, odd_docs, odd_rows):
    kept = jaccard.one_of_each(clashing(odd_docs))
    assert kept.columns == clashing(odd_docs).columns
    rows = brute(odd_rows)
    want = defaultdict(int)
    for doc_id, n, _ in rows:
        want[doc_id] += not n
    for doc_id in {d for d, n, component in rows if n and d == component}:
        want[doc_id] += 1
    got = defaultdict(int)
    for r in kept.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("n", [2, 4, 5, 6, 9, 15, 16, 40, 200, 1000])
def test_similar_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
        x = rng.permutation(pool)[:n]
        cut = rng.integers(0, n // 5 + 1)
        y = np.concatenate([x[cut:], rng.permutation(np.setdiff1d(pool, x))[: rng.integers(0, max(1, n // 6))]])
        k = n - cut
        if not jaccard.similar(k, n, len(y)) or (cut == 0 and len(y) == n):
            continue
        frequent = np.sort(rng.permutation(pool)[: rng.integers(0, len(pool) + 1)])
        for size in (2, 3, 4) if min(len(x), len(y)) > 3 else (2,):
            a, b = (set(jaccard.prefix_signatures(np.sort(s), np.isin(np.sort(s), frequent), size).tolist()) for s in (x, y))
            assert a & b


def test_token_sets_over_block_edges(monkeypatch, odd_rows):
    texts = [t for _, t, _ in odd_rows]
    whole = [s.tolist() for s in jaccard.token_sets(pa.array(texts))]
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(jaccard, "BYTES", 50)
    few = [i for i, t in enumerate(texts) if len(t or "") < 2000]
    assert [s.tolist() for s in jaccard.token_sets(pa.array([texts[i] for i in few]))] == [whole[i] for i in few]


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(jaccard.ORACLE).fetchall(), key=str)
    assert got_of(jaccard.query(spark, sf)) == want
