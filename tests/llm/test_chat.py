"""Quotation links against plain Python, and the SQL."""

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from stepweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def parse(text):
    out = []
    for x in (text or "").split("\n"):
        m = re.match(r"^[ \t]{0,3}(?:>[ \t]?)+", x)
        out.append((m[0].count(">") if m else 0, x[m.end() :] if m else x))
    return out


def units(text):
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    return {re.sub(r"\s+", " ", p.lower()).strip(" ") for p in parts} - {""}


def plain(rows):
    said, info = defaultdict(dict), []
    for conv, turn, _, text in rows:
        l = parse(text)
        own = "\n".join(b for i, (k, b) in enumerate(l) if not k and not (re.search(chat.ANNOUNCES, b) and i + 1 < len(l) and l[i + 1][0]))
        own = own.strip(" \t\n")
        info.append((l, own))
        if conv is not None and turn is not None:
            for u in units(own):
                said[conv][u] = min(said[conv].get(u, turn), turn)
    quotes = defaultdict(set)
    for (conv, turn, _, _), (l, _) in zip(rows, info, strict=True):
        i = 0
        while i < len(l):
            j = i
            while j < len(l) and l[j][0] == l[i][0]:
                j += 1
            if l[i][0] and conv is not None and turn is not None:
                quotes[conv, turn] |= {(l[i][0], u) for u in units("\n".join(b for _, b in l[i:j]))}
            i = j
    parent, linked = {}, {}
    for (conv, turn), found in quotes.items():
        weight = defaultdict(int)
        for level, u in found:
            source = said[conv].get(u)
            if source is not None and source < turn:
                weight[level, source] += len(u)
                linked[conv, turn] = linked.get((conv, turn), 0) + 1
        if weight:
            parent[conv, turn] = max((-level, w, source) for (level, source), w in weight.items())[2]
    out = []
    for (conv, turn, role, _), (l, own) in zip(rows, info, strict=True):
        thread, depth = turn, 0
        while (conv, thread) in parent:
            thread, depth = parent[conv, thread], depth + 1
        out.append((conv, turn, role, own, sum(k > 0 for k, _ in l), parent.get((conv, turn)), linked.get((conv, turn), 0), thread, depth))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    out = []
    for conv in range(30):
        texts = []
        for turn in range(rng.choice([1, 3, 8, 40])):
            parts = []
            if texts and rng.random() < 0.7:
                source = rng.choice(texts)
                if rng.random() < 0.4:
                    parts.append("Somebody wrote:")
                l = source.split("\n")
                a = rng.randrange(len(l))
                parts += [rng.choice(["> ", ">", " > "]) + (x.upper() if rng.random() < 0.2 else x) for x in l[a : a + rng.randint(1, 6)]]
            parts += [" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4))]
            if rng.random() < 0.2:
                parts.append("thanks")
            texts.append("\n".join(parts))
            out.append((conv, turn, rng.choice(["user", "assistant", None]), texts[-1]))
    return out


def check(got, rows):
    key = lambda r: str(tuple(r))
    assert sorted(((r.conv_id, r.turn, r.role, r.text, r.n_quoted, r.reply_to, r.n_linked, r.thread, r.depth) for r in got), key=key) == sorted(plain(rows), key=key)
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for found in by.values():
        found.sort(key=lambda r: r.position)
        assert [r.position for r in found] == list(range(len(found)))
        order = [((r.thread is not None, r.thread), (r.turn is not None, r.turn)) for r in found]
        assert order == sorted(order)


def test_links(spark, rows):
    messages = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = chat.reply_ordered(messages).collect()
    assert sum(r.reply_to is not None for r in got) > 100 and max(r.depth for r in got) > 3
    check(got, rows)


def test_odd_rows(spark, rows):
    odd = rows[:50] + [(None, 1, "user", "> x"), (None, None, None, None), (1, None, "user", "> a\nb"), (2, 5, "user", None), (900, 1, "user", ""), (901, 0, "user", ">" * 500 + " deep"), (902, 0, "user", "word " * 30_000), (902, 1, "user", "> " + "word " * 30_000)]
    odd += [(903, 0, "user", "first words here"), (903, 1, "user", "> first words here\nyes"), (903, 1, "user", "> first words here\nyes")]
    messages = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("thread", "depth", "position", "level", "hash", "weight", "source", "_own", "n_linked")})
    check(chat.reply_ordered(messages).collect(), odd)
    assert chat.reply_ordered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chats(spark, rows, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 10)
    ordered = chat.reply_ordered(spark.createDataFrame(rows, SCHEMA))
    got = chat.chats(ordered).collect()
    assert all([m.position for m in r.messages] == list(range(10 * r.segment, 10 * r.segment + len(r.messages))) for r in got)
    assert sum(len(r.messages) for r in got) == len(rows)


def test_sql_agrees(spark, sf, rows, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = chat.query(spark, sf)
    want = con.execute(chat.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(names).collect())
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(map(str, con.execute(chat.ORACLE).fetchall()))
    assert want == sorted(str(tuple(r)) for r in chat.query(spark, str(tmp_path)).select(names).collect())
