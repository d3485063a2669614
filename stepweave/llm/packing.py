"""Packing token runs into windows by non-negative least squares over length combinations.

Documents are cut at multiples of the window; whole windows stand alone, and the rest pieces are packed by their length
histogram only (window + 1 numbers, whatever the corpus): all combinations of up to DEPTH lengths that fill a window are
enumerated, their repeat counts are solved against the histogram by non-negative least squares and rounded, and the
residual counts are packed greedily, best fit, longest first. A piece finds its sequence from its rank among the pieces
of its length, by binary search in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.llm.common import small_batches, stored, trimmed
from stepweave.llm.tokens import column_bytes, default_path, encoder, with_end

#: Lengths in an enumerated combination; passes of the solver.
DEPTH, STEPS = 3, 400
#: Pieces of one length are ranked in SALTS parts, and in as many more as it takes for PART pieces in each.
SALTS, PART = 128, 1 << 16


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """All a <= b <= c, c > 0, with a + b + c = window, of lengths that occur; 0 stands for no piece. (n, 3) int."""
    have = hist > 0
    have[0] = True
    rows = []
    for a in range(window // 3 + 1):
        if have[a]:
            b = np.arange(a, (window - a) // 2 + 1)
            c = window - a - b
            ok = have[b] & have[c]
            rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def solve(hist: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum of x over combinations near the histogram (accelerated projected gradient).

    Long pieces weigh more: a short one that is left over is easily placed.
    """
    size = len(hist)
    scale = max(float(hist.max()), 1.0)
    weight = np.arange(size) / (size - 1)
    weight[0] = 0
    goal = hist / scale
    forward = lambda x: sum(np.bincount(combos[:, k], x, size) for k in range(3))
    back = lambda r: sum(r[combos[:, k]] for k in range(3))
    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(weight**2 * forward(v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(y - back(weight**2 * (forward(y) - goal)) / (norm * 1.01 or 1), 0)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x * scale


def make_plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, number of such sequences)]; every counted piece is in exactly one sequence."""
    hist = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        hist[length] = n
    plan = [((window,), int(hist[window]))] if hist[window] else []
    hist[window] = 0
    combos = combinations(hist, window)
    if len(combos):
        x = np.floor(solve(hist, combos) + 0.5).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if not x[i]:
                break
            lengths = tuple(int(v) for v in combos[i][::-1] if v)
            n = min(int(x[i]), *(int(hist[v]) // lengths.count(v) for v in lengths))
            if n:
                for v in lengths:
                    hist[v] -= n
                plan.append((lengths, n))
    return plan + greedy(hist, window)


def greedy(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: each step fills a class of equal open sequences or uses up a length."""
    open_, spaces = {}, []  # space: {lengths: count}; sorted spaces

    def put(space: int, lengths: tuple[int, ...], n: int) -> None:
        if space not in open_:
            open_[space] = {}
            insort(spaces, space)
        open_[space][lengths] = open_[space].get(lengths, 0) + n

    for length in range(window, 0, -1):
        left = int(hist[length])
        while left:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                each = min(window // length, left)
                n = left // each
                put(window - each * length, (length,) * each, n)
                left -= n * each
                continue
            space = spaces[k]
            lengths, have = open_[space].popitem()
            n = min(left, have)
            if have > n:
                open_[space][lengths] = have - n
            elif not open_[space]:
                del open_[space]
                spaces.pop(k)
            put(space - length, (*lengths, length), n)
            left -= n
    return [(lengths, n) for by in open_.values() for lengths, n in by.items()]


def lookup_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length and first rank: the sequence of that rank and the offset in it; later ranks follow one by one."""
    rank, rows, sequence = {}, [], 0
    for lengths, n in plan:
        offset = 0
        for v in lengths:
            rows.append((v, rank.get(v, 0), sequence, offset))
            rank[v] = rank.get(v, 0) + n
            offset += v
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Cut each document's ids (with the end id) at multiples of window: doc_id, start, length, ids_crc32, doc_tokens, and
    again, the number of rows before with this doc_id in the batch: rows that repeat differ in it."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(tokenizer)
        for batch in batches:
            ids, first = with_end(*enc.encode(*column_bytes(batch.column(1))), end_id)
            _, key, times = np.unique(batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), return_inverse=True, return_counts=True)
            again = np.empty(len(key), np.int64)
            again[np.argsort(key, kind="stable")] = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
            size = np.diff(first)
            n = -(-size // window)
            doc = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(size[doc] - start, window)
            raw, at = memoryview(ids.astype("<u4")).cast("B"), (first[:-1][doc] + start) * 4
            crc = np.fromiter((zlib.crc32(raw[a : a + 4 * m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(size[doc]), pa.array(again[doc])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "again"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(cut), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, again long")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a very long one is cut into many pieces. Repeated rows are packed as rows of
    their own; a null doc_id is kept. An empty table gives an empty result. Other columns of docs play no part.
    """
    with small_batches(docs.sparkSession):
        cuts = stored(pieces(docs, tokenizer or default_path(), window, end_id), "pieces")
    counts = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}  # window rows at most
    table = cuts.sparkSession.sparkContext.broadcast(lookup_table(make_plan(counts, window)))  # bounded by the combinations of a window

    # ranks among the pieces of a length: counted by length and salt, then inside each of these
    many = [(n, -(-k // PART)) for n, k in counts.items() if k > SALTS * PART]  # whole windows, and few others
    salts = F.coalesce(*[F.when(F.col("length") == n, k) for n, k in many], F.lit(SALTS))
    salted = cuts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "again"), salts).cast("int"))
    ahead = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    # not broadcast by hand: it grows with the pieces, and both sides are dealt by these keys already
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(base, ["length", "_salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = table.value
        shift = np.int64(1 << 48)
        key = t["length"] * shift + t["rank"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            at = np.searchsorted(key, length * shift + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(place), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
