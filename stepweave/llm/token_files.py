"""Token ids in raw binary shards with keyed access through a minimal perfect hash.

shard-NNNNN.ids   the ids of a range of doc_ids, in order, little-endian unsigned 16-bit numbers (32-bit where the
                  vocabulary needs them), nothing else
index/bucket-NNNNN.mph   the keys whose digest falls into the bucket: bit arrays of the minimal perfect hash, ranks at
                  their words, and by slot a 32-bit fingerprint, shard, first id and number of ids

A key is (doc_id, occurrence), occurrence 0 but for repeated doc_ids; a doc_id is a whole number or a string. Rows are
dealt to shards by doc_id and row, so a doc_id that very many rows share takes several shards. A lookup hashes the key to its bucket, walks the
bit arrays (under two steps on average), compares the fingerprint, and reads the payload at the stored offset: constant
time whatever the number of documents. Files are written under another name and moved, so a task may run again.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import dropped_with_stored, partitions, shared_dir, small_batches, stored, trimmed
from stepweave.llm.tokens import column_bytes, default_path, encoder, mix64, with_end

#: Keys in an index bucket on average; bits per key and level; levels before keys are listed as they are.
BUCKET_KEYS, GAMMA, LEVELS = 1 << 15, 2, 24


def files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, name: str, write) -> None:
    """write(stream) into uri/name, visible only when complete."""
    system, root = files(uri)
    part = f"{root}/{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        write(f)
    system.move(part, f"{root}/{name}")


def digest(doc_id: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64 bits of a key; without repeated or null doc_ids no two keys share them."""
    h = mix64(doc_id.astype(np.int64).view(np.uint64))
    odd = (occurrence > 0) | null
    return np.where(odd, mix64(h + mix64(2 * occurrence.astype(np.uint64) + null.astype(np.uint64))), h)


def build(h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays (as words) of the levels, and the keys left over after the last level."""
    levels, left = [], h
    while len(left) and len(levels) < LEVELS:
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        at = (mix64(left + np.uint64(len(levels) + 1)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        levels.append(np.packbits(bits, bitorder="little").view("<u8"))
        left = left[~alone]
    return levels, left


class Mph:
    """Slots 0 to n - 1 for the n keys it was built from; any other key gets some slot or -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, np.sort(rest)
        self.ranks, total = [], 0
        for words in levels:
            n = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(n) - n)
            total += int(n.sum())
        self.total = total

    def slots(self, h: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = mix64(h[todo] + np.uint64(k + 1)) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = ranks[word[hit]] + below[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[todo]), len(self.rest) - 1)
            hit = self.rest[at] == h[todo]
            out[todo[hit]] = self.total + at[hit]
        return out


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8")])


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def save_bucket(uri: str, bucket: int, h: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray) -> int:
    levels, rest = build(h)
    mph = Mph(levels, rest)
    table = np.zeros(len(h), SLOT)
    at = mph.slots(h)
    for name, value in (("fingerprint", fingerprint(h)), ("shard", shard), ("first", first), ("n", n)):
        table[name][at] = value
    head = np.array([len(levels), len(mph.rest), len(h), *map(len, levels)], "<u8")
    raw = b"".join([head.tobytes(), *(w.tobytes() for w in levels), mph.rest.astype("<u8").tobytes(), table.tobytes()])
    write_whole(uri, f"index/bucket-{bucket:05d}.mph", lambda f: f.write(raw))
    return len(raw)


@functools.lru_cache(maxsize=8)
def load_bucket(uri: str, bucket: int) -> tuple[Mph, np.ndarray]:
    system, root = files(uri)
    with system.open_input_stream(f"{root}/index/bucket-{bucket:05d}.mph") as f:
        raw = f.read()
    n_levels, n_rest, n = (int(x) for x in np.frombuffer(raw, "<u8", 3))
    sizes = np.frombuffer(raw, "<u8", n_levels, 24)
    at, levels = 24 + 8 * n_levels, []
    for size in map(int, sizes):
        levels.append(np.frombuffer(raw, "<u8", size, at))
        at += 8 * size
    rest = np.frombuffer(raw, "<u8", n_rest, at)
    return Mph(levels, rest), np.frombuffer(raw, SLOT, n, at + 8 * n_rest)


def find(uri: str, n_buckets: int, h: np.ndarray) -> np.ndarray:
    """Slot rows of keys by digest; n is -1 (as unsigned: the largest) where the index has no such key."""
    out = np.zeros(len(h), SLOT)
    out["n"] = np.iinfo(np.uint64).max
    bucket = (h % np.uint64(n_buckets)).astype(np.int64)
    for b in np.unique(bucket):
        here = np.flatnonzero(bucket == b)
        mph, table = load_bucket(uri, int(b))
        slot = mph.slots(h[here])
        ok = slot >= 0
        here, slot = here[ok], slot[ok]
        same = table["fingerprint"][slot] == fingerprint(h[here])
        out[here[same]] = table[slot[same]]
    return out


def numbers(doc_id) -> np.ndarray:
    """64-bit numbers of the keys of an Arrow column: their own, or a hash of a string's bytes; 0 for null."""
    import pyarrow as pa

    if pa.types.is_integer(doc_id.type):
        return doc_id.cast(pa.int64()).fill_null(0).to_numpy()
    if not (pa.types.is_string(doc_id.type) or pa.types.is_large_string(doc_id.type)):
        raise TypeError(f"keys are whole numbers or strings, not {doc_id.type}")
    return np.array([int.from_bytes(hashlib.blake2b((k or "").encode(), digest_size=8).digest(), "little", signed=True) for k in doc_id.to_pylist()], np.int64)


def key_columns(batch) -> np.ndarray:
    return digest(numbers(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy())


def write(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = 2, n_shards: int | None = None) -> DataFrame:
    """Write ids of all texts, each followed by end_id, in ascending doc_id order, with the index; its keys.

    Returns doc_id, occurrence. A null or empty text is the end id alone; a null doc_id comes first and is a key.
    Rows that repeat a doc_id are numbered 0, 1, ... and each has its own ids; their order among themselves is open. An
    empty table writes no shard. Other columns of docs play no part.
    """
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    key_type = docs.schema["doc_id"].dataType.simpleString()
    system, root = files(uri)
    system.create_dir(f"{root}/index", recursive=True)

    def shard(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, number = encoder(tokenizer), TaskContext.get().partitionId()
        system, root = files(uri)
        name = f"{root}/shard-{number:05d}.ids"
        part, stream, total, last, seen = f"{name}.{uuid.uuid4().hex}.part", None, 0, object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            stream = stream or system.open_output_stream(part)
            ids, first = with_end(*enc.encode(*column_bytes(batch.column(1))), end_id)
            stream.write(ids.tobytes())
            occurrence = []
            for key in batch.column(0).to_pylist():
                seen = seen + 1 if key == last else 0
                last = key
                occurrence.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(occurrence, pa.int64()), pa.array(np.full(len(first) - 1, number)), pa.array(first[:-1] + total), pa.array(np.diff(first))], names=["doc_id", "occurrence", "shard", "first", "n"])
            total += len(ids)
        if stream:
            stream.close()
            system.move(part, name)

    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange(n_shards or partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    # runs once: what follows reads the table
    with small_batches(spark):
        entries = stored(ordered.mapInArrow(trimmed(shard), f"doc_id {key_type}, occurrence long, shard long, first long, n long"), "entries")
    entries, sums = joined_numbers(entries)
    starts, total = {}, 0
    for number, n, _ in sums:
        starts[number], total = total, total + n
    n_docs = sum(x[2] for x in sums)
    meta = {"dtype": encoder(tokenizer).dtype.str, "ids": total, "docs": n_docs, "buckets": max(1, -(-n_docs // BUCKET_KEYS)), "starts": starts}
    write_whole(uri, "meta.json", lambda f: f.write(json.dumps(meta).encode()))
    n_buckets = meta["buckets"]

    def bucketed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = key_columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(n_buckets)).astype(np.int64)), pa.array(h.view(np.int64)), *batch.columns[2:]], names=["bucket", "h", "shard", "first", "n"])

    def index(table):
        import pyarrow as pa

        bucket = table.column("bucket")[0].as_py()
        size = save_bucket(uri, bucket, table.column("h").to_numpy().view(np.uint64), *(table.column(c).to_numpy() for c in ("shard", "first", "n")))
        return pa.table({"bucket": [bucket], "bytes": [size]})

    # a bucket gets about BUCKET_KEYS keys by their digest, however the keys are spread
    built = entries.mapInArrow(trimmed(bucketed), "bucket long, h long, shard long, first long, n long").groupBy("bucket").applyInArrow(index, "bucket long, bytes long")
    built.agg(F.sum("bytes")).collect()
    return entries.select("doc_id", "occurrence")


def joined_numbers(entries: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Entries numbered on where a doc_id goes on from shard to shard, and (shard, ids, documents) of all shards in order."""
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")
    by = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.struct(key, "occurrence")).alias("last"))
    rows = sorted((r["shard"], r["ids"], r["docs"], r["lo"], r["hi"], r["last"]["occurrence"]) for r in by.collect())  # one row a shard
    moved, open_, so_far = [], None, 0
    for shard, _, _, lo, hi, last in rows:
        here = so_far if lo == open_ else 0
        if here:
            moved.append((shard, here))
        so_far = last + 1 + (here if hi == lo else 0)
        open_ = hi
    if moved:
        more = entries.sparkSession.createDataFrame(moved, "_shard long, _more long")  # a row a shard at most
        first = entries.groupBy("shard").agg(F.min(key).alias("_lo")).select(F.col("shard").alias("_shard"), "_lo").join(more, "_shard")
        on = (F.col("shard") == F.col("_shard")) & (key == F.col("_lo"))
        names = entries.columns
        entries = stored(entries.join(F.broadcast(first), on, "left").withColumn("occurrence", F.col("occurrence") + F.coalesce("_more", F.lit(0))).select(names), "entries")
    return entries, [r[:3] for r in rows]


def read_meta(uri: str) -> dict:
    system, root = files(uri)
    with system.open_input_stream(f"{root}/meta.json") as f:
        return json.loads(f.read())


def lookup(uri: str, doc_id: int | str | None, occurrence: int = 0) -> np.ndarray | None:
    """Ids of one document, from two reads; None if there is no such key."""
    meta = read_meta(uri)
    if not meta["docs"]:
        return None
    import pyarrow as pa

    h = digest(numbers(pa.array([doc_id], pa.string() if isinstance(doc_id, str) else pa.int64())), np.array([doc_id is None]), np.array([occurrence]))
    row = find(uri, meta["buckets"], h)[0]
    if row["n"] == np.iinfo(np.uint64).max:
        return None
    width = np.dtype(meta["dtype"]).itemsize
    system, root = files(uri)
    with system.open_input_file(f"{root}/shard-{int(row['shard']):05d}.ids") as f:
        return np.frombuffer(f.read_at(int(row["n"]) * width, int(row["first"]) * width), meta["dtype"])


def read(keys: DataFrame, uri: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of keys (doc_id, occurrence), from the files.

    Keys go to their index bucket, the found places to their shard, and each shard is read in order. A key that the
    index doesn't hold is left out.
    """
    meta = read_meta(uri)
    spark, key_type = keys.sparkSession, keys.schema["doc_id"].dataType.simpleString()
    n_buckets, dtype = meta["buckets"], np.dtype(meta["dtype"])
    starts = {int(k): v for k, v in meta["starts"].items()}  # one number a shard

    def bucketed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = key_columns(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((h % np.uint64(n_buckets)).astype(np.int64)), pa.array(h.view(np.int64))], names=["doc_id", "bucket", "h"])

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = find(uri, n_buckets, batch.column(2).to_numpy().view(np.uint64))
            ok = rows["n"] != np.iinfo(np.uint64).max
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), *(pa.array(rows[c][ok].astype(np.int64)) for c in ("shard", "first", "n"))], names=["doc_id", "shard", "first", "n"])

    def payload(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, root = files(uri)
        name, f = None, None
        for batch in batches:
            shard, first, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            crc = np.zeros(len(n), np.int64)
            for i, (s, a, m) in enumerate(zip(shard.tolist(), first.tolist(), n.tolist(), strict=True)):
                if s != name:
                    name, f = s, system.open_input_file(f"{root}/shard-{s:05d}.ids")
                crc[i] = zlib.crc32(np.frombuffer(f.read_at(m * dtype.itemsize, a * dtype.itemsize), dtype).astype("<u4"))
            start = np.array([starts[s] for s in shard.tolist()], np.int64) + first
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), batch.column(3), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = partitions(spark)
    found = keys.select("doc_id", "occurrence").mapInArrow(trimmed(bucketed), f"doc_id {key_type}, bucket long, h long").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(places), f"doc_id {key_type}, shard long, first long, n long")
    return found.repartition(n, "shard").sortWithinPartitions("shard", "first").mapInArrow(trimmed(payload), f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = dropped_with_stored(f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri), uri)
