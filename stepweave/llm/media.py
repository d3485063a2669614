"""Media columns: bytes stored losslessly as FLAC audio, read back with all checksums verified, and PCM blocks with
sample offsets for seeking. See flac.py for the codec; here it meets Arrow batches, a bounded number of bytes at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import flac
from stepweave.llm.common import small_batches, stored, trimmed

#: Payloads are zero-padded to a positive multiple of PAD bytes; bytes coded at a time (a longer row is alone).
PAD, CHUNK = 64, 1 << 19


def chunks(sizes: list[int]) -> Iterator[slice]:
    """Consecutive rows of about CHUNK bytes."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes of text), media (a FLAC stream of these bytes, zero-padded, one byte a sample).

    A null or empty text has n_bytes 0 and a payload of PAD zeros. One row per row of docs, repeated rows too; equal texts
    give equal streams. A very long text is coded alone, frame by frame; an empty table gives an empty result. Other
    columns of docs play no part.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = [t.encode() for t in batch.column(1).fill_null("").to_pylist()]
            for rows in chunks([len(r) for r in raw]):
                part = raw[rows]
                media = flac.encode([r + b"\0" * (-len(r) % PAD if r else PAD) for r in part])
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array([len(r) for r in part], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def feature(payload: bytes) -> str:
    """Samples, their sum and energy, zero crossings and largest step, all exact integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};step={int(np.abs(np.diff(x)).max(initial=0))}"


#: What `pcm` gives besides doc_id and n_bytes.
PCM = "media_bytes long, media_sha256 string, rate long, channels int, bits int, blocks array<struct<first_sample:long,n_samples:long,frame_offset:long,frame_bytes:long,pcm:binary>>"


def pcm(media: DataFrame) -> DataFrame:
    """Decode (doc_id, n_bytes, media): size and hash of the stream, its format, and its PCM as blocks in order.

    A block is a frame: first_sample and n_samples, where the frame is in the stream, and its samples (signed, interleaved,
    little-endian). One row per row; a stream without samples has no blocks; any FLAC stream is decoded, and one with a
    wrong checksum fails the task (flac.Corrupt): nothing is passed over. Other columns play no part.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = batch.column(2).to_pylist()
            for rows in chunks([len(r) for r in raw]):
                part = raw[rows]
                streams, tables, metas = flac.decode_pcm(part)
                flat = np.array([f for t in tables for f in t], np.int64).reshape(-1, 4)
                step = np.repeat([m["channels"] * (-(-m["bits"] // 8)) for m in metas], [len(t) for t in tables])
                cuts = np.concatenate([[0], np.cumsum(flat[:, 3] * step)]).astype(np.int32)
                samples = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(cuts), pa.py_buffer(b"".join(streams))])
                columns = [*(pa.array(flat[:, k]) for k in (0, 3, 1, 2)), samples]
                blocks = pa.ListArray.from_arrays(np.cumsum([0, *map(len, tables)]).astype(np.int32), pa.StructArray.from_arrays(columns, ["first_sample", "n_samples", "frame_offset", "frame_bytes", "pcm"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], batch.column(1)[rows], pa.array([len(x) for x in part], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()),
                        pa.array([m["rate"] for m in metas], pa.int64()), pa.array([m["channels"] for m in metas], pa.int32()), pa.array([m["bits"] for m in metas], pa.int32()), blocks,
                    ],
                    names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "rate", "channels", "bits", "blocks"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(trimmed(run), f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, {PCM}")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row per block: doc_id, block (from 0), first_sample, n_samples, frame_offset and frame_bytes in the stream, pcm.
    A reader that wants sample s takes the block with first_sample <= s, or seeks to frame_offset."""
    return pcm(media).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", F.col("block").cast("long").alias("block"), "b.*")


def write_pcm(media: DataFrame, path: str) -> None:
    """PCM blocks as Parquet; rows of a document stay in one file, in order."""
    pcm_blocks(media).write.parquet(path)


def digests(decoded: DataFrame) -> DataFrame:
    """Describe rows of `pcm` by their blocks: payload and media sizes and hashes, number of blocks, and the features.

    The payload is put together from the blocks, each at its first_sample; blocks that don't follow each other without a
    gap fail the task, as do streams that aren't mono with 8 bits (flac.Unsupported).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blocks = batch.column("blocks")
            inner, ends = blocks.flatten(), np.cumsum(blocks.value_lengths().to_numpy(zero_copy_only=False))
            first, n = (inner.field(c).to_numpy() for c in ("first_sample", "n_samples"))
            samples = inner.field("pcm").to_pylist()
            payloads, counts = [], []
            for a, b, channels, bits in zip([0, *ends[:-1].tolist()], ends.tolist(), *(batch.column(c).to_pylist() for c in ("channels", "bits")), strict=True):
                if (first[a:b] != np.cumsum(n[a:b]) - n[a:b]).any():
                    raise flac.Corrupt("a gap between blocks")
                payloads.append(flac.payload(b"".join(samples[a:b]), {"channels": channels, "bits": bits}))
                counts.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "n_bytes")), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-PAD:]) for p in payloads], pa.int64()), *(batch.column(c) for c in ("media_bytes", "media_sha256")), pa.array(counts, pa.int64()), pa.array([feature(p) for p in payloads], pa.string()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_blocks", "feature"],
            )

    return decoded.mapInArrow(trimmed(run), f"doc_id {decoded.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_blocks long, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark, 500):
        return stored(digests(pcm(encode_text(spark.read.parquet(f"{sf_dir}/documents.parquet")))), "media").select("*", F.lit("flac").alias("format"))
