"""The FLAC codec: exact round trips, the batch decoder against the one that takes any frame, and damage."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import clashing

from stepweave.llm import flac, media


def payloads():
    rng = np.random.default_rng(3)
    return [b"\0" * 64, b"a" * 64, rng.integers(0, 256, 64 * 60, dtype=np.uint8).tobytes(), b"hello world, " * 640, bytes(range(256)) * 16, b"\xff\x00" * 2048, (np.sin(np.arange(6400) / 9) * 100 + 128).astype(np.uint8).tobytes()] + [rng.integers(97, 97 + k, 64 * k, dtype=np.uint8).tobytes() for k in range(1, 26)]


def one_by_one(stream):
    meta, out = flac.metadata(stream), []
    at = meta["frames"]
    while at < len(stream):
        channels, n = flac.decode_frame(stream[at:])
        out += channels[0]
        at += n
    return bytes(v + 128 for v in out)


def test_round_trips():
    data = payloads()
    streams = flac.encode(data)
    back, tables = flac.decode(streams)
    assert back == data
    assert [one_by_one(s) for s in streams] == data
    for stream, table, payload in zip(streams, tables, data, strict=True):
        assert flac.metadata(stream)["samples"] == len(payload)
        for first, offset, size, n in table:  # each block can be read by itself
            channels, read = flac.decode_frame(stream[offset : offset + size])
            assert read == size and bytes(v + 128 for v in channels[0]) == payload[first : first + n]
    assert len(streams[3]) < 0.95 * len(data[3]) and len(streams[-1]) < len(data[-1])


@pytest.mark.parametrize("data", [[b"\0" * 64], [b"a" * 64], [bytes(range(64))], [b"\0" * 4096], [b"\0" * 64, b"b" * 4096], [b"\0" * 64] * 1500, [bytes(k * k % 251 for k in range(64))], [b"ab" * 64, b"\0" * 64]], ids=str)
def test_groups_without_linear_predictors(data):
    streams = flac.encode(data)
    assert flac.decode(streams)[0] == data == [one_by_one(s) for s in streams]


@pytest.mark.parametrize("n", [1, 511, 512, 513, 1024, 1025])
def test_every_size_of_a_group(n):
    """Short and long frames of every predictor, in groups that end before, at and after a full one."""
    rng = np.random.default_rng(n)
    kinds = [lambda k: np.zeros(k, np.uint8), lambda k: rng.integers(0, 256, k, dtype=np.uint8), lambda k: (np.arange(k) * 3 % 256).astype(np.uint8), lambda k: (np.sin(np.arange(k) / 3) * 90 + 128).astype(np.uint8)]
    data = [kinds[i % 4](64 * (1 + i % 3)).tobytes() for i in range(n - 1)] + [kinds[3](1024).tobytes()]
    assert flac.decode(flac.encode(data))[0] == data


def test_linear_predictors_are_used():
    wave = (np.sin(np.arange(8192) / 2.3) * 100 + np.sin(np.arange(8192) / 7) * 20 + 128).astype(np.uint8).tobytes()
    stream = flac.encode([wave])[0]
    meta = flac.metadata(stream)
    kinds = {stream[offset + len(flac.frame_header(first // flac.BLOCK, n))] for first, offset, _, n in flac.frame_table(stream, meta)}
    assert any(k & 0xC0 == 0x40 for k in kinds)
    assert len(stream) < 0.7 * len(wave) and flac.decode([stream])[0] == [wave]


def test_damage_is_found():
    rng = random.Random(1)
    stream = flac.encode([payloads()[3]])[0]
    start = flac.metadata(stream)["frames"]
    for _ in range(40):
        at = rng.randrange(start, len(stream))
        bad = bytearray(stream)
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises(flac.Corrupt):
            flac.decode([bytes(bad)])
    bad = bytearray(stream)
    bad[30] ^= 1  # the MD5
    with pytest.raises(flac.Corrupt):
        flac.decode([bytes(bad)])


class Writer:
    """Bits of a hand-made frame."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = 2 * v if v >= 0 else -2 * v - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)


def frame(channel_code, size, width_code, subframes):
    head = bytes([0xFF, 0xF8, 0x70, channel_code << 4 | width_code << 1]) + flac.utf8_number(0) + (size - 1).to_bytes(2, "big")
    head += bytes([flac.crc(head, flac.CRC8, 8)])
    w = Writer()
    for s in subframes:
        s(w)
    w.bits += "0" * (-len(w.bits) % 8)
    body = head + int(w.bits, 2).to_bytes(len(w.bits) // 8, "big")
    return body + flac.crc(body, flac.CRC16, 16).to_bytes(2, "big")


def test_other_kinds_of_frames():
    def constant(w):
        w.put(0, 1), w.put(0, 6), w.put(0, 1), w.put(-7, 8)

    def verbatim(w):
        w.put(0, 1), w.put(1, 6), w.put(0, 1)
        for v in range(16):
            w.put(v - 8, 8)

    def partitions(w):  # fixed order 1, two partitions: Rice and escaped
        w.put(0, 1), w.put(9, 6), w.put(0, 1), w.put(5, 8), w.put(0, 2), w.put(1, 4), w.put(2, 4)
        for v in (1, -1, 2, 0, -3, 3, 1):
            w.rice(v, 2)
        w.put(15, 4), w.put(4, 5)
        for v in (1, -1, 2, 0, -3, 3, 1, -8):
            w.put(v, 4)

    def wasted(w):  # two wasted bits
        w.put(0, 1), w.put(1, 6), w.put(1, 1), w.bits.__len__(), w.put(1, 2)
        for v in range(16):
            w.put(v - 8, 6)

    assert flac.decode_frame(frame(0, 16, 1, [constant]))[0] == [[-7] * 16]
    assert flac.decode_frame(frame(0, 16, 1, [verbatim]))[0] == [list(range(-8, 8))]
    want = np.cumsum([5, 1, -1, 2, 0, -3, 3, 1, 1, -1, 2, 0, -3, 3, 1, -8]).tolist()
    assert flac.decode_frame(frame(0, 16, 1, [partitions]))[0] == [want]
    assert flac.decode_frame(frame(0, 16, 1, [wasted]))[0] == [[4 * v for v in range(-8, 8)]]
    assert flac.decode_frame(frame(1, 16, 1, [constant, verbatim]))[0] == [[-7] * 16, list(range(-8, 8))]

    def side(w):
        w.put(0, 1), w.put(1, 6), w.put(0, 1)
        for v in range(16):
            w.put(v, 9)

    assert flac.decode_frame(frame(8, 16, 1, [verbatim, side]))[0] == [list(range(-8, 8)), [-8] * 16]
    right = flac.decode_frame(frame(9, 16, 1, [side, verbatim]))[0]
    assert right == [[v + v - 8 for v in range(16)], list(range(-8, 8))]
    mid = flac.decode_frame(frame(10, 16, 1, [verbatim, side]))[0]
    assert [a - b for a, b in zip(*mid, strict=True)] == list(range(16))


def whole_stream(frames, channels, bits, samples, pcm, rate=44100):
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)


def test_streams_of_other_formats(spark):
    """Stereo with 16 bits and without seek points: PCM blocks, but no payload."""

    def verbatim(values, bits):
        def put(w):
            w.put(0, 1), w.put(1, 6), w.put(0, 1)
            for v in values:
                w.put(v, bits)

        return put

    left, right = list(range(-300, -284)), list(range(1000, 1016))
    pcm = np.array([left, right], "<i2").T.tobytes()
    stream = whole_stream([frame(1, 16, 4, [verbatim(left, 16), verbatim(right, 16)])] * 3, 2, 16, 48, pcm * 3)
    got, tables, _ = flac.decode_pcm([stream, flac.encode([b"x" * 64])[0], stream])
    assert got[0] == got[2] == pcm * 3 and got[1] == bytes([ord("x") ^ 0x80]) * 64
    assert [(f[0], f[3]) for f in tables[0]] == [(0, 16), (16, 16), (32, 16)]
    with pytest.raises(flac.Unsupported):
        flac.decode([stream])
    rows = media.pcm_blocks(spark.createDataFrame([(1, 0, bytearray(stream))], "doc_id long, n_bytes long, media binary")).orderBy("block").collect()
    assert [bytes(r.pcm) for r in rows] == [pcm] * 3 and [r.first_sample for r in rows] == [0, 16, 32]
    bad = bytearray(stream)
    bad[-1] ^= 1
    with pytest.raises(flac.Corrupt):
        flac.decode_pcm([bytes(bad)])


@pytest.mark.parametrize("texts", [[None], [""], [None, ""], ["a"], ["a" * 5000, None], [" " * 64, "b" * 63, ""]], ids=str)
def test_tables_of_short_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in media.digests(media.pcm(media.encode_text(docs))).collect():
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.n_blocks) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), -(-len(data) // flac.BLOCK))


def test_query_columns(spark, odd_docs, odd_rows, no_docs):
    stored = media.encode_text(clashing(odd_docs)).cache()
    got = media.digests(media.pcm(stored)).collect()
    want = []
    for doc_id, text, _ in odd_rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    files = {(r.doc_id, r.n_bytes): bytes(r.media) for r in stored.collect()}
    assert all(hashlib.sha256(files[r.doc_id, r.n_bytes]).hexdigest() == r.media_sha256 and len(files[r.doc_id, r.n_bytes]) == r.media_bytes for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.digests(media.pcm(media.encode_text(no_docs))).collect() == []


def test_pcm_blocks(spark, odd_docs, odd_rows, tmp_path):
    media.write_pcm(media.encode_text(odd_docs.filter("doc_id = 63")), str(tmp_path / "pcm"))
    rows = spark.read.parquet(str(tmp_path / "pcm")).orderBy("block").collect()
    raw = next(t for i, t, _ in odd_rows if i == 63).encode()
    assert [r.first_sample for r in rows] == [i * flac.BLOCK for i in range(len(rows))]
    samples = np.frombuffer(b"".join(bytes(r.pcm) for r in rows), np.int8).astype(int) + 128
    assert bytes(samples.astype(np.uint8).tolist())[: len(raw)] == raw


def test_prediction_in_32_bits_is_that_in_64():
    """Samples and coefficients at their limits: sums fit, and the encoder's arrays are half as large."""
    rng = np.random.default_rng(4)
    x = rng.choice([-128, 127], (40, 64))
    coef, shift = rng.choice([-2047, 2047], (40, 4)), rng.integers(0, 16, 40)
    narrow = flac.predict(x.astype(np.int32), coef, shift)
    assert narrow.dtype == np.int32 and (narrow == flac.predict(x, coef, shift)).all()
