"""A FLAC codec in NumPy: many frames are coded side by side, one array lane each.

The encoder writes mono 8-bit streams: STREAMINFO with the MD5 of the samples, a SEEKTABLE with every frame, and frames
of BLOCK samples with a fixed or linear predictor and one Rice partition. The decoder takes streams of 1 to 8 channels
and 4 to 32 bits to PCM; it checks CRC-8 and CRC-16 of every frame and the MD5 of every stream that has one. Frames of
another kind than the encoder's (several channels, other sizes, several or escaped partitions, wasted bits, constant,
verbatim) go one by one through `decode_frame`.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Samples of a frame; order and bits of the linear predictor; frames coded at a time.
BLOCK, ORDER, PRECISION, LANES = 1024, 4, 12, 512
#: Coefficients of the format's fixed predictors by order, as of a linear predictor without shift.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Codes of the format: sample sizes by code, block sizes by code.
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


class Corrupt(ValueError):
    """A checksum, a reserved code or a length that doesn't fit."""


class Unsupported(ValueError):
    """A sound stream that isn't what is asked for: payloads are mono 8-bit streams."""


def crc_table(width: int, poly: int) -> np.ndarray:
    top, out = 1 << (width - 1), []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c & top else 0)
        out.append(c & ((1 << width) - 1))
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def crc(data: bytes, table: np.ndarray, width: int) -> int:
    c, mask, steps = 0, (1 << width) - 1, table.tolist()
    for b in data:
        c = ((c << 8) & mask) ^ steps[(c >> (width - 8)) ^ b]
    return c


def crc16_lanes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of buf[start:start + size] for every lane, a byte of all lanes at a time."""
    order = np.argsort(-size, kind="stable")
    at, c = start[order], np.zeros(len(start), np.int64)
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    for t, m in enumerate(active.tolist()):
        c[:m] = ((c[:m] << 8) & 0xFFFF) ^ CRC16[(c[:m] >> 8) ^ buf[at[:m] + t]]
    out = np.empty_like(c)
    out[order] = c
    return out


def utf8_number(n: int) -> bytes:
    """The format's UTF-8-like coding of a number (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    lead = (0xFF << (8 - k)) & 0xFF
    return bytes([lead | n >> 6 * (k - 1), *(0x80 | n >> 6 * i & 0x3F for i in range(k - 2, -1, -1))])


@functools.lru_cache(maxsize=1 << 14)
def frame_header(number: int, size: int) -> bytes:
    """Fixed block size, block size as 16 bits, rate from STREAMINFO, mono, 8 bits."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02]) + utf8_number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc(head, CRC8, 8)])


def linear(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (lanes, ORDER) and shifts, from autocorrelation by Levinson's recursion."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(1) for lag in range(ORDER + 1)], 1)
    error, a = np.maximum(r[:, 0], 1e-9) * (1 + 1e-9), np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def predict(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out, coef = np.zeros(x.shape, x.dtype), coef.astype(x.dtype)
    for j in range(coef.shape[1]):
        out[:, j + 1 :] += coef[:, j, None] * x[:, : x.shape[1] - j - 1]
    return out >> shift.astype(x.dtype)[:, None]


def encode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of unsigned bytes data[start:start + size], as signed samples."""
    n, width = len(start), int(size.max())
    col = np.arange(width)
    valid = col < size[:, None]
    x = np.where(valid, data[np.minimum(start[:, None] + col, len(data) - 1)].astype(np.int32) - np.int32(128), np.int32(0))  # 8-bit samples and 12-bit coefficients: sums fit 32 bits
    coef, shift = linear(x, size)
    best = None
    for order, (c, s) in enumerate([(np.tile(np.array(f, np.int64), (n, 1)), np.zeros(n, np.int64)) for f in FIXED[:3]] + [(coef, shift)]):
        warm = ORDER if order == 3 else order
        r = np.where(valid & (col >= warm), x - predict(x, c, s), np.int32(0))
        cost = np.abs(r).sum(1) + (40 if order == 3 else 0)
        kind = np.full(n, order)
        if best is None:
            best = [cost, r, kind]
        else:
            win = cost < best[0]
            for k, v in enumerate((cost, r, kind)):
                best[k] = np.where(win[:, None] if v.ndim == 2 else win, v, best[k])
    _, r, kind = best
    lpc = kind == 3
    order = np.where(lpc, ORDER, kind)
    u = (r << 1) ^ (r >> 31)
    count = size - order
    # the best Rice parameter is near the logarithm of the mean
    guess = np.floor(np.log2(np.maximum(u.sum(1) / np.maximum(count, 1), 1))).astype(np.int64)
    tries = [np.clip(guess + d, 0, 14) for d in (-1, 0, 1)]
    bits = np.stack([(u >> k.astype(np.int32)[:, None]).sum(1) + count * (k + 1) for k in tries])
    pick = bits.argmin(0)
    k = np.choose(pick, tries)
    coded = valid & (col >= order[:, None])
    heads = [frame_header(int(a), int(b)) for a, b in zip(number, size, strict=True)]
    head = np.array([len(h) for h in heads])
    fields = 8 * (head + 1 + order) + np.where(lpc, 9 + ORDER * PRECISION, 0) + 10  # bits before the residuals
    total = (fields + bits.min(0) + 7) // 8 + 2
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()) + 8, np.uint8)
    # items: a value, and the bit after its last one; all fit in 17 bits
    q = u >> k.astype(np.int32)[:, None]
    ends = np.cumsum(np.where(coded, q + 1 + k[:, None], 0), 1) + (8 * base + fields)[:, None]
    low = (u & ((1 << k) - 1)[:, None]) | (1 << k)[:, None]
    values, stops = [low[coded]], [ends[coded]]
    at = 8 * (base + head)
    values.append(np.where(lpc, 0x40 | (ORDER - 1) << 1, 0x10 | order << 1))
    stops.append(at + 8)
    for j in range(ORDER):
        has = order > j
        values.append(x[has, j] & 0xFF)
        stops.append(at[has] + 8 * (j + 2))
    if lpc.any():
        after = at[lpc] + 8 * (1 + ORDER)
        values.append((PRECISION - 1) << 5 | shift[lpc])
        stops.append(after + 9)
        for j in range(ORDER):
            values.append(coef[lpc, j] & ((1 << PRECISION) - 1))
            stops.append(after + 9 + PRECISION * (j + 1))
    values.append(k)  # coding method 0, partition order 0, parameter
    stops.append(8 * base + fields)
    value, stop = np.concatenate(values), np.concatenate(stops)
    last = (stop - 1) >> 3
    value = value << (7 - ((stop - 1) & 7))
    raw = np.zeros(len(out), np.float64)
    for back in range(3):
        part = (value >> 8 * back) & 0xFF
        raw += np.bincount(np.maximum(last - back, 0), part, len(out))
    out[:] = raw
    flat = np.frombuffer(b"".join(heads), np.uint8)
    out[np.repeat(base - (np.cumsum(head) - head), head) + np.arange(len(flat))] = flat
    c = crc16_lanes(out, base, total - 2)
    out[base + total - 2], out[base + total - 1] = c >> 8, c & 0xFF
    whole = out.tobytes()
    return [whole[a : a + b] for a, b in zip(base.tolist(), total.tolist(), strict=True)]


def stream(payload: bytes, frames: list[bytes], rate: int = 8000) -> bytes:
    """The file of one stream."""
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    packed = rate << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
    seek, at = [], 0
    for i, s in enumerate(sizes):
        seek.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(payload) - i * BLOCK).to_bytes(2, "big"))
        at += s
    return b"".join([b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info, bytes([0x83]), (18 * len(seek)).to_bytes(3, "big"), *seek, *frames])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (not empty) of unsigned bytes."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    n = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + number * BLOCK
    size = np.minimum(sizes[doc] - number * BLOCK, BLOCK)
    frames: list = [None] * len(doc)
    order = np.argsort(-size, kind="stable")  # lanes of like length together
    for a in range(0, len(order), LANES):
        lanes = order[a : a + LANES]
        for i, f in zip(lanes.tolist(), encode_frames(data, start[lanes], size[lanes], number[lanes]), strict=True):
            frames[i] = f
    ends = np.cumsum(n)
    return [stream(p, frames[e - k : e]) for p, e, k in zip(payloads, ends.tolist(), n.tolist(), strict=True)]


def metadata(media: bytes) -> dict:
    """STREAMINFO, seek points [(first sample, offset, samples)] and where frames begin."""
    if media[:4] != b"fLaC":
        raise Corrupt("no stream marker")
    at, out, final = 4, {"seek": []}, False
    while not final:
        final, kind, size = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[:2], "big"), "longest": int.from_bytes(body[7:10], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size - 17, 18) if body[i : i + 8] != b"\xff" * 8]
        at += 4 + size
    out["frames"] = at
    return out


class Bits:
    def __init__(self, data: bytes, at: int):
        self.n, self.at, self.size = int.from_bytes(data, "big"), 8 * at, 8 * len(data)

    def take(self, k: int) -> int:
        self.at += k
        if self.at > self.size:
            raise Corrupt("the frame ends early")
        return self.n >> (self.size - self.at) & ((1 << k) - 1)

    def signed(self, k: int) -> int:
        v = self.take(k)
        return v - (1 << k) if k and v >> (k - 1) else v

    def unary(self) -> int:
        rest = self.n & ((1 << (self.size - self.at)) - 1)
        if not rest:
            raise Corrupt("the frame ends early")
        q = self.size - self.at - rest.bit_length()
        self.at += q + 1
        return q


def subframe(bits: Bits, size: int, width: int) -> list[int]:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        x = [bits.signed(width)] * size
    elif kind == 1:
        x = [bits.signed(width) for _ in range(size)]
    else:
        order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
        if order < 0:
            raise Corrupt("reserved kind of subframe")
        x = [bits.signed(width) for _ in range(order)]
        coef, shift = FIXED[order] if kind < 32 else None, 0
        if coef is None:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            coef = [bits.signed(precision) for _ in range(order)]
        parameter = 4 + bits.take(2)
        parts = bits.take(4)
        for p in range(1 << parts):
            k = bits.take(parameter)
            n = (size >> parts) - (order if p == 0 else 0)
            if k == (1 << parameter) - 1:
                raw = bits.take(5)
                residual = [bits.signed(raw) for _ in range(n)]
            else:
                residual = [(u >> 1) ^ -(u & 1) for u in (bits.unary() << k | bits.take(k) for _ in range(n))]
            for r in residual:
                x.append(r + (sum(c * v for c, v in zip(coef, reversed(x), strict=False)) >> shift))
    return [v << wasted for v in x] if wasted else x


def decode_frame(data: bytes, bits_default: int = 8) -> tuple[list[list[int]], int]:
    """Channels of the frame at the start of data, and its bytes. Any frame of the format with up to 8 channels."""
    if data[0] != 0xFF or data[1] & 0xFE != 0xF8:
        raise Corrupt("no frame here")
    size_code, rate_code, channels, width = data[2] >> 4, data[2] & 15, data[3] >> 4, data[3] >> 1 & 7
    at = 5 + (next(i for i in range(8) if not data[4] >> (7 - i) & 1) - 1 if data[4] >= 0xC0 else 0)
    if size_code in (6, 7):
        size, at = int.from_bytes(data[at : at + size_code - 5], "big") + 1, at + size_code - 5
    else:
        size = BLOCK_SIZES[size_code]
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc(data[:at], CRC8, 8) != data[at]:
        raise Corrupt("CRC-8 of a frame header")
    bits, width = Bits(data, at + 1), SAMPLE_BITS.get(width, bits_default)
    if channels < 8:
        out = [subframe(bits, size, width) for _ in range(channels + 1)]
    else:  # a side channel has one bit more
        a, b = (subframe(bits, size, width + (k == (channels != 9))) for k in (0, 1))
        if channels == 8:
            out = [a, [x - y for x, y in zip(a, b, strict=True)]]
        elif channels == 9:
            out = [[x + y for x, y in zip(a, b, strict=True)], b]
        else:
            mid = [x << 1 | y & 1 for x, y in zip(a, b, strict=True)]
            out = [[(m + y) >> 1 for m, y in zip(mid, b, strict=True)], [(m - y) >> 1 for m, y in zip(mid, b, strict=True)]]
    end = (bits.at + 7) // 8
    if crc(data[:end], CRC16, 16) != int.from_bytes(data[end : end + 2], "big"):
        raise Corrupt("CRC-16 of a frame")
    return out, end + 2


def decode_lanes(buf: np.ndarray, start: np.ndarray, total: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (time, lanes) of mono 8-bit frames as this encoder writes them; which lanes are of that kind."""
    n, longest = len(start), int(size.max())
    head = np.where(number < 0x80, 8, np.where(number < 0x800, 9, np.where(number < 0x10000, 10, 11)))
    heads = [frame_header(int(a), int(b)) for a, b in zip(number, size, strict=True)]
    first = np.cumsum(head) - head
    same = buf[np.repeat(start - first, head) + np.arange(int(head.sum()))] == np.frombuffer(b"".join(heads), np.uint8)
    ok = np.add.reduceat(same, first) == head  # the header with its CRC-8, byte for byte
    crcs = crc16_lanes(buf, start, total - 2)
    if (crcs != (buf[start + total - 2].astype(np.int64) << 8 | buf[start + total - 1])).any():
        raise Corrupt("CRC-16 of a frame")
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.int64)

    def field(at: np.ndarray, k) -> np.ndarray:
        i = np.minimum(at >> 3, len(buf))  # what a lane of another kind would read behind the last frame
        return (wide[i] << 16 | wide[i + 1] << 8 | wide[i + 2]) >> (24 - (at & 7) - k) & ((1 << k) - 1)

    at = 8 * (start + head)
    kind = field(at, 8)
    fixed = (kind & 0xF1 == 0x10) & (kind >> 1 & 7 <= 4)
    lpc = kind & 0xC1 == 0x40
    ok &= fixed | lpc
    order = np.where(lpc, (kind >> 1 & 31) + 1, np.where(fixed, kind >> 1 & 7, 0))
    ok &= order <= size
    deepest = int(order[ok].max(initial=0))
    coef, shift, warm = np.zeros((deepest, n), np.int64), np.zeros(n, np.int64), np.zeros((deepest, n), np.int64)
    for j in range(deepest):
        has = ok & (order > j)
        warm[j, has] = field(at[has] + 8 * (j + 1), 8).astype(np.uint8).view(np.int8)
    for o in range(1, min(deepest, len(FIXED) - 1) + 1):  # orders that no lane has need no rows
        for j, v in enumerate(FIXED[o]):
            coef[j, ok & fixed & (order == o)] = v
    at = at + 8 * (1 + order)
    lane = np.flatnonzero(ok & lpc)
    if len(lane):
        precision, move = field(at[lane], 4) + 1, field(at[lane] + 4, 5)
        ok[lane] &= (move < 16) & (precision < 16)
        shift[lane] = move
        for j in range(deepest):
            has = order[lane] > j
            v = field(at[lane] + 9 + j * precision, precision)
            coef[j, lane[has]] = (v - ((v >> (precision - 1)) << precision))[has]
        at[lane] += 9 + order[lane] * precision
    ok &= field(at, 6) == 0  # method 0, one partition
    k = field(at + 6, 4)
    ok &= k < 15
    at = at + 10
    lanes = np.flatnonzero(ok)
    out = np.zeros((longest, n), np.int64)
    if not len(lanes):
        return out, ok
    # unary parts, all lanes in step: the stop bit after a position comes from the list of one bits
    bits = np.unpackbits(buf)
    ones = np.append(np.flatnonzero(bits), len(bits))
    before = np.concatenate([[0], np.cumsum(bits, dtype=np.int32), np.full(64, len(ones) - 1, np.int32)]).astype(np.int32)
    count = (size - order)[lanes]
    by = np.argsort(-count, kind="stable")
    lanes, count = lanes[by], count[by]
    p, rice = at[lanes], k[lanes]
    stop = np.zeros((int(count[0]), len(lanes)), np.int64)
    unary = np.zeros_like(stop)
    active = np.searchsorted(-count, -np.arange(int(count[0])), side="left").tolist()
    limit = len(bits)
    for t, m in enumerate(active):
        here = p[:m]
        s = ones[before[np.minimum(here, limit)]]
        stop[t, :m] = s
        unary[t, :m] = s - here
        p[:m] = s + 1 + rice[:m]
    if (p > 8 * (start + total - 2)[lanes]).any():
        raise Corrupt("residuals run over the frame")
    u = unary << rice | np.where(np.arange(len(stop))[:, None] < count, field(np.minimum(stop + 1, limit), rice), 0)
    r = (u >> 1) ^ -(u & 1)
    o = order[lanes]
    x = np.zeros((longest, len(lanes)), np.int64)
    for v in np.unique(o):
        same = o == v
        x[v : v + len(r), same] = r[: longest - v, same]
        x[:v, same] = warm[:v, lanes[same]]
    c, move = coef[:, lanes], shift[lanes]
    for t in range(1, longest):
        past = sum(c[j] * x[t - 1 - j] for j in range(min(deepest, t)))
        x[t] += np.where(t >= o, past >> move, 0) if t < deepest else past >> move
    out[:, lanes] = x
    return out, ok


def frame_table(media: bytes, meta: dict) -> list[tuple[int, int, int, int]]:
    """(first sample, offset in the file, bytes, samples) of each frame; from the seek table where it has them all."""
    seek, end = meta["seek"], len(media) - meta["frames"]
    if seek and seek[0][:2] == (0, 0) and sum(s[2] for s in seek) == meta["samples"]:
        ends = [s[1] for s in seek[1:]] + [end]
        return [(s[0], meta["frames"] + s[1], e - s[1], s[2]) for s, e in zip(seek, ends, strict=True)]
    at, first, out = meta["frames"], 0, []
    while at < len(media):
        window = meta["longest"] or 1 << 16
        while True:  # only a frame's own bytes, as far as they are known
            try:
                channels, size = decode_frame(media[at : at + window], meta["bits"])
                break
            except (Corrupt, IndexError):
                if at + window >= len(media):
                    raise
                window *= 2
        out.append((first, at, size, len(channels[0])))
        first, at = first + len(channels[0]), at + size
    return out


def interleaved(channels: list[list[int]], width: int) -> bytes:
    """PCM of a frame: samples by time and channel, signed, little-endian, `width` bytes each."""
    samples = np.array(channels, np.int64).T.astype("<i4")
    return samples.reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def decode_pcm(media: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int, int, int]]], list[dict]]:
    """PCM of streams (see `interleaved`), their frame tables and their metadata; Corrupt where a checksum doesn't fit."""
    metas = [metadata(m) for m in media]
    tables = [frame_table(m, meta) for m, meta in zip(media, metas, strict=True)]
    doc = np.repeat(np.arange(len(media)), [len(t) for t in tables])
    flat = np.array([f for t in tables for f in t], np.int64).reshape(-1, 4)
    base = np.cumsum([0, *(len(m) for m in media)])
    buf = np.frombuffer(b"".join(media), np.uint8)
    step = [meta["channels"] * (-(-meta["bits"] // 8)) for meta in metas]  # bytes of one time
    out = [bytearray(meta["samples"] * k) for meta, k in zip(metas, step, strict=True)]
    order = np.argsort(-flat[:, 3], kind="stable")
    a = 0
    while a < len(order):
        lanes = order[a : a + max(1, BLOCK * LANES // max(int(flat[order[a], 3]), BLOCK))]
        a += len(lanes)
        first, at, total, size = flat[lanes].T
        at = at + base[doc[lanes]]
        # only these frames' bytes
        local = np.cumsum(total) - total
        part = buf[np.repeat(at - local, total) + np.arange(int(total.sum()))]
        x, ok = decode_lanes(part, local, total, size, first // BLOCK)
        for i, lane in enumerate(lanes.tolist()):
            d, n = int(doc[lane]), int(size[i])
            if ok[i] and step[d] == 1:
                pcm = x[:n, i].astype(np.int8).tobytes()
            else:
                channels, _ = decode_frame(part[local[i] : local[i] + total[i]].tobytes(), metas[d]["bits"])
                if len(channels) != metas[d]["channels"] or len(channels[0]) != n:
                    raise Corrupt("a frame of another size")
                pcm = interleaved(channels, step[d] // len(channels))
            out[d][first[i] * step[d] : (first[i] + n) * step[d]] = pcm
    for pcm, meta in zip(out, metas, strict=True):
        if meta["md5"] != bytes(16) and hashlib.md5(pcm).digest() != meta["md5"]:  # zeros: not known
            raise Corrupt("MD5 of a stream")
    return [bytes(p) for p in out], tables, metas


def payload(pcm: bytes, meta: dict) -> bytes:
    """The unsigned bytes of signed 8-bit mono samples."""
    if (meta["channels"], meta["bits"]) != (1, 8):
        raise Unsupported(f"{meta['channels']} channels of {meta['bits']} bits hold no payload")
    return (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()


def decode(media: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int, int, int]]]]:
    """Unsigned bytes of mono 8-bit streams, with their frame tables; Corrupt where a checksum doesn't fit, Unsupported for
    any other stream."""
    pcm, tables, metas = decode_pcm(media)
    return [payload(p, meta) for p, meta in zip(pcm, metas, strict=True)], tables
