"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once per worker.

A byte-level BPE tokenizer with the usual pattern never joins what stands on the two sides of a single space between
visible characters: the space opens the next piece. Texts are therefore cut before such spaces, chunks are hashed
(64 bits) in vectors, and the library encodes only chunks that the worker's table of chunks doesn't hold. Where a cut
could matter (next to characters that may be white space beyond ASCII) none is made.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes handled at a time (a text may span several such blocks), bytes of joined chunks in one call of the library,
#: slots of the chunk table, ids that it may hold.
BLOCK, JOINED, SLOTS, MAX_IDS = 1 << 19, 1 << 16, 1 << 21, 1 << 24


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class SpanHasher:
    """64-bit hashes of spans of a byte buffer, from prefix sums of a polynomial."""

    BASE = 0x2545F4914F6CDD1D

    def __init__(self):
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(buf):
            n = len(buf) + len(buf) // 4 + 1024
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.byte[buf] * self.up[: len(buf)], out=run[1:])
        return mix64((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions of spaces before which a text may be cut without changing its ids."""
    at = np.flatnonzero(buf[3:-1] == 32) + 3
    before, after = buf[at - 1], buf[at + 1]
    risky = (before >= 0x80) & ((buf[at - 2] == 0xC2) | ((buf[at - 3] >= 0xE1) & (buf[at - 3] <= 0xE3)))
    risky |= (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    return at[(before > 32) & (after > 32) & ~risky]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # byte-level vocabularies write each byte as one character
        self.n_bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)
        self.span_hash = SpanHasher()
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.off, self.cnt = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids to the table's store; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(max(2 * len(self.flat), self.used) - at, self.dtype)])
        self.flat[at : self.used] = ids
        return at

    def encode_new(self, parts: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets in the store and numbers of ids of chunks."""
        off, cnt = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        single = ~joinable
        some = np.flatnonzero(joinable)
        for some in np.split(some, np.flatnonzero(np.diff(np.cumsum(sizes[some]) // JOINED)) + 1) if len(some) else ():
            ids = np.array(self.tok.encode_batch_fast([b"".join([parts[i] for i in some]).decode()], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum(sizes[some])
            reached = np.cumsum(self.n_bytes[ids])
            last = np.searchsorted(reached, ends)
            if len(ids) and last[-1] == len(ids) - 1 and (reached[last] == ends).all():
                first = np.concatenate([[0], last[:-1] + 1])
                off[some], cnt[some] = self.add(ids) + first, last + 1 - first
            else:
                single[some] = True
        rest = np.flatnonzero(single)
        for i, e in zip(rest, self.tok.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False) if len(rest) else (), strict=True):
            ids = np.array(e.ids, self.dtype)
            off[i], cnt[i] = self.add(ids), len(ids)
        return off, cnt

    def block(self, buf: np.ndarray, starts: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks of a block, and the number for each."""
        if self.used > MAX_IDS:
            self.reset()
        ends = np.append(starts[1:], len(buf))
        h = self.span_hash(buf, starts, ends)
        h[h == 0] = 1
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        off, cnt = self.off[slot].astype(np.int64), self.cnt[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw, at = buf.tobytes(), miss[first]
            o, c = self.encode_new([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], joinable[at])
            off[miss], cnt[miss] = o[back], c[back]
            slot = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            self.key[slot], self.off[slot], self.cnt[slot] = new, o, c
        total = np.cumsum(cnt)
        pick = np.arange(total[-1] if len(total) else 0) + np.repeat(off - (total - cnt), cnt)
        return self.flat[pick], cnt

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts buf[offsets[i]:offsets[i + 1]] in a row, and where each text's ids begin (one entry more)."""
        n = int(offsets[-1])
        heads = np.unique(offsets[:-1][np.diff(offsets) > 0])
        out, at, before = [np.zeros(0, self.dtype)], [], []
        pos, done = 0, 0
        while pos < n:
            step = BLOCK
            while True:
                end = min(pos + step, n)
                part = buf[pos:end]
                inner = heads[(heads > pos) & (heads < end)] - pos
                split = cuts(part) if len(part) > 4 else np.zeros(0, np.int64)
                starts = np.union1d(np.concatenate([[0], inner]), split).astype(np.int64)
                if end == n or len(starts) > 1:
                    break
                step *= 2
            # a chunk can be encoded joined to others if it opens and ends at a cut
            opens = np.isin(starts, split, assume_unique=True) & ~np.isin(starts, inner, assume_unique=True)
            if end < n:  # the last chunk may go on in the next block
                end, last = pos + int(starts[-1]), starts[-1]
                closes = opens[1:]
                starts, opens = starts[:-1], opens[:-1]
                part = part[:last]
            else:
                closes = np.append(opens[1:], False)
            if pos not in heads and not opens[0]:
                opens[0] = pos > 0 and part[0] == 32 and pos not in inner
            ids, cnt = self.block(part, starts, opens & closes)
            at.append(starts + pos)
            before.append(done + np.cumsum(cnt) - cnt)
            out.append(ids)
            done, pos = done + len(ids), end
        at, before = np.concatenate(at or [np.zeros(0, np.int64)]), np.append(np.concatenate(before or [np.zeros(0, np.int64)]), done)
        return np.concatenate(out), before[np.searchsorted(at, offsets)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; null is empty."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put end_id after each text's ids."""
    n = len(first) - 1
    moved = first + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, ids.dtype)
    keep = np.ones(len(out), bool)
    keep[moved[1:] - 1] = False
    out[keep] = ids
    return out, moved


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
