"""Join of documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more, by token-combination prefixes.

Documents with equal sets are one node. Every node indexes a prefix of its set under a global order, rare tokens (here:
n-gram hashes) before frequent ones, long enough that two similar sets must meet in it: single rare tokens, and pairs of
frequent tokens of one class, for which the prefix is extended by one token a class. Classes are parts of the hash
range; their number follows the size of the set, so pairs stay in proportion to the prefix. A set with enough rare tokens
never indexes a frequent one, so a passage that many documents share brings nothing together.

Nodes that meet in an index list are candidates. All pairs of a short list are, unless sizes or marks rule them out: a
mark is the parity of a set's tokens in as many slots as it has tokens, and two sets differ in at least as many tokens as
their marks do in slots. So documents that only share a token by chance don't meet, however many a corpus has of them. Of
a long list all are candidates, kept as a star around its least node. Connected candidates form
blocks, and blocks are verified exactly: small ones in one task each, by a search that compares a node with the block's
nodes that nothing has reached yet; larger ones by joins over their own lists, first with a few pivots. Lists that still hold
different components and too many pairs are split by longer combinations: their nodes are indexed again under three, then
four tokens of a class, with a prefix longer by as much, and only what is left in one list then is compared pair by pair.

Frequent is what two documents have; in large corpora the limit rises, so that the map of frequent tokens keeps its
size, and tokens of a few documents count as rare. A token that only shares its place in that map with a frequent one
counts as frequent everywhere, which changes the speed and not the result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.llm.common import components, partitions, release, small_batches, stored, trimmed
from stepweave.llm.tokens import SpanHasher, column_bytes, mix64

#: Words of an n-gram; similarity as a percentage.
WORDS, PERCENT = 5, 80
#: Bits of the map of frequent tokens, tokens that may be frequent; tokens a task holds before it sends them.
FREQUENT_BITS, MAX_FREQUENT, COUNTED = 27, 1 << 24, 1 << 20
#: Nodes that a task remembers, to send equal sets of its documents once; forgetting some only sends them again.
SEEN = 1 << 17
#: Bytes hashed at a time; tokens of a block up to which one task verifies it; bits of the filter of candidate nodes.
BYTES, BLOCK_TOKENS, FILTER_BITS = 1 << 18, 1 << 22, 1 << 26
#: Bits of the map of rows that one_of_each has to bring together.
MOVED_BITS = 1 << 24
#: Rounds of pivots for the lists of larger blocks; pairs for each of their nodes up to which they are compared one by
#: one; the most tokens in a combination, after which they are compared whatever their number.
PIVOT_ROUNDS, PAIRS, MAX_COMBINED = 3, 64, 4
#: Nodes of a list up to which its pairs are looked at one by one; ratio of the sizes of one code, steps between similar ones.
SHORT_LIST, SIZE_STEP = 32, 1.05
SIZE_CODES = math.ceil(math.log(100 / PERCENT) / math.log(SIZE_STEP))

_hash = SpanHasher()


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in a row, A-Z in lower case, and where each text's words begin (one entry more)."""
    n, out, at, pos = len(buf), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while pos < n:
        step = BYTES
        while True:
            end = min(pos + step, n)
            part = buf[pos:end]
            space = (part == 32) | ((part >= 9) & (part <= 13))
            heads = offsets[np.searchsorted(offsets, pos, "right") : np.searchsorted(offsets, end, "left")] - pos
            stops = np.flatnonzero(space)
            if end == n or len(stops) or len(heads):
                break
            step *= 2  # a word longer than the step
        if end < n:  # to the last place where no word is open
            last = max(stops[-1] + 1 if len(stops) else 0, heads[-1] if len(heads) else 0)
            end, part, space = pos + int(last), part[:last], space[:last]
            heads = heads[heads < last]
        first = np.ones(len(part), bool)
        first[1:] = space[:-1]
        first[heads] = True
        close = np.ones(len(part), bool)
        close[:-1] = first[1:] | space[1:]
        starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(close & ~space) + 1
        lower = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        out.append(_hash(lower, starts, ends))
        at.append(starts + pos)
        pos = end
    return np.concatenate(out), np.searchsorted(np.concatenate(at), offsets)


def token_sets(column) -> list[np.ndarray]:
    """For each text of an Arrow column its sorted distinct n-gram hashes; fewer words make one n-gram, none none."""
    words, first = word_hashes(*column_bytes(column))
    keys = mix64(np.arange(1, WORDS + 1, dtype=np.uint64))
    grams = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        grams = mix64(sum(words[j : len(words) - WORDS + 1 + j] * (keys[j] | np.uint64(1)) for j in range(WORDS)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            g = np.sort(grams[a : b - WORDS + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(mix64((words[a:b] * (keys[: b - a] | np.uint64(1))).sum(keepdims=True) + keys[b - a - 1]))
        else:
            out.append(grams[:0])
    return out


def node_of(tokens: np.ndarray) -> int:
    """64 bits for a set; the last 8 are a code of its size, by which sets of too different sizes are told apart."""
    h = mix64(mix64(tokens).sum(keepdims=True) + np.full(1, len(tokens), np.uint64)).view(np.int64)[0]
    return int(h) & ~255 | min(255, int(math.log(max(len(tokens), 1)) / math.log(SIZE_STEP)))


def mark_of(tokens: np.ndarray) -> bytes:
    """The parity of the tokens in each of a power of two of slots, as many as there are tokens or more."""
    slots = 1 << max(6, (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).tobytes()


def may_be_similar(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only for sets that aren't similar: marks x and y of sets of n and m tokens."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    least, most = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for bits in range((8 * len(y)).bit_length() - 2, (8 * len(x)).bit_length() - 2, -1):  # to the slots of the smaller one
        most = (most ^ most >> (1 << bits)) & (1 << (1 << bits)) - 1
    return bool(similar(min((n + m - (least ^ most).bit_count()) // 2, n, m), n, m))


def needed(n: int) -> int:
    """Tokens of a set of n, of which at least one is in any set that is similar enough."""
    return n - -(-PERCENT * n // 100) + 1


def prefix_signatures(tokens: np.ndarray, often: np.ndarray, size: int = 2) -> np.ndarray:
    """Hashes of the single tokens and combinations of `size` under which a set is indexed; often: which are frequent.

    The prefix has as many tokens as the set may miss and one more, and size - 1 for each class that it touches: of two
    similar sets' shared tokens in it at least `size` are then in one class, or one is rare.
    """
    need = needed(len(tokens))
    n, rare = len(tokens), tokens[~often][:need]
    out, missing = [rare], need - len(rare)
    if missing > 0:
        common = tokens[often]
        # sets that are similar have some size bucket in common: that of the smaller one
        for bucket in range((-(-PERCENT * n // 100)).bit_length(), n.bit_length() + 1):
            classes = max(1, (1 << bucket) // 32)
            kind = (mix64(common) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(kind, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=classes))[:-1]])
            nth = np.empty(len(common), np.int64)
            nth[order] = np.arange(len(common)) - starts[kind[order]]
            gained = np.cumsum(nth >= size - 1)  # all but the first size - 1 tokens of a class bring the prefix on
            end = int(np.searchsorted(gained, missing)) + 1
            kind, part = kind[:end], common[:end]
            order = np.argsort(kind, kind="stable")
            kind, part = kind[order], part[order]
            out.append(combined(kind, part, size, np.uint64(2 * bucket + 1)))
    return np.concatenate(out)


def combined(kind: np.ndarray, part: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    """A hash for each combination of `size` tokens of one class; rows are in order of class, then of token."""
    low, last = part, np.arange(len(part))  # of a combination: its hash, the place of its last token
    for _ in range(size - 1):
        hashes, places, step = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 1
        while step < len(part):
            ok = last + step < len(part)
            ok[ok] = kind[last[ok] + step] == kind[last[ok]]
            if not ok.any():
                break
            hashes.append(mix64(low[ok] + mix64(part[last[ok] + step]) * salt))
            places.append(last[ok] + step)
            step += 1
        low, last = np.concatenate(hashes), np.concatenate(places)
    return low


def similar(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that connect exactly what all pairs of similar sets connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.concatenate(sets)
    _, token = np.unique(order, return_inverse=True)
    ends = np.cumsum(sizes)
    own = [token[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    free, links, queue, indexed = np.ones(len(sets), bool), [], [], 0
    owners = starts = counts = None
    n_free = len(sets)
    while n_free or queue:
        if not queue:
            i = int(np.argmax(free))
            free[i], n_free = False, n_free - 1
            queue.append(i)
        if not n_free:
            break
        if owners is None or n_free < indexed // 2:  # index what is still free
            left = np.flatnonzero(free)
            flat = np.concatenate([own[i] for i in left])
            by = np.argsort(flat, kind="stable")
            owners = np.repeat(np.arange(len(left)), sizes[left])[by]
            counts = np.bincount(flat, minlength=int(token.max()) + 1)
            starts = np.cumsum(counts) - counts
            indexed, here = n_free, left
        i = queue.pop()
        c = counts[own[i]]
        total = int(c.sum())
        if total:
            at = np.arange(total) + np.repeat(starts[own[i]] - (np.cumsum(c) - c), c)
            overlap = np.bincount(owners[at], minlength=len(here))
            for j in here[similar(overlap, sizes[i], sizes[here]) & free[here]].tolist():
                free[j], n_free = False, n_free - 1
                links.append((i, j))
                queue.append(j)
    return links


def nodes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, node, n (size of the set), mark for every row of docs."""
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = token_sets(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([mark_of(s) for s in sets], pa.binary())], names=[*keep, "node", "n", "mark"])

    with small_batches(docs.sparkSession):
        return stored(docs.select(*keep, "text").mapInArrow(trimmed(scan), f"{types}, node long, n long, mark binary"), "nodes")


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in one byte: up to 127 as they are, then four steps for each power of two (up to 2 ** 39)."""
    return np.where(n < 128, n, 100 + np.floor(4 * np.log2(np.maximum(n, 1)))).clip(0, 255).astype(np.uint8)


def frequent_bits(docs: DataFrame) -> np.ndarray:
    """A bit for each value of a token's first FREQUENT_BITS bits: set where frequent tokens fall.

    All tokens of all documents are counted, by their first bits: so many that there are several buckets for each
    shuffle partition, and 32 more. Each task sends the sorted rest of its tokens to the bucket of their first ones. The
    limit (2 at first) rises until at most MAX_FREQUENT tokens are frequent, which some limit below 2 ** 39 gives in any
    corpus of less than 2 ** 63 tokens.
    """
    spark = docs.sparkSession
    first = min(max((4 * partitions(spark) - 1).bit_length(), 8), 16)

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def parts(held):
            token = np.sort(np.concatenate(held))
            ends = np.searchsorted(token, np.arange(1, 1 << first, dtype=np.uint64) << np.uint64(64 - first))
            rest = ((token >> np.uint64(32 - first)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << first), pa.int32()), pa.array([x.tobytes() for x in np.split(rest, ends)], pa.binary())], names=["bucket", "rest"])

        held, size, seen = [], 0, set()
        for batch in batches:
            for s in token_sets(batch.column(0)):
                if len(s) and (i := node_of(s)) not in seen:
                    seen.add(i)
                    held.append(s)
                    size += len(s)
            if size > COUNTED:
                yield parts(held)
                held, size = [], 0
                if len(seen) > SEEN:
                    seen.clear()
        if held:
            yield parts(held)

    def count(table):
        import pyarrow as pa

        print_, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("rest")]), return_counts=True)
        print_, n = print_[n > 1], coded(n[n > 1])
        return pa.table({"bucket": table.column("bucket")[:1], "rest": pa.array([print_.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            hist = sum((np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) for x in batch.column(2)), np.zeros(256, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([hist.tolist()], pa.list_(pa.int64()))], names=["hist"])

    with small_batches(spark):
        counts = stored(docs.select("text").mapInArrow(trimmed(send), "bucket int, rest binary").groupBy("bucket").applyInArrow(count, "bucket int, rest binary, n binary"), "counts")
    hist = sum((np.array(r[0]) for r in counts.mapInArrow(trimmed(tally), "hist array<long>").collect()), np.zeros(256, np.int64))  # a few rows of 256 numbers
    over = np.cumsum(hist[::-1])[::-1]
    limit = next((k for k in range(2, 256) if over[k] <= MAX_FREQUENT), 256)

    def bits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = []
            for rest, n in zip(batch.column(1), batch.column(2), strict=True):
                hit = np.zeros(1 << (FREQUENT_BITS - first), np.uint8)
                hit[np.frombuffer(rest.as_buffer(), np.uint32)[np.frombuffer(n.as_buffer(), np.uint8) >= limit] >> np.uint32(32 + first - FREQUENT_BITS)] = 1
                raw.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["bucket", "bits"])

    out = np.zeros((1 << first, 1 << (FREQUENT_BITS - first - 3)), np.uint8)
    for bucket, raw in counts.mapInArrow(trimmed(bits), "bucket int, bits binary").collect():  # FREQUENT_BITS bits in all
        out[bucket] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1)


def frequent(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def listed(batches: Iterator) -> Iterator:
    """Lists of two nodes or more from sorted rows (sig, node); the first row of a batch may belong to the list before."""
    import pyarrow as pa

    last_sig = last_node = first = None
    alone = False
    for batch in batches:
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        if last_sig is not None:  # the row before, again
            sig, node = np.concatenate([[last_sig], sig]), np.concatenate([[last_node], node])
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        again = np.zeros(len(sig), bool)
        again[1:] = ~new[1:] & (node[1:] == node[:-1])
        run = np.cumsum(new) - 1
        heads = node[new]
        if last_sig is not None:
            heads[0] = first
        lead = heads[run]
        member = ~again & (node != lead)
        has = np.zeros(len(heads), bool)
        has[run[member]] = True
        # a list's first row goes out once, when a second node is found
        opening = np.flatnonzero(has)
        if last_sig is not None and not alone:
            opening = opening[opening > 0]
            member[0] = False
        elif last_sig is not None:
            member[0] = False
        starts = np.flatnonzero(new)[opening]
        at = np.concatenate([starts, np.flatnonzero(member)])
        out_node = np.concatenate([heads[opening], node[member]])
        yield pa.RecordBatch.from_arrays([pa.array(sig[at]), pa.array(lead[at]), pa.array(out_node)], names=["sig", "first", "node"])
        same = last_sig is not None and run[-1] == 0
        alone = (alone if same else True) and not has[-1]
        last_sig, last_node, first = sig[-1], node[-1], heads[-1]


def met(batches: Iterator, most: int) -> Iterator:
    """Candidates (a, b, sure), a < b, from sorted rows (sig, node): pairs of lists of up to `most` nodes whose sizes can be
    similar; of longer lists, each node with the first one, and sure, as that stands for pairs that nobody has looked at."""
    import pyarrow as pa

    sig = node = np.zeros(0, np.int64)
    goes_on = None  # sig and first node of a longer list at the end of the rows before
    for batch in chain(batches, [None]):
        if batch is not None:
            sig, node = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        heads, long = node[starts], np.diff(np.append(starts, len(sig))) > most
        if goes_on and sig[0] == goes_on[0]:
            heads[0], long[0] = goes_on[1], True
        goes_on = (sig[-1], heads[-1]) if long[-1] else None
        end = len(sig) if batch is None or goes_on else starts[-1]  # the last list waits for its rest
        own, run = node[:end], run[:end]
        star = long[run] & (own != heads[run])
        a, b = [heads[run][star]], [own[star]]
        n_sure = len(a[0])
        for d in range(1, most):
            ok = (run[d:] == run[:-d]) & ~long[run[d:]]
            if not ok.any():
                break
            x, y = own[:-d][ok], own[d:][ok]
            near = np.abs((x & 255) - (y & 255)) <= SIZE_CODES
            a.append(x[near])
            b.append(y[near])
        sig, node = sig[end:], node[end:]
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < n_sure)], names=["a", "b", "sure"])


def possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that the marks (node, n, mark) don't rule out."""

    def test(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = [may_be_similar(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = lambda end, m, n: marks.select(F.col("node").alias(end), F.col("mark").alias(m), F.col("n").alias(n))
    both = pairs.join(own("a", "x", "n"), "a").join(own("b", "y", "m"), "b").select("a", "b", "x", "n", "y", "m")
    return both.mapInArrow(trimmed(test), "a long, b long")


def candidates(docs: DataFrame, shared, marks: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b) whose components hold every two similar nodes together. shared: the broadcast map of frequent tokens
    (FREQUENT_BITS bits); most: SHORT_LIST if not given."""
    spark, most = docs.sparkSession, SHORT_LIST if most is None else most

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = set()
        for batch in batches:
            sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in token_sets(batch.column(0)):
                # sets of up to 3 have no similar one but themselves
                if len(s) > 100 // (100 - PERCENT) - 2 and (i := node_of(s)) not in seen:
                    seen.add(i)
                    sigs.append(prefix_signatures(s, frequent(s, shared.value)))
                    owners.append(np.full(len(sigs[-1]), i, np.int64))
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], names=["sig", "node"])

    with small_batches(spark):
        rows = by_list(docs.select("text").mapInArrow(trimmed(emit), "sig long, node long"))
        pairs = rows.mapInArrow(trimmed(lambda batches: met(batches, most)), "a long, b long, sure boolean")
        found = stored(pairs.groupBy("a", "b").agg(F.max("sure").alias("sure")), "met")
        near = possible(found.filter("not sure").select("a", "b"), marks)
        return stored(found.filter("sure").select("a", "b").union(near), "candidates")


def by_list(sigs: DataFrame) -> DataFrame:
    return sigs.repartition(partitions(sigs.sparkSession), "sig").sortWithinPartitions("sig", "node")


def as_lists(sigs: DataFrame) -> DataFrame:
    """(sig, first, node): every list of two nodes or more, with the least node of each list in all its rows."""
    return stored(by_list(sigs).mapInArrow(trimmed(listed), "sig long, first long, node long"), "lists")


def lists_of(sets: DataFrame, shared, size: int = 2) -> DataFrame:
    """Lists of nodes (node, tokens) under combinations of `size` tokens."""

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets_ = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column(1)]
            sigs = [np.zeros(0, np.uint64), *(prefix_signatures(s, frequent(s, shared.value), size) for s in sets_)]
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sigs[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(owners)], names=["sig", "node"])

    with small_batches(sets.sparkSession):
        return as_lists(sets.select("node", "tokens").mapInArrow(trimmed(emit), "sig long, node long"))


def node_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, tokens binary) for the members, one row each; texts are read again, and a filter passes few others."""
    # the filter works on a hash that Python can take as well
    slot = lambda node: F.pmod(F.col("node").bitwiseXOR(F.shiftrightunsigned("node", 32)), F.lit(FILTER_BITS))
    rows = members.select(slot("node").alias("w")).groupBy(F.shiftright("w", 5).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(w % 32 as int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS bits

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        have, seen = shared.value, set()
        for batch in batches:
            ids, raw = [], []
            for s in token_sets(batch.column(0)):
                i = node_of(s)
                w = ((i ^ ((i & (1 << 64) - 1) >> 32)) & (1 << 64) - 1) % FILTER_BITS
                if len(s) and have[w >> 5] >> np.uint32(w & 31) & 1 and i not in seen:
                    seen.add(i)
                    ids.append(i)
                    raw.append(s.tobytes())
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["node", "tokens"])

    return docs.select("text").mapInArrow(trimmed(emit), "node long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def test(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    with small_batches(pairs.sparkSession):
        return stored(both.mapInArrow(trimmed(test), "a long, b long"), "links")


def large_block_links(sets: DataFrame, shared, marks: DataFrame) -> DataFrame:
    """Links (a, b) for nodes of large blocks, by joins over their lists: pivots first, then longer combinations for lists
    that still have many pairs of nodes in two components, then every such pair that marks don't rule out."""
    spark, lists = sets.sparkSession, lists_of(sets, shared)
    links = spark.createDataFrame([], "a long, b long")
    everything = lists.select("node").distinct()
    label = everything.withColumn("root", F.col("node"))

    def still_open(label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Rows (sig, node, root), and of lists with two components (sig, a pivot, size)."""
        rows = stored(lists.select("sig", "node").join(label, "node"), "members")
        by = rows.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("_p"), F.count(F.lit(1)).alias("_n"))
        return rows, stored(by.filter("_lo <> _hi").select("sig", "_p", "_n"), "open")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = stored(links.union(verified(stored(possible(pairs.distinct(), marks), "pairs"), sets)), "links")
        return found, everything.join(components(found), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

    for size in range(2, MAX_COMBINED + 1):
        for turn in range(PIVOT_ROUNDS):
            rows, open_ = still_open(label, turn)
            if open_.isEmpty():
                return links
            pivots = rows.join(open_, "sig").filter(F.col("root") != F.col("_p.root"))
            links, label = linked(pivots.select(F.least("node", "_p.node").alias("a"), F.greatest("node", "_p.node").alias("b")))
        rows, open_ = still_open(label, PIVOT_ROUNDS)
        left = stored(rows.join(open_.select("sig", "_n"), "sig"), "left")
        work = left.agg(F.sum(F.col("_n").cast("double")).alias("pairs"), F.count_distinct("node").alias("nodes")).first()
        if not work["nodes"]:
            return links
        if size == MAX_COMBINED or work["pairs"] <= 2 * PAIRS * work["nodes"]:
            break
        # similar nodes meet under the longer combinations too, and only nodes of open lists are still apart
        lists = lists_of(stored(sets.join(left.select("node").distinct(), "node", "left_semi"), "open_sets"), shared, size + 1)
    other = left.select("sig", F.col("node").alias("_n2"), F.col("root").alias("_r"))
    pairs = left.join(other, "sig").filter((F.col("node") < F.col("_n2")) & (F.col("root") != F.col("_r")))
    return linked(pairs.select(F.col("node").alias("a"), F.col("_n2").alias("b")))[0]


def links_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that connect exactly what all similar pairs connect."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_bits(docs))
    release(spark)  # all tokens went through a shuffle
    marks = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("mark").alias("mark"))
    met_pairs = candidates(docs, shared, marks)
    release(spark)  # so did all signatures
    blocks = components(met_pairs)
    sizes = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"))
    members = stored(blocks.join(sizes, "node"), "block_nodes")
    weight = members.groupBy("root").agg(F.sum("n").alias("_sum"))
    members = stored(members.join(weight, "root").select("node", "root", (F.col("_sum") > BLOCK_TOKENS).alias("large")), "block_sizes")
    with small_batches(spark):
        sets = stored(node_sets(docs, members), "sets")
    mine = sets.join(members.filter("not large"), "node")

    def search(table):
        import pyarrow as pa

        ids, raw = table.column("node").to_numpy(), table.column("tokens")
        _, once = np.unique(ids, return_index=True)
        found = block_links([np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in once])
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[once][ends[:, 0]], "b": ids[once][ends[:, 1]]})

    small = mine.select("root", "node", "tokens").groupBy("root").applyInArrow(search, "a long, b long")
    large = members.filter("large").select("node")
    if large.isEmpty():
        return small
    unique = stored(sets.join(large, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")), "large_sets")
    return small.union(large_block_links(unique, shared, marks))


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: `keep`, n_shingles (size of its set), component_id (the least doc_id reachable by links),
    group_node (a number of the component; null without words).

    Texts without words (or null) have no set and link with nothing: each is its own component. A null doc_id counts
    only where a component has no other. Rows with equal sets, repeated rows too, are linked. An empty table gives an
    empty result. Columns of docs that aren't named play no part.
    """
    keep = list(keep)
    rows = nodes(docs, keep)
    graph = components(stored(links_of(docs, rows), "links"))
    release(docs.sparkSession)  # so did the sets of candidates
    least = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("_least"))
    placed = least.join(graph, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "_least")
    smallest = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    group = placed.join(smallest, "root").select(F.col("node").alias("_node"), "component_id", F.col("root").alias("group_node"))
    out = rows.join(group, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return out.select(*keep, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group_node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id (null last), then the least text hash, then any of equal rows.

    Rows without words link with nothing and stay. Columns and their order are those of docs.
    """
    tail = uuid.uuid4().hex[:8]  # names that docs doesn't have
    text_hash, key = f"_hash_{tail}", f"_key_{tail}"
    marked = docs.withColumn(text_hash, F.xxhash64("text")).withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_hash))
    found = stored(near_duplicates(marked, ("doc_id", text_hash, key)), "groups")
    first = found.filter("n_shingles > 0").groupBy("group_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", text_hash, key)).alias("_first"))
    chosen = first.select(F.col(f"_first.{key}").alias(key), F.lit(True).alias(f"_one_{tail}")).union(found.filter("n_shingles = 0").select(key, F.lit(False)).distinct())
    # only rows whose key isn't that of one chosen row move, by the key of the join, and a few that share a bit with them
    rows = found.filter("n_shingles > 0").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    doubtful = rows.join(chosen.filter(f"_one_{tail}"), key, "left").filter(F.col(f"_one_{tail}").isNull() | (F.col("_n") > 1))
    slot, bits = F.pmod(F.xxhash64(key), F.lit(MOVED_BITS)), f"_bits_{tail}"
    word, bit = F.shiftright(slot, 6), (slot % 64).cast("int")
    map_ = stored(doubtful.select(word.alias(f"_word_{tail}"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy(f"_word_{tail}").agg(F.bit_or("_bit").alias(bits)), "doubtful")
    told = marked.join(F.broadcast(map_), word == F.col(f"_word_{tail}"), "left")  # MOVED_BITS bits
    doubt = F.coalesce(F.call_function("shiftright", F.col(bits), bit) % 2 != 0, F.lit(False))
    # rows that are equal meet at their key
    turn = F.row_number().over(Window.partitionBy(key).orderBy(text_hash))
    moved = told.filter(doubt).join(chosen, key).withColumn(f"_turn_{tail}", turn).filter(~F.col(f"_one_{tail}") | (F.col(f"_turn_{tail}") == 1))
    return told.filter(~doubt).select(docs.columns).union(moved.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("group_node")


#: All pairs that share an n-gram, counted; components by repeated reach.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
