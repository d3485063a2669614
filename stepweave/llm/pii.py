"""Personal data: strict base patterns, and candidates of looser generators that boosted trees select.

The base patterns (email, ip, card, phone) are always redacted. Generators with high recall propose further spans, which
may overlap: spelled-out addresses, phone numbers without a country code, cards with other separators, IPv6 addresses.
Trees boosted on labelled candidates score format and context (characters, digits, checksum, words before, neighbours),
and a threshold for each kind, calibrated on held-out labels for precision, selects the spans to add.

All of it is one projection: regular expressions, array functions and CASE expressions; no shuffle, no Python. Pattern
matching is linear in the text: loops are possessive, and a match can only begin where a run of its characters does. Places
of matches come from running sums and candidates meet base spans by one sort and a running maximum (see `running`), so
the work follows the number of matches and not its square. Expressions are built as SQL text: made call by call, their
thousands of nodes would take the driver longer than the parser.
"""

from __future__ import annotations

import functools
import itertools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import trees

KINDS = ("email", "ip", "card", "phone")
MARK, STAND_IN = "\u0001", "\u0002"

#: The same matches as the contract's patterns: inner loops have one way to match, so possessive ones differ in speed
#: only; \G admits a start right after the match before.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A group of an IPv6 address, and what may follow its '::'.
HEX = "[0-9A-Fa-f]{1,4}"
TAIL = rf"(?:(?:{HEX}:){{0,5}}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}|{HEX}(?::{HEX}){{0,6}})"
#: Generators of candidates, by kind.
LOOSE = {
    "email": r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}|@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Fa-f:])(?:{HEX}:){{5,7}}{HEX}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z_:])(?!(?:::)?(?:{HEX}::?){{7}}{HEX})(?:{HEX}(?::{HEX}){{0,6}}::{TAIL}?|::{TAIL})(?![0-9A-Za-z_]|:[0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}(?![0-9])",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = 24
WORDS = {
    "phone": r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|ring|text)\b",
    "mail": r"(?i)\b(?:mail|email|e-mail|write|contact|reach)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|pay|payment)\b",
    "net": r"(?i)\b(?:ip|ipv6|host|server|address|addr|ping|from)\b",
    "count": r"(?i)\b(?:order|part|item|isbn|version|ref|invoice|serial|sku|no|id|page|ratio|mac|score|total)\b",
}
FEATURES = ("kind", "chars", "digits", "letters", "separators", "dots", "colons", "parens", "luhn", "joined_left", "joined_right", "indexed", *WORDS)

#: Labelled rows for the fit (bound), boosting rounds, wanted precision of added spans. A threshold takes at least 49 true
#: held-out spans of its kind; so many rows give each kind twice that.
LABELLED, ROUNDS, PRECISION = 9600, 40, 0.98

SPAN = "array<struct<start:int,end:int,v:string,before:string,after:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_names = itertools.count()


def with_value(value: str, body) -> str:
    """Like let, of SQL text."""
    name = f"v{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def pattern(p: str) -> str:
    return f"r'{p}'"


#: Elements of an array that `running` folds one after another.
RUN = 64


def running(values: str, plus, levels: int = 3) -> str:
    """Running results (plus: sum or maximum, say) of an array of longs without null, in steps of RUN elements.

    An array that a fold extends is copied by each step. Here only pieces of RUN elements are folded so, then their last
    results (again in pieces, `levels` deep), and each piece is moved on by the result before it.
    """
    a, x, i, y = (f"{n}{next(_names)}" for n in "axiy")
    fold = lambda v: f"aggregate({v}, cast(array() as array<bigint>), ({a}, {x}) -> concat({a}, array(if(size({a}) = 0, {x}, {plus(f'get({a}, size({a}) - 1)', x)}))))"
    if not levels:
        return fold(values)

    def pieces(v: str) -> str:
        cut = f"transform(sequence(0, cast(floor((size({v}) - 1) / {RUN}) as int)), {i} -> {fold(f'slice({v}, {i} * {RUN} + 1, {RUN})')})"
        ahead = lambda p: running(f"transform({p}, {x} -> get({x}, size({x}) - 1))", plus, levels - 1)
        moved = lambda p, h: f"flatten(transform({p}, ({x}, {i}) -> if({i} = 0, {x}, transform({x}, {y} -> {plus(f'get({h}, {i} - 1)', y)}))))"
        return with_value(cut, lambda p: with_value(ahead(p), lambda h: moved(p, h)))

    return with_value(values, lambda v: f"if(size({v}) <= {RUN}, {fold(v)}, {pieces(v)})")


def add(a: str, b: str) -> str:
    return f"{a} + {b}"


def most(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def matches(text: str, regex: str) -> str:
    """Leftmost non-overlapping matches with code point offsets and what stands around them. text has no MARK."""
    parts = f"split(regexp_replace({text}, {pattern(regex)}, '{MARK}$0{MARK}'), '{MARK}')"
    ends = lambda p: running(f"transform({p}, x -> cast(length(x) as bigint))", add)
    row = lambda p, e: f"named_struct('start', cast(get({e}, i - 1) as int), 'end', cast(get({e}, i) as int), 'v', get({p}, i), 'before', right(get({p}, i - 1), {CONTEXT}), 'after', left(get({p}, i + 1), 1))"
    # a text without a match is one part
    found = lambda p: f"if(size({p}) > 2, {with_value(ends(p), lambda e: f'transform(sequence(1, size({p}) - 2, 2), i -> {row(p, e)})')}, cast(array() as {SPAN}))"
    return with_value(parts, found)


def uncovered(found: str, base: str) -> str:
    """The spans of `found` that no single span of `base` covers; both in order of start, as is the result.

    Sorted together, a base span before a candidate that starts with it; a candidate is covered if the furthest end of
    the base spans before it isn't less than its own.
    """
    mixed = f"array_sort(concat(transform({base}, b -> named_struct('start', b.start, 'i', -1, 'end', b.end)), transform({found}, (x, i) -> named_struct('start', x.start, 'i', i, 'end', x.end))))"
    reach = lambda m: running(f"transform({m}, x -> cast(if(x.i < 0, x.end, -1) as bigint))", most)
    open_ = lambda m, r: f"filter(transform({m}, (x, j) -> if(x.i >= 0 and get({r}, j) < x.end, x.i, null)), i -> i is not null)"
    kept = with_value(mixed, lambda m: with_value(reach(m), lambda r: f"transform({open_(m, r)}, i -> get({found}, i))"))
    return f"if(size({found}) = 0 or size({base}) = 0, {found}, {kept})"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def valid(kind: str, v: str) -> str:
    if kind == "ip":
        return f"{v} rlike {pattern(rf'^{BYTE}(?:\.{BYTE}){{3}}$')}"
    if kind == "card":
        return f"(length({digits(v)}) between 14 and 19) and luhn_check({digits(v)})"
    if kind == "phone":
        return f"length({digits(v)}) between 10 and 15"
    return "true"


def base_columns(text: str) -> dict[str, Column]:
    """Base spans by kind; text has no MARK."""
    asks = {"email": f"contains({text}, '@')", "ip": f"_digit and contains({text}, '.')", "card": "_digit", "phone": f"_digit and contains({text}, '+')"}
    return {f"_{k}": F.expr(f"if({asks[k]}, filter({matches(text, BASE[k])}, s -> {valid(k, 's.v')}), cast(array() as {SPAN}))") for k in KINDS}


def loose_columns(text: str) -> dict[str, Column]:
    asks = {"email": "_at", "ip": f"contains({text}, '::') or (_digit and contains({text}, ':'))", "card": "_digit", "phone": "_digit"}
    return {f"_loose_{k}": F.expr(f"if({asks[k]}, {matches(text, LOOSE[k])}, cast(array() as {SPAN}))") for k in KINDS}


def features(kind: str, x: str) -> str:
    v, before = f"{x}.v", f"{x}.before"
    count = lambda p: f"regexp_count({v}, {pattern(p)})"
    flag = lambda c: f"coalesce({c}, false)"
    said = lambda p: flag(f"{before} rlike {pattern(p)}")
    values = {
        "kind": str(KINDS.index(kind)), "chars": f"length({v})", "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "separators": count("[^0-9A-Za-z]"), "dots": count(r"\."), "colons": count(":"), "parens": count(r"[(\[{]"),
        "luhn": flag(f"luhn_check({digits(v)})"), "joined_left": said(r"[A-Za-z0-9._:/-]$"), "joined_right": flag(f"{x}.after rlike {pattern(r'^[A-Za-z0-9_:/-]')}"), "indexed": said(r"[A-Za-z0-9_)\]]\[$"),
        **{n: said(p) for n, p in WORDS.items()},
    }
    return "named_struct(" + ", ".join(f"'{n}', cast({c} as double)" for n, c in values.items()) + ")"


def with_spans(docs: DataFrame, text: Column, model: bool) -> DataFrame:
    """Add _base (array of start, k, end by start and kind) and, per kind, the loose candidates with features."""
    out = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    out = out.withColumn("_text", F.when(F.contains("_text", F.lit(MARK)), F.translate("_text", MARK, STAND_IN)).otherwise(F.col("_text")))
    out = out.withColumns({"_digit": F.col("_text").rlike("[0-9]"), "_at": F.col("_text").rlike(r"(?i)[(\[{]at[)\]}]|@")})
    found = {**base_columns("_text"), **(loose_columns("_text") if model else {})}
    out = out.withColumns(found)
    spans = ", ".join(f"transform(_{k}, x -> named_struct('start', x.start, 'k', {i}, 'end', x.end))" for i, k in enumerate(KINDS))
    out = out.withColumn("_base", F.expr(f"array_sort(concat({spans}))"))
    if model:
        # what a base span already covers is no candidate
        rated = lambda i, k: F.expr(f"transform({uncovered(f'_loose_{k}', '_base')}, c -> named_struct('start', c.start, 'k', {i}, 'end', c.end, 'f', {features(k, 'c')}))")
        out = out.withColumns({f"_rated_{k}": rated(i, k) for i, k in enumerate(KINDS)})
    return out


def labelled_texts(n: int = LABELLED, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Short made-up texts and the spans in them that are personal data beyond the base patterns (both by rule)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(3, 8)))
    prose = lambda: " ".join(name() for _ in range(rng.randint(2, 7)))
    cue = lambda *c: rng.choice(c)

    def luhn(k: int, right: bool) -> str:
        body = d(k - 1)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        check = -total % 10
        return body + str(check if right else (check + rng.randint(1, 9)) % 10)

    def short() -> str:
        group = lambda: f"{rng.randrange(1, 65536):x}"
        head, tail = rng.choice([(1, 1), (1, 4), (2, 1), (2, 2), (4, 1), (4, 3), (6, 1), (2, 0), (4, 0), (0, 2)])
        first = [cue("2001", "fe80", "fd00", group())] if head else []
        last = [group() for _ in range(tail)]
        if tail and rng.random() < 0.3:
            last[-1] = str(rng.randint(1, 99))
        return rng.choice(["::1", "::ffff:" + ".".join(str(rng.randrange(256)) for _ in range(4))]) if rng.random() < 0.1 else ":".join(first + [group() for _ in range(head - 1)]) + "::" + ":".join(last)

    def scoped() -> tuple[str, str]:
        part = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 4)))
        index = cue(f"::{rng.randint(2, 9)}", f"{rng.randint(0, 99)}::{rng.randint(2, 9)}", f"{rng.randint(1, 99)}::")
        return rng.choice([(prose(), f"{part()}::{part()}".title()), (prose(), f"{part()}::{part()}"), (prose(), f"::{part()}"), (f"{prose()} {name()}[", index)])

    def one() -> tuple[str, str, bool]:
        sep = cue("-", ".", " ", "/")
        at, dot = cue("(at)", "[at]", " (at) ", " [at] ", "{at}"), cue("(dot)", "[dot]", " (dot) ", ".")
        number = luhn(16, rng.random() < 0.6)
        s = cue(".", "_", "/", "-")
        grouped = s.join(number[i : i + 4] for i in range(0, 16, 4))
        return [
            lambda: (cue("call", "phone", "tel", "mobile:", "my cell is", "fax", "text me"), f"({d(3)}) {d(3)}-{d(4)}", True),
            lambda: (cue("call", "phone", "tel", "mobile:", "ring"), f"{d(3)}{sep}{d(3)}{sep}{d(4)}", True),
            lambda: (cue("order", "part no", "item", "serial", "ref", "invoice", "sku", "total"), f"{d(3)}{sep}{d(3)}{sep}{d(4)}", False),
            lambda: (prose(), f"{d(3)} {d(3)} {d(4)}", False),
            lambda: (cue("write to", "email", "contact", "mail", prose()), f"{name()}.{name()}{at}{name()}{dot}{cue('com', 'org', 'net')}", True),
            lambda: (prose(), f"{name()}@ {name()}. {name()}", False),
            lambda: (prose(), f"{name()} (at) {name()}. {name()}", False),
            lambda: (cue("card", "visa", "pay with", "credit", prose()), grouped, number == luhn_fixed(number)),
            lambda: (cue("item", "serial", "version", "sku"), grouped, False),
            lambda: (cue("ip", "host", "server", "ping", "from", prose()), ":".join(f"{rng.randrange(65536):04x}" for _ in range(8)), True),
            lambda: (cue("mac", "id", prose()), ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), False),
            lambda: (cue("ip", "host", "server", "ping", "from", prose()), short(), True),
            lambda: (*scoped(), False),
        ][rng.randrange(13)]()

    out = []
    for _ in range(n):
        lead, value, private = one()
        head = f"{prose()} {lead}{'' if lead.endswith('[') else ' '}"
        out.append((f"{head}{value} {prose()}", [(len(head), len(head) + len(value))] if private else []))
    return out


def luhn_fixed(number: str) -> str:
    """The number with the check digit that it should have."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number[:-1])))
    return number[:-1] + str(-total % 10)


@functools.lru_cache(maxsize=4)
def _fitted(key: tuple) -> tuple[list, dict[str, float]]:
    rows = _SAMPLES[key]
    x = np.array([r[2:] for r in rows], float)
    y, kind = np.array([r[1] for r in rows], float), x[:, 0].astype(int)
    held = np.array([r[0] % 3 == 0 for r in rows])
    model = trees.boost(x[~held], y[~held], ROUNDS)
    score = sum(trees.apply(t, x) for t in model)
    limits = {k: trees.calibrate(score[held & (kind == i)], y[held & (kind == i)], PRECISION) for i, k in enumerate(KINDS)}
    if lost := [f"{k} ({int(y[held & (kind == i)].sum())} of {int((held & (kind == i)).sum())} true)" for i, k in enumerate(KINDS) if limits[k] == float("inf")]:
        raise ValueError(f"no threshold reaches precision {PRECISION} on the held-out labels of {', '.join(lost)}")
    return model, limits


_SAMPLES: dict[tuple, list] = {}


def fit(spark: SparkSession, labelled: list[tuple[str, list[tuple[int, int]]]] | None = None) -> tuple[list, dict[str, float]]:
    """Boosted trees and a threshold on their score for each kind, from at most LABELLED labelled texts.

    Candidates of the labelled texts are found and measured by the same columns as those of documents; a third of the
    texts is held out for the thresholds. Fitted once for the same labels. Labels too few or too mixed for a threshold of
    each kind are an error: that kind would add nothing.
    """
    labelled = (labelled or labelled_texts())[:LABELLED]
    key = tuple((t, tuple(s)) for t, s in labelled)
    if key not in _SAMPLES:
        gold = {i: set(s) for i, (_, s) in enumerate(labelled)}
        docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled)], "i int, text string")
        found = with_spans(docs, F.col("text"), True).select("i", F.explode(F.concat(*[f"_rated_{k}" for k in KINDS])).alias("c")).select("i", "c.start", "c.end", "c.f.*")
        _SAMPLES[key] = sorted((r[0], float((r[1], r[2]) in gold[r[0]]), *r[3:]) for r in found.collect())
    return _fitted(key)


def detect(docs: DataFrame, model: tuple[list, dict[str, float]] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (arrays of struct(start, k, end), k an index of KINDS, by start,
    kind and end; code points, end exclusive), `carry`.

    A null or empty text has no spans. Repeated rows are alike, an empty table gives an empty result, and texts of any
    length are searched whole, in a time that follows their length and number of matches. Spans of several kinds at one
    place are all listed. Other columns of docs play no part.
    """
    fitted, limits = model or fit(docs.sparkSession)
    rows = with_spans(docs.select("doc_id", "text", *[F.col(c).alias(f"_carry_{c}") for c in carry]), F.col("text"), True)

    score = " + ".join(trees.sql(t, lambda f: f"x.f.{FEATURES[f]}") for t in fitted)

    def chosen(k: str) -> Column:
        return F.expr(f"transform(filter(_rated_{k}, x -> {score} >= {limits[k]!r}D), x -> named_struct('start', x.start, 'k', x.k, 'end', x.end))")

    spans = F.array_sort(F.concat("_base", *[chosen(k) for k in KINDS]))  # none twice: a chosen one isn't a base one
    return rows.select("doc_id", F.col("_base").alias("base"), spans.alias("spans"), *[F.col(f"_carry_{c}").alias(c) for c in carry if c not in ("doc_id", "base", "spans")])


def redacted(text: str, spans: str) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first one in brackets.

    A span begins a run if it starts at or behind the furthest end before it. What stays is cut from blocks of the text:
    a cut from a whole text counts its characters from the start, each time.
    """
    block = 512
    tags = ", ".join(f"'[{k.upper()}]'" for k in KINDS)

    def part(b: str, start: str, end: str) -> str:
        first, last = f"cast(floor({start} / {block}) as int)", f"cast(floor({end} / {block}) as int)"
        inside = f"substring(get({b}, {first}), {start} % {block} + 1, {end} - {start})"
        head, tail = f"substring(coalesce(get({b}, {first}), ''), {start} % {block} + 1, {block})", f"substring(coalesce(get({b}, {last}), ''), 1, {end} % {block})"
        across = f"concat({head}, array_join(slice({b}, {first} + 2, greatest({last} - {first} - 1, 0)), ''), {tail})"
        return f"if({end} <= {start}, '', if({first} = {last}, {inside}, {across}))"

    def joined(b: str, r: str) -> str:
        before = f"if(i = 0, 0, cast(get({r}, i - 1) as int))"
        opens = f"filter(transform({spans}, (x, i) -> if(x.start >= {before}, named_struct('at', {before}, 'to', x.start, 'k', x.k), null)), x -> x is not null)"
        pieces = f"array_join(transform({opens}, x -> concat({part(b, 'x.at', 'x.to')}, get(array({tags}), x.k))), '')"
        return f"concat({pieces}, {with_value(f'cast(get({r}, size({r}) - 1) as int)', lambda e: part(b, e, f'length({text})'))})"

    blocks = f"regexp_extract_all({text}, {pattern(f'(?s).{{1,{block}}}')}, 0)"
    reach = running(f"transform({spans}, x -> cast(x.end as bigint))", most)
    return F.expr(with_value(blocks, lambda b: with_value(reach, lambda r: joined(b, r))))


def redact(docs: DataFrame, model: tuple[list, dict[str, float]] | None = None) -> DataFrame:
    """docs with all detected spans in text replaced; a null text stays null. Rows, columns and their order are those of docs."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = detect(docs.withColumnsRenamed({c: f"_own_{c}" for c in others}), model, ("text", *[f"_own_{c}" for c in others]))
    return found.withColumn("text", F.when(F.size("spans") > 0, redacted("text", "spans")).otherwise(F.col("text"))).select("doc_id", "text", *[F.col(f"_own_{c}").alias(c) for c in others]).select(docs.columns)


def listed(spans: str) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda i: lambda s: s["k"] == i
    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    n_spans, n_added = F.size("spans").cast("long"), (F.size("spans") - F.size("base")).cast("long")
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), n_spans.alias("n_spans"), n_added.alias("n_added"))
