"""Secret scans: wide candidate rules, and a random forest that removes false positives.

Candidates are long runs of key characters with letters and digits (the value alone where a name and '=' stand before it),
values assigned to password-like names with or without quotes, signed web tokens and private key blocks. The forest,
fitted on what the same search finds in labelled texts, scores each by its length, character
transitions, coverage by dictionary words, path-like surroundings and neighbouring words; findings at or above a
threshold calibrated on held-out labels are secrets. Values never leave the scan, only their places and SHA-256.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import trees
from stepweave.llm.common import sliced, small_batches, stored, trimmed
from stepweave.llm.tokens import column_bytes

#: Labelled findings for the fit (bound), trees, wanted precision on held-out labels.
LABELLED, TREES, PRECISION = 3000, 40, 0.97
#: Characters of a run that is a candidate from RUN on; context characters around a candidate.
RUN_CHARS, RUN, BEFORE, AFTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 16, 48, 24

RULES = {
    "password": re.compile(r"""(?i)(?:passw(?:or)?d|passphrase|pwd|secret)["']?\s{0,8}[:=]\s{0,8}["']([^"'\s]{6,})["']"""),
    # from where characters of a token begin, so that each is read once
    "web_token": re.compile(r"(?<![A-Za-z0-9_-])(?:(?!\beyJ)[A-Za-z0-9_-])*+\b(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"),
    # headers and written-out line ends are part of the block; it ends at the next line of five dashes
    "private_key": re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[^-]|-(?!----)){16,}+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"),
    # up to white space, a quote, or what parts it from the next name or word
    "bare_password": re.compile(r"""(?i)(?:passw(?:or)?d|passphrase|pwd|secret)["']?[ \t]{0,8}(?:=>|:=|[:=])[ \t]{0,8}(?![:=,;&])((?:[^\s"'`<,;&]|[,;&](?!\s|$|[\w.-]{1,64}=)){6,}(?<![.,;:]))"""),
}
HINTS = {"password": re.compile("(?i)passw|passphrase|pwd|secret"), "bare_password": re.compile("(?i)passw|passphrase|pwd|secret"), "web_token": re.compile("eyJ"), "private_key": re.compile("-----BEGIN ")}
NEAR = {
    "asks": re.compile(r"(?i)(?:key|token|secret|passw|pwd|auth|credential|bearer|private|api)[\w.-]{0,12}[\"']?\s{0,8}(?:[:=]|=>)?\s{0,8}[\"'`(]?$"),
    "digest": re.compile(r"(?i)\b(?:commit|sha\d*|md5|checksum|hash|digest|etag|integrity|revision|rev|build|blob|tree|parent)\b"),
    "sample": re.compile(r"(?i)\b(?:example|sample|dummy|fake|placeholder|test|mock|demo|replace|changeme|your)\b"),
    "number": re.compile(r"(?i)\b(?:uuid|guid|id|session|request|trace|version|order|serial|node|file|image|asset|chunk)\b"),
}
PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|rk_live_|AIza|npm_|pypi-|hf_|SG)")
UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
#: Words whose coverage of a candidate speaks against a secret.
DICTIONARY = frozenset(
    "about account action active address admin agent alias align alpha amount answer array asset author back base batch beta block board body bool border bottom build button cache call cell center chain change char check child class clean click client close cloud code color column command common config connect console content context control copy core count create cursor custom data date debug default delete demo detail device dialog digit direct display document domain download draw dummy edit element email enable encode error event example export fake field file filter final first flag float folder font form format frame from function global graph grid group handle hash head health height hello help hidden home host html image import index info init inner input insert item java json key label language last layer layout left length level library light limit line link list load local lock login long main manager master match media member menu merge message method middle mode model module mouse move name native network next node normal null number object offset open option order output owner package page panel param parent part password path pattern phone pixel place placeholder plain player point port position post prefix price primary print private process product profile project property public query queue random range read record remote remove render replace report request reset resource response result return right root route sample save scale schema scope screen script search secret section secure select server service session setting shadow shape share shell show side simple size sort source space staging start state static status step store stream string style submit success switch system table target task team template test text theme time title token tool total trace tree type union unit update upload user utils valid value vector version video view visible water web width window word work world wrap write your zone".split()
)
FEATURES = ("length", "hex", "digits", "upper", "lower", "switches", "transitions", "entropy", "dictionary", "path", "quoted", "assigned", *NEAR, "distinct", "run", "uuid", "prefix", "rule")
_LETTER = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


@functools.lru_cache(maxsize=1)
def letter_pairs() -> np.ndarray:
    """Log probabilities of a letter after a letter in dictionary words."""
    n = np.full((26, 26), 0.3)
    for word in DICTIONARY:
        for a, b in zip(word, word[1:], strict=False):
            n[_LETTER[a], _LETTER[b]] += 1
    return np.log(n / n.sum(1, keepdims=True))


def covered(value: str) -> float:
    """The share of characters in dictionary words, longest first from the left."""
    low, i, n = value.lower(), 0, 0
    while i < len(low):
        k = next((k for k in range(min(11, len(low) - i), 2, -1) if low[i : i + k] in DICTIONARY), 0)
        n, i = n + k, i + (k or 1)
    return n / max(len(value), 1)


def features(rule: str, before: str, value: str, after: str) -> list[float]:
    v, n = value, max(len(value), 1)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in v]
    pairs = letter_pairs()
    low = v.lower()
    logs = [pairs[_LETTER[a], _LETTER[b]] for a, b in zip(low, low[1:], strict=False) if a in _LETTER and b in _LETTER]
    counts = [v.count(c) for c in set(v)]
    run = best = 1
    for a, b in zip(v, v[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return [
        float(len(value)), float(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) is not None), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(np.mean(logs)) if logs else -3.3, -sum(c / n * math.log2(c / n) for c in counts), covered(v),
        float(v.count("/") >= 2 or before[-1:] in ("/", "\\", ".", "@") or after[:1] in ("/", "\\", "@", "(") or re.match(r"\.[a-z]{2,4}\b", after) is not None),
        float(before[-1:] in "\"'`" and before != "" and after[:1] in "\"'`"), float(re.search(r"[:=]\s{0,8}[\"'`]?$", before) is not None),
        *(float(bool(p.search(before) or (k == "sample" and p.search(value.replace("_", " "))))) for k, p in NEAR.items()),
        len(counts) / n, float(best), float(UUID.match(v) is not None), float(PREFIX.match(v) is not None), float(["run", *RULES].index(rule)),
    ]


#: Parts of a run between '='; what ends a run is padding.
PART = re.compile("[^=]+(?:=+$)?")

_CLASS = np.zeros(256, np.uint8)  # 1: run character, 2: also a digit, 3: also a letter
_CLASS[np.frombuffer(RUN_CHARS, np.uint8)] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 3


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of runs of RUN or more key characters with a digit and a letter; runs end where texts do."""
    kind = _CLASS[buf]
    inside = kind > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    stop = ~inside
    stop[heads] = True
    stops = np.append(np.flatnonzero(stop), len(buf))
    end = stops[np.searchsorted(stops, start, "right")]
    some = end - start >= RUN
    start, end = start[some], end[some]
    has = np.array([(kind[a:b] == 2).any() and (kind[a:b] == 3).any() for a, b in zip(start.tolist(), end.tolist(), strict=True)], bool)
    return start[has.nonzero()], end[has.nonzero()]


def trim(value: str, at: int) -> tuple[int, int] | None:
    """The place of a value at `at` without the punctuation around it, where that has RUN characters."""
    lead = len(value) - len(value.lstrip("=-/+"))  # what opens a run is often punctuation
    core = value.strip("=-/+") if lead or value.endswith(("-", "/", "+")) else value
    return (at + lead, at + lead + len(core)) if len(core) >= RUN else None


def mixed(value: str) -> bool:
    return re.search("[0-9]", value) is not None and re.search("[A-Za-z]", value) is not None


def candidates(texts: list[str | None], column) -> list[list[tuple[str, int, int]]]:
    """(rule, start, end) in code points for each text, without overlaps: of two, the longer stays.

    A run is cut at its inner '=' into the parts that are candidates themselves. One without such parts is whole.
    """
    buf, offsets = column_bytes(column)
    found: list[list] = [[] for _ in texts]
    whole: list[list] = [[] for _ in texts]
    raw = buf.tobytes()
    start, end = runs(buf, offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)]) if len(start) else offsets  # code points before a byte
    for d, a, b, at in zip(doc.tolist(), start.tolist(), end.tolist(), (points[start] - points[offsets[doc]]).tolist() if len(start) else [], strict=True):
        value = raw[a:b].decode()
        cores = [core for m in PART.finditer(value) if (core := trim(m[0], at + m.start())) and mixed(value[core[0] - at : core[1] - at])] if "=" in value else []
        if cores:
            found[d] += [("run", *core) for core in cores]
        elif core := trim(value, at):
            (whole if "=" in value.rstrip("=") else found)[d].append(("run", *core))  # name and value together only where nothing else is found
    for d, text in enumerate(texts):
        if text:
            for rule, pattern in RULES.items():
                if HINTS[rule].search(text):
                    found[d] += [(rule, *m.span(m.re.groups)) for m in pattern.finditer(text)]
    out = []
    for spans, others in zip(found, whole, strict=True):
        kept: list = []  # in order of place; they don't overlap
        starts: list[int] = []
        for s in sorted(spans, key=lambda s: (s[1] - s[2], s[1])) + others:
            i = bisect_left(starts, s[1])
            if (i == 0 or kept[i - 1][2] <= s[1]) and (i == len(kept) or s[2] <= starts[i]):
                kept.insert(i, s)
                starts.insert(i, s[1])
        out.append(kept)
    return out


def labelled_findings(n: int = LABELLED, seed: int = 5) -> list[tuple[str, str, str, str, bool]]:
    """(rule, before, value, after, is a secret): the candidates of labelled texts; what shares characters with a secret is one."""
    import pyarrow as pa

    labelled = labelled_texts(2 * n, seed)
    texts = [t for t, _ in labelled]
    out = [(rule, t[max(0, a - BEFORE) : a], t[a:b], t[b : b + AFTER], gold is not None and a < gold[1] and b > gold[0]) for (t, gold), found in zip(labelled, candidates(texts, pa.array(texts)), strict=True) for rule, a, b in found]
    return out[:n]


def labelled_texts(n: int, seed: int = 5) -> list[tuple[str, tuple[int, int] | None]]:
    """Short texts with the place of the secret in them, if any: made by rule from the usual shapes of both kinds."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    vocabulary = sorted(DICTIONARY)
    word = lambda: rng.choice(vocabulary)
    noise = lambda: " ".join(pick("aeinorstlhd", rng.randint(2, 7)) for _ in range(rng.randint(2, 6)))
    name = lambda: rng.choice(["token", "api_key", "apiKey", "secret", "auth_token", "client_secret", "access_token", "private_key", "API_TOKEN", "authorization: bearer", "AWS_ACCESS_KEY_ID", "export SECRET_KEY", "https://api.net/v1?token", "--auth-token", "DB_KEY_2"])
    assign = lambda: rng.choice([" = \"", "=\"", ": \"", " = '", "=", ": ", " => \""])

    password = lambda: rng.choice(["password", "password", "DB_PASSWORD", "passwd", "pwd", "client_secret", "--password"])

    def close(lead: str) -> str:
        return lead[-1] if lead[-1] in "\"'" else ""

    def block() -> str:
        kind, end = rng.choice(["", "RSA ", "EC ", "OPENSSH "]), rng.choice(["\n", "\n", "\\n"])
        head = rng.choice(["", "", f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,{pick(hexa, 32).upper()}{end}{end}"])
        return f"-----BEGIN {kind}PRIVATE KEY-----{end}{head}" + "".join(pick(b62 + "+/", 64) + end for _ in range(rng.choice([3, 6, 25, 50]))) + f"-----END {kind}PRIVATE KEY-----"

    def one() -> tuple[str, str, str, str, bool]:
        k, a = rng.randrange(16), assign()
        if k < 3:
            return "run", f"{noise()} {name()}{a}", pick(hexa, rng.choice([32, 40, 40, 64])), close(a) + " " + noise(), True
        if k < 5:
            return "run", f"{noise()} {name()}{a}", pick(b62 + "+/_-", rng.randint(20, 64)), close(a) + " " + noise(), True
        if k == 5:
            return "run", rng.choice([noise() + " ", f"{noise()} {name()}{a}"]), rng.choice(["AKIA" + pick(b62[:26] + b62[52:], 16), "ghp_" + pick(b62, 36), "sk_live_" + pick(b62, 24), "glpat-" + pick(b62, 20)]), close(a) + " " + noise(), True
        if k == 6:
            q = rng.choice(["\"", "'", ""])
            return "password", f"{noise()} {password()}{rng.choice([' = ', '=', ': '])}{q}", pick(b62, 2) + pick(b62 + "!#%*?", rng.randint(6, 18)), q + rng.choice([" ", "\n"] if q else [" ", "\n", "&user=", ", "]) + noise(), True
        if k == 7:
            return rng.choice([("web_token", f"{noise()} {name()}{a}", "eyJ" + pick(b62, 20) + "." + pick(b62, 60) + "." + pick(b62, 40), close(a), True), ("private_key", noise() + "\n", block(), "\n", True)])
        if k == 8:
            return "run", f"{noise()} {rng.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'etag', 'integrity', 'revision', 'parent', 'tree'])}{rng.choice([' ', ': ', '=', ' = '])}", pick(hexa, rng.choice([32, 40, 64])), " " + noise(), False
        if k == 9:
            return "run", f"{noise()} {rng.choice(['uuid', 'id', 'request', 'session', 'trace'])}{rng.choice([' ', ': ', '='])}", "-".join(pick(hexa, c) for c in (8, 4, 4, 4, 12)), " " + noise(), False
        if k == 10:
            return "run", f"{noise()} {rng.choice(['/', 'https://' + word() + '/', './'])}", "/".join(word() + rng.choice(["", str(rng.randint(1, 99))]) for _ in range(rng.randint(3, 6))), rng.choice([".html", ".js", " ", "/"]), False
        if k == 11:
            s = rng.choice(["_", "-", ""])
            return "run", f"{noise()} {rng.choice([name() + a, '', 'class ', 'import '])}", s.join((word() if s else word().capitalize()) for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 2030)), close(a) + rng.choice([" ", "(", ";"]), False
        if k == 12:
            return "run", f"{noise()} {name()}{a}", rng.choice(["YOUR_API_KEY_HERE_", "your-secret-token-", "example_token_", "test_key_placeholder_", "xxxxxxxxxxxxxxxxxxxx", "REPLACE_WITH_TOKEN_", "dummy_secret_value_"]) + str(rng.randint(1, 9999)), close(a) + " " + noise(), False
        if k == 13 and rng.random() < 0.5:
            return "password", f"{noise()} {rng.choice([password(), 'secret', 'the password'])}{rng.choice([' = ', '=', ': '])}", rng.choice([word(), word() + word().capitalize(), f"{word()}.{word()}", f"{word()}_{word()}", f"get{word().capitalize()}()", f"${{{word()}}}", pick("aeinorstlhd", rng.randint(6, 12)), "<" + word() + ">"]), rng.choice([" ", ", ", "; ", "\n"]) + noise(), False
        if k == 13:
            return "password", f"{noise()} password{rng.choice([' = ', '=', ': '])}\"", rng.choice(["changeme", "password", "example", "your_password", "placeholder", "${PASSWORD}", "******", "<password>", word() + word()]), "\" " + noise(), False
        if k == 14:
            return "run", noise() + " ", pick("aeioutrnsl", rng.randint(10, 24)) + str(rng.randint(0, 99999)) + pick("aeioutrnsl", rng.randint(0, 8)), rng.choice([" ", ".", "@", ", "]), False
        return "run", f"{noise()} {rng.choice(['file', 'image', 'asset', 'chunk', 'node'])}{rng.choice([' ', '=', ': ', '-'])}", rng.choice([pick(hexa, 20), word() + "-" + pick(hexa, 16), pick("0123456789", 14) + word()]), rng.choice([".png", ".js", " ", ".css"]), False

    out = []
    for _ in range(n):
        _, before, value, after, secret = one()
        out.append((before + value + after, (len(before), len(before) + len(value)) if secret else None))
    return out


@functools.lru_cache(maxsize=4)
def _fit(labelled: tuple) -> tuple[list, float]:
    x = np.array([features(*f[:4]) for f in labelled])
    y = np.array([f[4] for f in labelled], float)
    held = np.arange(len(y)) % 4 == 0
    model = trees.forest(x[~held], y[~held], TREES)
    # most trees have to agree, even where held-out labels are told apart by fewer
    return model, max(trees.calibrate(trees.vote(model, x[held]), y[held], PRECISION), 0.5)


def fit(labelled: list[tuple[str, str, str, str, bool]] | None = None) -> tuple[list, float]:
    """Forest and threshold from at most LABELLED labelled findings, a quarter of them held out for the threshold."""
    return _fit(tuple((labelled or labelled_findings())[:LABELLED]))


def judged(texts: list[str | None], column, model: tuple[list, float]) -> list[list[tuple[str, int, int, float]]]:
    """Candidates of each text with their scores."""
    spans = candidates(texts, column)
    rows = [features(rule, t[max(0, a - BEFORE) : a], t[a:b], t[b : b + AFTER]) for t, found in zip(texts, spans, strict=True) for rule, a, b in found]
    score = iter(trees.vote(model[0], np.array(rows)).tolist() if rows else [])
    return [[(rule, a, b, next(score)) for rule, a, b in found] for found in spans]


def scan(docs: DataFrame, model: tuple[list, float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_candidates, n_secrets, secrets (array of rule, start, end, score, sha256 of the
    value; code points, end exclusive).

    A null or empty text has none. Repeated rows are alike, an empty table gives an empty result, and texts and values of
    any length are read whole. Of candidates that overlap the longer stays, of equally long ones the first. Other columns
    of docs play no part.
    """
    model = model or fit()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sha256", pa.string())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = judged(texts, batch.column(1), model)
            secrets = [[{"rule": r, "start": a, "end": b, "score": s, "sha256": hashlib.sha256(t[a:b].encode()).hexdigest()} for r, a, b, s in f if s >= model[1]] for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([len(s) for s in secrets], pa.int64()), pa.array(secrets, kind)], names=["doc_id", "n_candidates", "n_secrets", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_candidates long, n_secrets long, secrets array<struct<rule:string,start:bigint,end:bigint,score:double,sha256:string>>")


def redact(docs: DataFrame, model: tuple[list, float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars (where it is) set to the new length of changed texts.

    All other columns pass through as they are, whatever their names; no row is dropped. Null and empty texts, repeated
    rows, overlaps and long values are as in `scan`; an empty table stays empty. Other integer or null n_chars values stay.
    """
    model = model or fit()
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, found in enumerate(judged(texts, batch.column(at), model)):
                if hits := [f for f in found if f[3] >= model[1]]:
                    t, pos, out = texts[i], 0, []
                    for _, a, b, _ in hits:
                        out += [t[pos:a], mark]
                        pos = b
                    changed[i] = "".join([*out, t[pos:]])
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                for k, name in enumerate(names):
                    if name == "n_chars" and pa.types.is_integer(columns[k].type):
                        columns[k] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    with small_batches(spark):
        found = stored(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), "secrets")
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_candidates", "n_secrets", F.array_join(spans, ",").alias("spans"), F.array_join(F.transform("secrets", lambda s: s["sha256"]), ",").alias("value_sha256"))
