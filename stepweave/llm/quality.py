"""Quality rules with verdicts on hosts.

Documents fail rules by themselves; failures are summed by host (one row per host leaves each map task), host rates are
shrunk towards an empirical beta prior fitted on all hosts by moments, and the hosts' verdicts are joined back: a host
whose shrunk failure rate is above the threshold loses its other documents too. Small hosts stay near the prior, so a
few bad pages don't condemn them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import stored, words
from stepweave.llm.mixing import source_key

#: Rules of a document: at least so many words, and at most such a share of words in repeated windows.
MIN_WORDS, WINDOW_WORDS, MAX_REPEAT_PERCENT = 10, 5, 20
#: A host is rejected when the shrunk share of its documents that fail is above this.
MAX_HOST_RATE = 0.5


def measure(text: Column) -> list[dict[str, Column]]:
    """Steps of columns to add one after another: the measures of a text and base_failed (see judge)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    some = F.size("_w") > WINDOW_WORDS
    repeats = F.when(F.col("_h").isNull() | (F.size(F.array_distinct("_h")) == F.size("_h")), 0).otherwise(_covered(F.col("_h")))
    return [
        {"_w": words(text), "_l": F.when(F.contains(text, F.lit("\n")), lines)},
        {"_h": F.when(some, _windows(F.col("_w")))},
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.coalesce(F.size("_l") - F.size(F.array_distinct("_l")), F.lit(0)).cast("long"),
            "n_repeat_words": repeats.cast("long"),
        },
        {"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))},
    ]


def _windows(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(WINDOW_WORDS)]))


def _covered(hashes: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""
    k = WINDOW_WORDS
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # neighbours in that order tell which occur again; positions of those, in order of the text
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    begin = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, begin, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(k), i - a["last"])).alias("n")), lambda a: a["n"])


def hosts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host (_host): documents, failures, shrunk rate and verdict host_rejected.

    The beta prior has the hosts' mean rate and the variance between hosts that is left after that of sampling
    (moments); with no such variance, or one host, the prior is strong and every host gets about the mean.
    """
    by = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    return _shrunk(stored(by, "host_counts"), max_rate)  # written, as it is read twice and measured may be a scan of texts


def _shrunk(by: DataFrame, max_rate: float) -> DataFrame:
    rate = F.col("host_failed") / F.col("host_docs")
    # one row: totals over hosts, in whole numbers and sums over hosts
    total = by.agg(F.count(F.lit(1)).alias("h"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(rate * F.col("host_failed")).alias("q")).first()
    h, n, f = total["h"], total["n"] or 0, total["f"] or 0
    mean = f / n if n else 0.0
    # weighted variance of host rates, less the binomial part
    between = max((total["q"] or 0.0) / n - mean * mean - mean * (1 - mean) * h / n, 0.0) if n else 0.0
    strength = min(mean * (1 - mean) / between - 1, 1e6) if between > 0 else 1e6
    strength = max(strength, 1.0)
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return by.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_rate)


def domain(url: Column) -> Column:
    """The host of a URL in lower case, without www.; null where there is none. For judge's `host`."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE, carry: tuple[str, ...] = (), host: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line), n_repeat_words (words in windows of WINDOW_WORDS found twice or more, the
    first included), base_failed, kept, and `carry`.

    kept is false for documents that fail and for all documents of a rejected host: the source, or what `host` gives (the
    domain of a URL, say). A null text counts as empty: all measures 0, and it fails. A null host is a host of its own. An empty table gives an empty result. Rows are judged
    one by one, repeated rows alike; columns of docs that aren't named play no part.
    """
    rows = docs.select("doc_id", "source", "text", source_key(F.col("source") if host is None else host).alias("_host"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    for step in measure(F.col("text")):
        rows = rows.withColumns(step)
    rows = rows.drop("text", "_w", "_l", "_h")
    if carry:
        # what is carried may be as large as docs, so these rows are measured again instead of written; the second part is
        # never true and keeps filters on base_failed from being moved into the steps above, where they would measure over and over
        rows = rows.withColumn("base_failed", F.col("base_failed") | (F.monotonically_increasing_id() < 0))
    else:
        rows = stored(rows, "quality")
    # written, so that its true size decides how it is joined
    verdict = stored(hosts(rows, max_rate).select("_host", "host_rejected"), "hosts")
    out = rows.join(verdict, "_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    names = ("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*names, *[F.col(f"_carry_{c}").alias(c) for c in carry if c not in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'null') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (
  SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
m AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM f GROUP BY host),
t AS (SELECT count(*)::DOUBLE AS hosts, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f / n * f) AS q FROM h),
v AS (SELECT *, greatest(q / n - mean * mean - mean * (1 - mean) * hosts / n, 0) AS var FROM t),
s AS (SELECT mean, greatest(CASE WHEN var > 0 THEN least(mean * (1 - mean) / var - 1, 1e6) ELSE 1e6 END, 1) AS k FROM v),
x AS (SELECT host, (f + mean * k) / (n + k) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN x USING (host)
"""
