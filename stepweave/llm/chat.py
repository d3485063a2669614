"""Conversations without quotes, in reply order, from quotation links.

Lines that open with > marks are quotes; the number of marks is their level. A run of quoted lines of one level is a
passage; it, its paragraphs and its lines are normalised (case, white space) and hashed, and so are the own words of
every message. Quotes are joined to the earliest message of the conversation that said the same; a message answers the
one from which its outermost linked level quotes most. Threads are the roots of these answers, found by pointer jumps,
and messages are ranked by thread and turn through range totals: a conversation of any length stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import cut, prefix_sums, stored
from stepweave.llm.pii import let

MARKS = r"^[ \t]{0,3}(?:>[ \t]?)+"
#: A line that only announces a quote, right before one.
ANNOUNCES = r"(?i)^.{0,300}\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s?:\s*$"
#: Messages in one row of `chats`.
SEGMENT = 1000


def lines(text: Column) -> Column:
    """Array of (level, body) of a text's lines."""
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.substring(x, F.length(marks(x)) + 1, F.length(x)).alias("body")))


def own_words(parsed: Column) -> Column:
    """The lines of level 0, without announcements of quotes and outer blank lines."""
    keep = lambda p: lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ANNOUNCES) & (F.coalesce(F.get(p, i + 1)["level"], F.lit(0)) > 0))
    text = let(parsed, lambda p: F.array_join(F.transform(F.filter(p, keep(p)), lambda x: x["body"]), "\n"))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def passages(parsed: Column) -> Column:
    """Array of (level, text): runs of quoted lines of one level. Lines are sliced from run to run, each once."""
    return let(parsed, _runs)  # bound: a filter that is pushed down would put all of it wherever it is named


def _runs(parsed: Column) -> Column:
    begins = F.filter(F.transform(parsed, lambda x, i: F.when((i == 0) | (x["level"] != F.get(parsed, i - 1)["level"]), i)), lambda i: i.isNotNull())
    run = lambda b: lambda s, j: F.struct(F.get(parsed, s)["level"].alias("level"), s.alias("at"), (F.coalesce(F.get(b, j + 1), F.size(parsed)) - s).alias("n"))
    text = lambda r: F.array_join(F.transform(F.slice(parsed, r["at"] + 1, r["n"]), lambda x: x["body"]), "\n")
    return let(begins, lambda b: F.transform(F.filter(F.transform(b, run(b)), lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), text(r).alias("text"))))


def units(text: Column) -> Column:
    """Distinct (hash, weight) of a text, its paragraphs and its lines, normalised; weight is the normalised length."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    kept = F.filter(F.array_distinct(F.transform(parts, norm)), lambda x: x != "")
    return F.transform(kept, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("weight")))


def answers(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_linked (quoted units found) for messages (conv_id, turn, _quotes, _own) that answer one."""
    quoted = parsed.filter(F.size("_quotes") > 0).select("conv_id", "turn", F.explode("_quotes").alias("p")).select("conv_id", "turn", "p.level", F.explode(units(F.col("p.text"))).alias("u"))
    quoted = stored(quoted.select("conv_id", "turn", "level", "u.hash", "u.weight").distinct(), "quotes")
    said = parsed.select("conv_id", "turn", F.explode(units(F.col("_own"))).alias("u")).groupBy("conv_id", "u.hash", "u.weight").agg(F.min("turn").alias("source"))
    # one row of `said` for a key, so a passage that very many messages quote brings one row for each quote
    found = quoted.join(said, ["conv_id", "hash", "weight"]).filter(F.col("source") < F.col("turn"))
    by = found.groupBy("conv_id", "turn", "level", "source").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    best = by.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "weight", "source")).alias("b"), F.sum("n").alias("n_linked"))
    return stored(best.select("conv_id", "turn", F.col("b.source").alias("reply_to"), "n_linked"), "answers")


def threads(answers_: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the turn of the first message of its chain), depth, for messages that answer one."""
    state = answers_.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_to"), F.col("depth").alias("_more"))
        new = stored(state.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("_to", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_to").isNotNull().alias("_moved")), "threads")
        state = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return state


def reply_ordered(messages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of messages: conv_id, turn, role, text (own words), n_quoted (quoted lines), reply_to (turn; null if
    nothing quoted is found), n_linked, thread, depth, position (gapless from 0 in the conversation), `carry`.

    A thread is ordered by turn, threads by their first turn; an answer so follows what it answers. A null text is
    empty; rows with a null conv_id or turn link with nothing; null conversations are one conversation for positions.
    Rows that repeat a turn are linked together and ranked next to each other. An empty table gives an empty result.
    """
    parsed = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    some = F.col("_text").rlike(r"(?m)^[ \t]{0,3}>")
    none = F.array().cast("array<struct<level:int,text:string>>")
    parsed = parsed.withColumn("_some", some).withColumn("_lines", F.when(F.col("_some"), lines(F.col("_text"))))
    parsed = parsed.withColumns({
        "_own": F.when(F.col("_some"), own_words(F.col("_lines"))).otherwise(F.regexp_replace("_text", r"^\s+|\s+$", "")),
        "_quotes": F.when(F.col("_some"), passages(F.col("_lines"))).otherwise(none),
        "n_quoted": F.when(F.col("_some"), F.size(F.filter("_lines", lambda x: x["level"] > 0))).otherwise(0).cast("long"),
    })
    linked = answers(parsed.select("conv_id", "turn", "_own", "_quotes"))
    chain = linked.join(threads(linked), ["conv_id", "turn"])
    out = parsed.select("conv_id", "turn", "role", F.col("_own").alias("text"), "n_quoted", *[c for c in parsed.columns if c.startswith("_carry_")]).join(chain, ["conv_id", "turn"], "left")
    out = out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long"), "_id": F.monotonically_increasing_id()})
    out = stored(out, "messages")
    ranked = cut(prefix_sums(out.select("conv_id", "thread", "turn", "_id"), ["conv_id", "thread", "turn", "_id"]).select("conv_id", "_id", "_rank"))
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first")).select(F.col("conv_id").alias("_conv"), "_first")
    position = ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(F.col("_id").alias("_row"), (F.col("_rank") - F.col("_first")).alias("position"))
    names = ("conv_id", "turn", "role", "text", "n_quoted", "reply_to", "n_linked", "thread", "depth", "position")
    return out.join(position, F.col("_id") == F.col("_row")).select(*names, *[F.col(f"_carry_{c}").alias(c) for c in carry if c not in names])


def chats(ordered: DataFrame) -> DataFrame:
    """conv_id, segment, messages (array of position, role, text, reply_to): SEGMENT messages a row, in reply order."""
    message = F.struct("position", "role", "text", "reply_to")
    return ordered.groupBy("conv_id", F.floor(F.col("position") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("text_md5", F.md5(F.col("text"))).withColumn("text_chars", F.length("text").cast("long")).drop("text")


#: Over conversations whose quotes, if any, are whole lines; the same choice of what is answered.
ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text,
         list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'level': length(regexp_replace(regexp_extract(x, '^[ \t]{0,3}(?:>[ \t]?)+'), '[^>]', '', 'g')), 'body': substr(x, length(regexp_extract(x, '^[ \t]{0,3}(?:>[ \t]?)+')) + 1)}) AS l
  FROM conversations),
o AS (
  SELECT id, conv_id, turn, role, len(list_filter(l, lambda x: x.level > 0))::BIGINT AS n_quoted, l,
         regexp_replace(array_to_string(list_transform(list_filter(l, lambda x, i: x.level = 0 AND NOT (regexp_matches(x.body, '(?i)^.{0,300}\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s?:\s*$') AND coalesce(l[i + 1].level, 0) > 0)), lambda x: x.body), chr(10)), '^\s+|\s+$', '', 'g') AS own
  FROM m),
x AS (SELECT id, conv_id, turn, i, l[i].level AS level, l[i].body AS body FROM (SELECT id, conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM o WHERE n_quoted > 0)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM x WHERE level > 0),
p AS (SELECT conv_id, turn, level, string_agg(body, chr(10) ORDER BY i) AS text FROM r GROUP BY id, conv_id, turn, level, run),
u AS (
  SELECT DISTINCT conv_id, turn, level, unit FROM (
    SELECT conv_id, turn, level, trim(regexp_replace(lower(unnest(list_concat([text], regexp_split_to_array(text, '\n[ \t]*\n'), string_split(text, chr(10))))), '\s+', ' ', 'g')) AS unit FROM p) WHERE unit <> ''),
s AS (
  SELECT conv_id, unit, min(turn) AS source FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(unnest(list_concat([own], regexp_split_to_array(own, '\n[ \t]*\n'), string_split(own, chr(10))))), '\s+', ' ', 'g')) AS unit FROM o) WHERE unit <> '' GROUP BY 1, 2),
f AS (SELECT u.conv_id, u.turn, level, source, sum(length(unit)) AS w, count(*) AS n FROM u JOIN s USING (conv_id, unit) WHERE source < turn GROUP BY 1, 2, 3, 4),
a AS (SELECT conv_id, turn, arg_max(source, (-level, w, source)) AS reply_to, sum(n)::BIGINT AS n_linked FROM f GROUP BY 1, 2),
t(conv_id, turn, thread, depth) AS (
  SELECT conv_id, turn, reply_to, 1 FROM a
  UNION ALL SELECT t.conv_id, t.turn, a.reply_to, depth + 1 FROM t JOIN a ON a.conv_id = t.conv_id AND a.turn = t.thread),
e AS (SELECT conv_id, turn, min(thread) AS thread, max(depth)::BIGINT AS depth FROM t GROUP BY 1, 2),
z AS (
  SELECT o.conv_id, o.turn, o.role, o.id, n_quoted, reply_to, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(e.thread, o.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth, own
  FROM o LEFT JOIN a USING (conv_id, turn) LEFT JOIN e USING (conv_id, turn))
SELECT conv_id, turn, role, n_quoted, reply_to, n_linked, thread, depth,
       (row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, id) - 1)::BIGINT AS position, md5(own) AS text_md5, length(own)::BIGINT AS text_chars
FROM z
"""
