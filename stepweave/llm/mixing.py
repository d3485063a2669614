"""Mixing sources to target weights by hash-threshold histograms.

A source's target is a whole number of passes over it and a part of one more. The part is cut by a threshold on a hash
of the row: sums of tokens by source and hash bucket show in which bucket the budget ends; only that bucket is split
into finer buckets, and again, until it holds one row. Rows are then filtered by one comparison with their source's
threshold; nothing is sorted, and a larger budget always keeps what a smaller one kept (nested). Rows that repeat are
numbered and hashed with their number, so that a threshold can fall between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.llm.common import WORD, prefix_sums, stored

#: Bits of the hash that one histogram resolves, and how many histograms there are at most (60 bits in all).
BITS, LEVELS = 12, 5
#: A source gets at most this many passes.
MAX_PASSES = 2


def source_key(source: Column) -> Column:
    """A key that joins null with null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """Add target (double) to one row per source (source, source_size long, other columns).

    Sources by code point, null last, weigh weights[0], weights[1], ... in turn. share x all sizes are dealt by weight;
    a target stops at MAX_PASSES x its source's size, and the excess goes to the others by weight until none is above.
    Solved at once: in the order of MAX_PASSES x size / weight the sources that stop come first, and from the first one
    that stays below its limit on, all do. Sources of size 0 get target 0.
    """
    named = sizes.withColumn("_none", F.col("source").isNull())
    turn = prefix_sums(named, ["_none", "source"]).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    turn = turn.drop("_before", "_rank").withColumn("_most", F.col("source_size") * MAX_PASSES).withColumn("_fill", F.col("_most") / F.col("_w"))
    out = stored(prefix_sums(turn, ["_fill", "_none", "source"], "_most", {"_ahead_w": "_w"}), "mix_order")
    total = out.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    amount, all_w = (total["size"] or 0) * share, total["w"] or 0
    own = (F.lit(amount) - F.col("_before")) * F.col("_w") / (F.lit(all_w) - F.col("_ahead_w"))
    at = out.filter(own <= F.col("_most")).agg(F.max(F.struct((F.lit(all_w) - F.col("_ahead_w")).alias("w"), F.col("_before").alias("stopped"))).alias("m")).first()["m"]
    target = F.col("_most").cast("double")
    if at:
        level = (F.lit(amount) - F.lit(at["stopped"])) * F.col("_w") / F.lit(at["w"])
        target = F.when(level <= F.col("_most"), level).otherwise(target)
    return out.withColumn("target", target).drop("_none", "_w", "_most", "_fill", "_before", "_ahead_w", "_rank")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (_src, _u, _part, _at, ...) with the hash _u of a row's second, third, ... repetition made from it and its number.

    Only hashes that occur again are touched. They are counted by hash and input partition (_part), so a row that a third
    of all rows repeat is numbered by as many tasks as it came from.
    """
    again = stored(rows.groupBy("_src", "_u").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_src", "_u"), "mix_again")
    if again.isEmpty():
        return rows
    several = rows.join(again, ["_src", "_u"], "left_semi")
    ahead = Window.partitionBy("_src", "_u").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = several.groupBy("_src", "_u", "_part").agg(F.count(F.lit(1)).alias("_n")).select("_src", "_u", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_src", "_u", "_part").orderBy("_at")
    counted = several.withColumn("_k", F.row_number().over(inside) - 1).join(parts, ["_src", "_u", "_part"]).withColumn("_k", F.col("_k") + F.col("_base"))
    other = hash60(F.concat(F.col("_u").cast("string"), F.lit(":"), F.col("_k").cast("string")))
    moved = counted.withColumn("_u", F.when(F.col("_k") == 0, F.col("_u")).otherwise(other))
    return stored(rows.join(again, ["_src", "_u"], "left_anti").select(rows.columns).union(moved.select(rows.columns)), "mix_numbered")


def hash60(text: Column) -> Column:
    """The first BITS * LEVELS bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """_src, _low: rows (_src, size, _u) with _u < _low have sizes whose sum is nearest to the budget (_src, _left)."""
    edge = budgets.withColumn("_low", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        step = BITS * (LEVELS - level)
        width = 1 << (step + BITS)
        bucket = F.shiftright("_u", step)
        at_edge = rows.join(edge.select("_src", "_low"), "_src").filter((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_low") + width))
        sums = at_edge.groupBy("_src", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        # at most 2 ** BITS rows for a source
        run = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("_run", F.sum("_sum").over(run)).join(edge.select("_src", "_left"), "_src").filter(F.col("_run") > F.col("_left"))
        ends = over.groupBy("_src").agg(F.min(F.struct("_bucket", "_run", "_sum", "_n")).alias("_e"))
        rest = F.col("_left") - (F.col("_e._run") - F.col("_e._sum"))
        edge = stored(
            edge.select("_src", "_left", "_low").join(ends, "_src", "left").select(
                "_src",
                F.when(F.col("_e").isNull(), 0.0).otherwise(rest).alias("_left"),
                F.when(F.col("_e").isNull(), F.col("_low") + width).otherwise(F.shiftleft("_e._bucket", step)).alias("_low"),
                F.coalesce("_e._sum", F.lit(0)).alias("_sum"),
                F.coalesce("_e._n", F.lit(0)).alias("_n"),
            ),
            "mix_edge",
        )
        if not step or edge.filter("_n > 1").isEmpty():
            break
        # a source whose edge bucket holds one row (or none) is left as it is by finer histograms too
    return edge.select("_src", F.when((F.col("_n") > 0) & (2 * F.col("_left") >= F.col("_sum")), F.col("_low") + (1 << step)).otherwise(F.col("_low")).alias("_low"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies (0 to MAX_PASSES), taken, `carry`.

    size: words of the text (null: 0). copies: the whole passes of the source, and one more where the row's hash is
    below the source's threshold; taken = copies * size. A source's taken words miss its target by half a row at most.
    Rows equal in doc_id, text and source are numbered and taken one by one; which of them comes first is open. A null
    source is a source. An empty table gives an empty result; columns of docs that aren't named play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    u = hash60(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    at = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    rows = docs.select("doc_id", "source", source_key(F.col("source")).alias("_src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), u.alias("_u"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    rows = numbered(stored(rows.withColumns(at), "mix_rows"))
    plan = targets(rows.groupBy("_src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, share)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(plan.withColumn("_passes", passes.cast("int")).withColumn("_left", F.col("target") - F.col("_passes") * F.col("source_size")), "mix_plan")
    low = thresholds(rows.select("_src", "size", "_u"), plan.select("_src", "_left"))
    copies = F.col("_passes") + F.when(F.col("_u") < F.col("_low"), 1).otherwise(0)
    cuts = stored(plan.drop("source", "_left").join(low, "_src"), "mix_cuts")  # written, so that its true size decides the join
    out = rows.join(cuts, "_src").withColumn("copies", F.least(copies, F.lit(MAX_PASSES)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry if c not in ("doc_id", "source")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same choice with running sums over the sorted hashes.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, src, source, size, CASE WHEN k = 0 THEN u ELSE ('0x' || substr(md5(u || ':' || k), 1, 15))::BIGINT END AS u FROM (
    SELECT *, row_number() OVER (PARTITION BY src, u) - 1 AS k FROM (
      SELECT doc_id, coalesce('s' || source, 'null') AS src, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS u
      FROM documents))),
s AS (
  SELECT src, source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY src, source),
t AS (
  SELECT *, 2 * source_size AS most, sum(source_size) OVER () * 1.5::DOUBLE AS share,
         coalesce(sum(2 * source_size) OVER a, 0)::BIGINT AS stopped, (sum(w) OVER () - coalesce(sum(w) OVER a, 0))::BIGINT AS left_w
  FROM s WINDOW a AS (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_max(stopped, left_w) AS stopped0, max(left_w) AS left_w0 FROM t WHERE (share - stopped) * w / left_w <= most),
p AS (
  SELECT src, source_size, least(coalesce((share - stopped0) * w / left_w0, most), most)::DOUBLE AS target FROM t, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM p),
g AS (SELECT src, u, sum(size)::BIGINT AS n FROM d GROUP BY src, u),
c AS (
  SELECT g.src, g.u, g.n, sum(g.n) OVER (PARTITION BY g.src ORDER BY g.u) AS run, q.target - q.passes * q.source_size AS part
  FROM g JOIN q USING (src)),
e AS (SELECT src, min(u) AS u, arg_min(2 * (part - (run - n)) >= n, u) AS in_too FROM c WHERE run > part GROUP BY src)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (least(2, q.passes + CASE WHEN e.u IS NULL OR d.u < e.u OR (d.u = e.u AND e.in_too) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN q USING (src) LEFT JOIN e USING (src)
"""
