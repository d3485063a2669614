"""Queries of the engine over the driver's tables, with the SQL that gives the same rows.

Each binds one operator of the engine (or a composition) to a table; see bindings.py. Where SQL has no form (cycle breaking
with its tie-breaks, merging), the query has none and tests hold it against small cases.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.operators import contain, fuse, gates, graph, merge, review, scope, verify
from stepweave.operators import dims as dm
from stepweave.plans import bindings as b
from stepweave.plans import metrics, query_api, review_queries  # noqa: F401  the last registers its own
from stepweave.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from stepweave.sources import html, readers, schema, sinks

WITH_ACTIONS = "WITH " + b.ACTIONS_SQL
#: The engine's fixed patterns in DuckDB's spelling: no Unicode flag, flags for a part only.
JUNK_SQL = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else p for p in tx.JUNK)
THERMAL_SQL, TIME_SQL, TEMPERATURE_SQL = (p.replace("(?iU)", "(?i)") for p in (tx.THERMAL, tx.TIME_MENTION, tx.TEMPERATURE))
MENTION_SQL = tx.TEMPERATURE_MENTION.replace("(?iU)", "(?i)")
HINTS_SQL = " ".join(f"WHEN regexp_matches(lower(s), '{'|'.join(parts)}') THEN '{label}'" for label, parts in tx.STATE_HINTS)


# Text


@query(rf"""SELECT doc_id, line_no::BIGINT AS line_no FROM (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE length(regexp_replace(line, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')) < {tx.MIN_STEP_CHARS} OR regexp_matches(line, '{JUNK_SQL}')""")
def junk_lines(spark, d):
    return b.lines(spark, d).filter(tx.is_junk(F.col("line"))).select("doc_id", "line_no")


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, count(*) FILTER (WHERE NOT junk) AS kept, count(*) FILTER (WHERE junk) AS dropped FROM (
  SELECT doc_id, length(regexp_replace(line, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')) < {tx.MIN_STEP_CHARS} OR regexp_matches(line, '{JUNK_SQL}') AS junk FROM l) GROUP BY doc_id)
SELECT count(*) AS recipes, count(*) FILTER (WHERE kept >= 2) AS recipes_enough, sum(kept)::BIGINT AS steps_kept, sum(dropped)::BIGINT AS steps_dropped, round(sum(dropped) * 100.0::DOUBLE / (sum(kept) + sum(dropped)), 1) AS junk_drop_pct FROM k""")
def step_filter_min2(spark, d):
    """Lines of documents as steps of a page's linked data, through the parser, and their totals."""
    docs = b.table(spark, d, "documents")
    page = F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.lit("x").alias("name"), F.split("text", "\n").alias("recipeInstructions")))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit('<script type="application/ld+json">'), F.replace(page, F.lit("<"), F.lit("\\u003c")), F.lit("</script>")).alias("html"))
    return metrics.ingest_stats(html.parse(pages))


@query(r"""SELECT doc_id, term FROM documents, (VALUES ('the'), ('and'), ('token'), ('de'), ('für')) t(term)
WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])(?i:' || term || ')($|[^\p{L}\p{N}_])')""")
def mention_whole_word(spark, d):
    terms = ["the", "and", "token", "de", "für"]
    return b.table(spark, d, "documents").select("doc_id", F.explode(tx.mentioned(F.col("text"), terms)).alias("term"))


@query(r"""SELECT doc_id, t AS term FROM documents, (SELECT DISTINCT split_part(p_name, ' ', 1) AS t FROM part)
WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_])(?i:' || t || ')($|[^\p{L}\p{N}_])')""")
def mention_terms_of_table(spark, d):
    return contain.mentioned_terms(b.table(spark, d, "documents"), b.part_names(spark, d).select(F.col("adjective").alias("term")))


@query(rf"""SELECT p_partkey, regexp_matches(p_name, '{THERMAL_SQL}') AS thermal,
  regexp_matches(replace(p_name, 'hot', 'heat'), '(?i)\b(heat|cook|warm)\b') AS thermal_reworded FROM part""")
def thermal_flag(spark, d):
    return b.part_names(spark, d).select("p_partkey", tx.is_thermal(F.col("p_name")).alias("thermal"), tx.is_thermal(F.replace("p_name", F.lit("hot"), F.lit("heat"))).alias("thermal_reworded"))


@query(r"""SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])(?i:and|then)($|[^\p{L}\p{N}_])|,|;') AS compound FROM documents""")
def compound_hint(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.may_be_compound(F.col("text")).alias("compound"))


@query(r"""SELECT p_partkey, regexp_replace(lower(trim('  ' || p_name || '  ' || p_type)), '\s+', '_', 'g') AS canonical, regexp_replace(lower(p_name || '   ' || p_type), '\s+', ' ', 'g') AS phrase FROM part""")
def canonical_action(spark, d):
    p = b.table(spark, d, "part")
    return p.select("p_partkey", tx.canonical_action(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")).alias("canonical"), tx.normal_phrase(F.concat("p_name", F.lit("   "), "p_type")).alias("phrase"))


@query(rf"""SELECT o_orderkey, list_transform(regexp_extract_all(t, '{TEMPERATURE_SQL}', 1), lambda x: x::DOUBLE)[1] AS first_temperature,
  len(list_distinct(regexp_extract_all(t, '{TEMPERATURE_SQL}', 1)))::BIGINT AS n_temperatures,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{TIME_SQL}'))), '|') AS times,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{MENTION_SQL}'))), '|') AS mentions
FROM (SELECT o_orderkey, 'cook at ' || (o_custkey % 300) || ' °C or ' || (o_orderkey % 90) || 'F for ' || (o_orderkey % 60) || ' minutes, 0.95 until set' AS t FROM orders)""")
def temp_extract(spark, d):
    text = F.concat(F.lit("cook at "), (F.col("o_custkey") % 300).cast("string"), F.lit(" °C or "), (F.col("o_orderkey") % 90).cast("string"), F.lit("F for "), (F.col("o_orderkey") % 60).cast("string"), F.lit(" minutes, 0.95 until set"))
    found = tx.temperatures(F.col("t"))
    return b.table(spark, d, "orders").withColumn("t", text).select("o_orderkey", F.get(found, F.lit(0)).alias("first_temperature"), F.size(found).alias("n_temperatures"), F.array_join(tx.time_mentions(F.col("t")), "|").alias("times"), F.array_join(tx.temperature_mentions(F.col("t")), "|").alias("mentions"))


@query(r"""SELECT doc_id, CASE WHEN contains(text, s) THEN s WHEN position(translate(s, '’“”', '''""') IN translate(text, '’“”', '''""')) > 0
  THEN substr(text, position(translate(s, '’“”', '''""') IN translate(text, '’“”', '''""')), length(s)) ELSE s END AS span
FROM (SELECT doc_id, replace(text, ' ', '’') AS text, replace(substr(text, 5, 30), ' ', '''') AS s FROM documents)""")
def ground_span(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("’")).alias("text"), F.replace(F.substring("text", 5, 30), F.lit(" "), F.lit("'")).alias("s"))
    return docs.select("doc_id", tx.ground_span(F.col("s"), F.col("text")).alias("span"))


@query(rf"""SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'new' THEN 'liquid' WHEN 'old' THEN 'solid' WHEN 'hot' THEN 'coagulating' WHEN 'cold' THEN 'solid' WHEN 'red' THEN 'scorched' ELSE CASE {HINTS_SQL} ELSE '{tx.LABELS[0]}' END END AS label
FROM (SELECT *, CASE WHEN split_part(p_name, ' ', 1) IN ('new', 'old', 'hot', 'cold', 'red') THEN split_part(p_name, ' ', 1) ELSE CASE WHEN p_size % 4 = 0 THEN 'Soft ' WHEN p_size % 4 = 1 THEN 'firm-' WHEN p_size % 4 = 2 THEN 'over ' ELSE '' END || p_name END AS s FROM part)""")
def label_compile(spark, d):
    known = F.col("adjective").isin("new", "old", "hot", "cold", "red")
    prefix = F.when(F.col("p_size") % 4 == 0, "Soft ").when(F.col("p_size") % 4 == 1, "firm-").when(F.col("p_size") % 4 == 2, "over ").otherwise("")
    state = F.when(known, F.col("adjective")).otherwise(F.concat(prefix, "p_name"))
    return b.part_names(spark, d).select("p_partkey", tx.compile_label(state, b.DIMS.states).alias("label"))


@query(WITH_ACTIONS + "SELECT node_id, count(*) AS n FROM fp GROUP BY node_id")
def fingerprint(spark, d):
    return b.fused(spark, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT substr(sha256(text), 1, 16) AS text_print, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return b.table(spark, d, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("text_print")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '_step' || printf('%02d', p_size) || '.' || (p_size - 24) ELSE p_brand || '_step' || printf('%02d', p_size) END AS artifact,
  CASE WHEN p_brand < p_name THEN p_brand || '__' || p_name ELSE p_name || '__' || p_brand END AS pair FROM part""")
def artifact_and_pair_ids(spark, d):
    sub = F.when(F.col("p_size") > 25, F.col("p_size") - 24).otherwise(1)
    return b.table(spark, d, "part").select("p_partkey", tx.artifact_key(F.col("p_brand"), F.col("p_size"), sub).alias("artifact"), tx.pair_id(F.col("p_brand"), F.col("p_name")).alias("pair"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN l WHEN l = 'a_contains_b' THEN 'b_contains_a' WHEN l = 'b_contains_a' THEN 'a_contains_b' ELSE l END AS shown,
  CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'one' ELSE 'other' END AS provider
FROM (SELECT *, ['same', 'a_contains_b', 'b_contains_a', 'different'][p_partkey % 4 + 1] AS l FROM part)""")
def oriented_labels(spark, d):
    label = F.element_at(F.array(*map(F.lit, schema.PAIR_LABELS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    provider, _ = tx.model_provider(F.concat(F.when(F.col("p_brand").startswith("Brand#1"), "one/").otherwise("x/"), "p_name"), ("one",), "other")
    return b.table(spark, d, "part").select("p_partkey", tx.oriented_label(label, F.lit("a"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b")).alias("shown"), provider.alias("provider"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_field(spark, d):
    return b.table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# Dictionaries and arrays

_ALIAS_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in b.DIMS.aliases.items()) + ") a(alias, canonical)"


@query(f"SELECT p_partkey, coalesce(x.canonical, y.canonical, lower(p_name)) AS entity FROM part LEFT JOIN {_ALIAS_SQL.replace('a(', 'x(')} ON x.alias = lower(p_name) LEFT JOIN {_ALIAS_SQL.replace('a(', 'y(')} ON y.alias = lower(split_part(p_name, ' ', 2))")
def alias_resolve(spark, d):
    p = b.part_names(spark, d)
    whole = nested.resolve(F.col("p_name"), b.DIMS.alias_map())
    last = nested.resolve(F.col("noun"), b.DIMS.alias_map())
    return p.select("p_partkey", F.when(whole != F.lower("p_name"), whole).when(F.col("noun").isin(*b.DIMS.aliases), last).otherwise(whole).alias("entity"))


@query(f"SELECT p_partkey, coalesce(canonical, lower(p_name)) AS canonical FROM part LEFT JOIN {_ALIAS_SQL} ON alias = lower(p_name)")
def alias_resolve_join(spark, d):
    aliases = spark.createDataFrame(list(b.DIMS.aliases.items()), "alias string, canonical string")
    return dm.resolve_join(b.table(spark, d, "part").select("p_partkey", "p_name"), "p_name", aliases).select("p_partkey", "canonical")


@query(f"SELECT count(*) AS pairs, count(*) FILTER (WHERE coalesce(canonical, lower(p_name)) = split_part(p_name, ' ', 2)) AS right FROM part LEFT JOIN {_ALIAS_SQL} ON alias = lower(p_name)")
def alias_accuracy(spark, d):
    gold = b.part_names(spark, d).select(F.col("p_name").alias("alias"), F.col("noun").alias("canonical_gold"))
    aliases = spark.createDataFrame(list(b.DIMS.aliases.items()), "alias string, canonical string")
    return metrics.alias_accuracy(gold, aliases).select("pairs", "right")


@query("""SELECT p_partkey, len(x)::BIGINT AS n_outside, array_to_string(list_sort(x), '|') AS outside FROM (
  SELECT p_partkey, list_filter(list_distinct([split_part(p_name, ' ', 2), lower(p_brand), 'plate']), lambda e: e NOT IN ('bolt', 'gear', 'rod', 'plate', 'ring')) AS x FROM part)""")
def outside_inventory(spark, d):
    empty = F.array().cast("array<string>")
    none = F.array().cast(nested.CONDITIONS)
    outside = nested.outside_entities(none, none, F.array("noun", F.lower("p_brand")), F.array(F.lit("plate")), b.DIMS.alias_map(), list(b.DIMS.inventory))
    return b.part_names(spark, d).select("p_partkey", F.size(outside).alias("n_outside"), F.array_join(F.array_sort(F.coalesce(outside, empty)), "|").alias("outside"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter(list_distinct([(o_custkey % 200)::DOUBLE, (o_orderkey % 90)::DOUBLE]), lambda t: t NOT IN ((o_orderkey % 40)::DOUBLE, 62.0, 70.0, 150.0))), '|') AS invented FROM orders""")
def invented_values(spark, d):
    o = b.table(spark, d, "orders")
    said = F.array(F.concat(F.lit("to "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" °C")))
    step = F.concat(F.lit("heat to "), (F.col("o_orderkey") % 40).cast("string"), F.lit("C"))
    found = nested.invented_temperatures((F.col("o_custkey") % 200).cast("double"), said, step, b.DIMS.known_temperatures)
    return o.select("o_orderkey", F.array_join(F.transform(F.array_sort(found), lambda x: x.cast("string")), "|").alias("invented"))


@query("""SELECT doc_id, (CASE WHEN starts_with(source, 'src1') THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS tp,
  (CASE WHEN starts_with(source, 'src1') THEN 0 ELSE 1 END + CASE WHEN lang = 'en' THEN 0 ELSE 1 END)::BIGINT AS fp, CASE WHEN lang = 'en' THEN 0 ELSE 1 END::BIGINT AS fn FROM documents""")
def set_counts(spark, d):
    one, two = F.col("source").startswith("src1"), F.col("lang") == "en"
    found = F.array(F.lit("always"), F.when(one, "a").otherwise("only found"))
    gold = F.array_compact(F.array(F.when(two, "always"), F.when(~two, "missed"), F.when(one, "a")))
    tp, fp, fn = nested.set_counts(found, gold)
    return b.table(spark, d, "documents").select("doc_id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


# Joins


@query(WITH_ACTIONS + r""", n AS (SELECT DISTINCT node_id, 'egg' AS e FROM fp WHERE event_type <> 'error'),
bounds(seq, bound_id, entity, temperature_c) AS (VALUES (0, 'onset', 'egg', 62.0::DOUBLE), (1, 'full', 'egg', 70.0), (2, 'smoke', 'bolt', 150.0), (3, 'weep', 'gear', NULL))
SELECT node_id, bound_id, temperature_c FROM n, bounds WHERE entity = e OR entity = 'egg'""")
def bounds_theta_join(spark, d):
    rows = b.fused(spark, d).dropDuplicates(["node_id"]).withColumn("thermal", F.col("event_type") != "error").drop("seq")
    return fuse.bounds_of(rows, b.DIMS.bounds_df(spark), b.DIMS.default_entity).select("node_id", "bound_id", "temperature_c")


_RULES_SQL = """, c AS (SELECT recipe_id, step_number AS pos, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'look' WHEN 'click' THEN 'look' WHEN 'purchase' THEN 'buy' END AS cls FROM ev),
rules(rule_id, x, y) AS (VALUES ('start_first', 'start', 'look'), ('start_first', 'start', 'buy'), ('look_first', 'look', 'buy'))
"""


def _classified(spark, d):
    rows = b.events(spark, d).withColumn("action_phrase", F.col("event_type"))
    return fuse.classify(rows, b.DIMS.class_df(spark)).select("recipe_id", "cls", F.col("step_number").alias("pos"))


@query(WITH_ACTIONS + _RULES_SQL + "SELECT DISTINCT i.recipe_id, rule_id, i.pos AS first, j.pos AS then FROM c i JOIN c j ON i.recipe_id = j.recipe_id AND i.pos < j.pos JOIN rules ON i.cls = x AND j.cls = y")
def order_rule_pairs(spark, d):
    return fuse.required_pairs(_classified(spark, d), b.DIMS.rules_df(spark))[0]


@query(WITH_ACTIONS + _RULES_SQL + "SELECT DISTINCT i.recipe_id, rule_id, i.pos AS first, j.pos AS then FROM c i JOIN c j ON i.recipe_id = j.recipe_id AND i.pos < j.pos JOIN rules ON i.cls = y AND j.cls = x")
def order_violations(spark, d):
    return fuse.required_pairs(_classified(spark, d), b.DIMS.rules_df(spark))[1]


_REQUIRED_SQL = """, f AS (SELECT recipe_id, step_number AS pos, node_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'look' WHEN 'click' THEN 'look' WHEN 'purchase' THEN 'buy' END AS cls FROM fp),
req AS (
  SELECT i.node_id AS from_id, j.node_id AS to_id, min({'b': i.recipe_id, 'r': rule_seq, 'i': rule_id}) AS m
  FROM f i JOIN f j ON i.recipe_id = j.recipe_id AND i.pos < j.pos AND i.node_id <> j.node_id
  JOIN (VALUES (0, 'start_first', 'start', 'look'), (0, 'start_first', 'start', 'buy'), (1, 'look_first', 'look', 'buy')) rules(rule_seq, rule_id, x, y) ON i.cls = x AND j.cls = y GROUP BY 1, 2)
"""


def _required(spark, d):
    rows = b.fused(spark, d).withColumn("_p", F.col("action_phrase")).withColumn("action_phrase", F.col("event_type"))
    return fuse.required_edges(fuse.classify(rows, b.DIMS.class_df(spark)), b.DIMS.rules_df(spark))


@query(WITH_ACTIONS + _REQUIRED_SQL + "SELECT from_id, to_id, m.b AS recipe_id, m.i AS rule_id FROM req")
def required_edges(spark, d):
    return _required(spark, d).select("from_id", "to_id", "recipe_id", "rule_id")


@query(WITH_ACTIONS + _REQUIRED_SQL + "SELECT to_id AS node_id, count(*) AS n_required, count(DISTINCT n.canonical_action) AS n_wordings FROM req JOIN (SELECT DISTINCT node_id, canonical_action FROM fp) n ON n.node_id = from_id GROUP BY 1")
def required_before(spark, d):
    nodes = b.fused(spark, d).dropDuplicates(["node_id"])
    found = query_api.GraphQuery(nodes, _required(spark, d)).requirements()
    return found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_required"), F.count_distinct("action_phrase").alias("n_wordings"))


@query("""SELECT p.b AS block, x.k AS a, y.k AS b FROM (SELECT DISTINCT p_brand || ' ' || p_size AS b FROM part) p
JOIN (SELECT p_brand || ' ' || p_size AS b, printf('%08d', p_partkey) AS k FROM part) x USING (b) JOIN (SELECT p_brand || ' ' || p_size AS b, printf('%08d', p_partkey) AS k FROM part) y USING (b) WHERE x.k < y.k""")
def candidate_pairs(spark, d):
    rows = b.table(spark, d, "part").select(F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("block"), F.format_string("%08d", "p_partkey").alias("node_id"))
    return merge.candidate_pairs(rows).select("block", "a", "b")


_MAP_SQL = """, mp AS (SELECT node_id AS node, min(node_id) OVER (PARTITION BY node_type, pre_label, post_label) AS rep FROM (SELECT DISTINCT node_id, node_type, pre_label, post_label FROM fp)),
nx AS (SELECT DISTINCT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp)
"""


def _mapping(spark, d):
    rows = b.fused(spark, d).withColumn("block", nested.block_key(F.col("node_type"), F.col("pre"), F.col("post"))).select("node_id", "block").distinct()
    return rows.select(F.col("node_id").alias("node"), F.min("node_id").over(Window.partitionBy("block")).alias("representative"))


@query(WITH_ACTIONS + _MAP_SQL + "SELECT DISTINCT recipe_id, a.rep AS from_id, b.rep AS to_id FROM nx JOIN mp a ON a.node = f JOIN mp b ON b.node = t WHERE a.rep <> b.rep")
def redirect_edges(spark, d):
    return merge.redirect(fuse.next_edges(b.fused(spark, d)), _mapping(spark, d)).select("recipe_id", "from_id", "to_id")


@query("SELECT item_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text)")
def containment_join(spark, d):
    return contain.containing(b.table(spark, d, "benchmark"), b.table(spark, d, "documents"))


@query("SELECT p_partkey AS item_id, doc_id FROM (SELECT DISTINCT p_partkey, split_part(p_name, ' ', 1) AS t FROM part WHERE p_partkey < 40) p, documents WHERE contains(text, t)")
def containment_of_words(spark, d):
    """Passages of one word, which may be a part of a word."""
    words = b.part_names(spark, d).filter("p_partkey < 40").select(F.col("p_partkey").alias("item_id"), F.col("adjective").alias("text"))
    return contain.containing(words, b.table(spark, d, "documents"))


@query("""SELECT recipe, point, choice, n.n::BIGINT AS alternatives FROM (
  SELECT unnest(recipes) AS recipe, point, choice FROM (VALUES ('pace', 'slow', ['u1', 'u2', 'u3']), ('pace', 'fast', ['u4', 'u5']), ('route', 'direct', ['u2', 'u5', 'u6']), ('route', 'around', ['u1'])) p(point, choice, recipes))
JOIN (SELECT 'u' || user_id AS recipe FROM events GROUP BY 1 HAVING count(*) > 1) USING (recipe), (SELECT 2 AS n) n""")
def preferences_explode(spark, d):
    edges = fuse.next_edges(b.fused(spark, d))
    q = query_api.GraphQuery(spark.createDataFrame([], "node_id string"), edges, b.DIMS.preferences_df(spark))
    return q.branch_preferences().select(F.col("recipe_id").alias("recipe"), "point", "choice", "alternatives")


@query(WITH_ACTIONS + _MAP_SQL + """, e AS (SELECT DISTINCT recipe_id, f, t FROM nx WHERE t IS NOT NULL)
SELECT recipe_id, f AS node_id FROM e UNION SELECT recipe_id, t FROM e EXCEPT SELECT recipe_id, t FROM e""")
def entry_nodes(spark, d):
    rows = b.fused(spark, d)
    return query_api.GraphQuery(rows.dropDuplicates(["node_id"]), fuse.next_edges(rows)).entry_points().select("recipe_id", "node_id")


@query(WITH_ACTIONS + "SELECT recipe_id, step_number, CASE k WHEN 9 THEN 'reject' WHEN 8 THEN 'revise' ELSE 'accept' END AS first, CASE WHEN k = 8 AND value < 100 THEN 'accept' WHEN k = 9 THEN 'reject' WHEN k = 8 THEN 'revise' ELSE 'accept' END AS verdict FROM act")
def prefer_r2(spark, d):
    rows = b.actions(spark, d)
    cols = ["recipe_id", "step_number", "sub_step"]
    first = rows.select(*cols, F.lit(1).alias("pass"), "verdict")
    second = rows.filter("k = 8 and value < 100").select(*cols, F.lit(2).alias("pass"), F.lit("accept").alias("verdict"))
    latest = readers.latest_verdicts(first.unionByName(second))
    return latest.select("recipe_id", "step_number", "verdict").join(first.select("recipe_id", "step_number", F.col("verdict").alias("first")), ["recipe_id", "step_number"])


# Fusing


@query(WITH_ACTIONS + """SELECT node_id, count(*) AS n_observations, count(DISTINCT recipe_id) AS n_recipes, arg_min(action_phrase, (recipe_id, step_number)) AS action_phrase, arg_min(node_type, (recipe_id, step_number)) AS node_type,
round(sum(k)::DOUBLE / count(*) / 10, 6) AS mean_confidence, count(DISTINCT CASE WHEN k > 5 THEN 'bolt' ELSE 'gear' END) + 1 AS n_ingredients, 'plate' AS tools FROM fp GROUP BY node_id""")
def dedup_provenance(spark, d):
    rows = b.fused(spark, d)
    return fuse.nodes(rows).select("node_id", "n_observations", "n_recipes", "action_phrase", "node_type", F.round("mean_confidence", 6).alias("mean_confidence"), F.size("ingredients").alias("n_ingredients"), F.array_join("tools", "|").alias("tools"))


@query(WITH_ACTIONS + f"SELECT node_id, segment, string_agg(recipe_id || '/' || step_number || '/' || k, ',' ORDER BY recipe_id, step_number) AS observations FROM (SELECT *, (row_number() OVER (PARTITION BY node_id ORDER BY recipe_id, step_number) - 1) // {fuse.SEGMENT} AS segment FROM fp) GROUP BY node_id, segment")
def provenance_in_order(spark, d):
    rows = b.fused(spark, d)
    listed = fuse.nested_provenance(fuse.provenance(rows.withColumn("source_span", F.col("k").cast("string"))))
    return listed.select("node_id", "segment", F.array_join(F.transform("provenance", lambda p: F.concat_ws("/", p["recipe_id"], p["step_number"].cast("string"), p["source_span"])), ",").alias("observations"))


@query(WITH_ACTIONS + "SELECT node_id, count(DISTINCT recipe_id) AS n_recipes FROM fp GROUP BY node_id HAVING count(DISTINCT recipe_id) > 1")
def shared_nodes(spark, d):
    return fuse.shared_nodes(fuse.nodes(b.fused(spark, d))).select("node_id", "n_recipes")


@query(WITH_ACTIONS + "SELECT DISTINCT recipe_id, f AS from_id, t AS to_id FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL")
def next_edges(spark, d):
    return fuse.next_edges(b.fused(spark, d)).select("recipe_id", "from_id", "to_id")


@query(WITH_ACTIONS + "SELECT f AS from_id, t AS to_id, min(recipe_id) AS recipe_id, count(DISTINCT recipe_id) AS n_branches FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL GROUP BY 1, 2")
def edge_dedup(spark, d):
    edges = fuse.next_edges(b.fused(spark, d))
    once = fuse.unique_edges(edges.withColumns({"edge_type": F.lit("REQUIRES"), "seq": F.lit(0).cast("long")}))
    return once.select("from_id", "to_id", "recipe_id").join(edges.groupBy("from_id", "to_id").agg(F.count_distinct("recipe_id").alias("n_branches")), ["from_id", "to_id"])


@query(WITH_ACTIONS + "SELECT DISTINCT name, node_id, kind FROM (SELECT node_id, unnest(['egg', CASE WHEN k > 5 THEN 'bolt' ELSE 'gear' END]) AS name, 'INGREDIENT_OF' AS kind FROM fp UNION ALL SELECT node_id, 'plate', 'USES_TOOL' FROM fp)")
def dimension_edges(spark, d):
    ing, tools, edges = fuse.dimension_edges(fuse.nodes(b.fused(spark, d)))
    named = edges.filter("edge_type = 'INGREDIENT_OF'").join(ing, F.col("from_id") == F.col("id")).select("name", F.col("to_id").alias("node_id"), F.col("edge_type").alias("kind"))
    return named.union(edges.filter("edge_type = 'USES_TOOL'").join(tools, F.col("to_id") == F.col("id")).select("name", F.col("from_id").alias("node_id"), F.col("edge_type").alias("kind")))


@query(WITH_ACTIONS + "SELECT DISTINCT node_id AS from_id, 'bound_' || x AS to_id FROM fp, (VALUES ('onset'), ('full')) t(x)")
def bound_edges(spark, d):
    rows = b.fused(spark, d).dropDuplicates(["node_id"]).withColumn("thermal", F.lit(True)).drop("seq")
    return fuse.bound_edges(fuse.bounds_of(rows, b.DIMS.bounds_df(spark), b.DIMS.default_entity)).select("from_id", "to_id")


@query("""SELECT b AS component, k AS representative FROM (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, length(p_name), printf('%08d', p_partkey)) AS r FROM part) WHERE r = 1""")
def representative(spark, d):
    rows = b.table(spark, d, "part").select(F.format_string("%08d", "p_partkey").alias("node_id"), F.col("p_size").alias("n_recipes"), F.col("p_name").alias("action_phrase"), "p_brand")
    found = merge.representatives(rows, rows.select(F.col("node_id").alias("node"), F.col("p_brand").alias("component")))
    return found.select("component", F.col("representative").cast("long").alias("representative"))


# Windows


@query(r"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS sec, lag(event_type) OVER w AS before, lag(epoch_us(ts) / 1e6) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN before = event_type THEN 0 ELSE 1 END AS new, least(greatest(sec - last, 0), 120) AS gap FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS spell FROM s)
SELECT event_id, round(sum(CASE WHEN new = 1 THEN 0 ELSE gap END) OVER (PARTITION BY user_id, spell ORDER BY sec, event_id), 3) AS active FROM g""")
def work_timer(spark, d):
    rows = b.events(spark, d).withColumn("at", F.col("us") / F.lit(1e6))
    return review.work_time(rows, ["recipe_id"], "event_type", "at", 120.0, ["event_id"]).select("event_id", F.round("active", 3).alias("active"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = turn + 1 + CASE WHEN turn >= conv_id % 5 THEN 1 ELSE 0 END")
def contiguous_prefix(spark, d):
    gap = F.when(F.col("turn") >= F.col("conv_id") % 5, 1).otherwise(0)  # a sub-step is missing there
    rows = b.table(spark, d, "conversations").select("conv_id", "turn", F.lit("r").alias("recipe_id"), F.col("conv_id").alias("step_number"), (F.col("turn") + 1 + gap).alias("sub_step"))
    return readers.contiguous(rows).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'assistant', turn) AS r FROM conversations) WHERE r = 1")
def first_kept(spark, d):
    rows = b.table(spark, d, "conversations").select(F.lit("r").alias("recipe_id"), F.col("conv_id").alias("step_number"), (F.col("turn") + 1).alias("sub_step"), F.when(F.col("role") == "assistant", "kept").otherwise("dropped").alias("status"), F.col("role").alias("reason"), F.col("turn").alias("expected"))
    return review.auto_steps(rows).select(F.col("step_number").alias("conv_id"), F.col("auto").alias("turn"), F.col("reason").alias("role"))


@query("SELECT conv_id, turn, role, lag(role) OVER w AS last_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def positions(spark, d):
    rows = fuse.with_seq(b.table(spark, d, "conversations").select(F.format_string("%012d", "conv_id").alias("recipe_id"), F.col("turn").alias("step_number"), F.lit(1).alias("sub_step"), "conv_id", "turn", "role"))
    last = fuse.neighbours(rows, ["role"], before=True).withColumn("last_role", F.col("_near.role")).drop("_near")
    return fuse.neighbours(last, ["role"]).select("conv_id", "turn", "role", "last_role", F.col("_near.role").alias("next_role"))


# Scope and goal


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'marked' WHEN noun IN ('gizmo', 'anvil') OR adjective = 'blue' THEN 'named' WHEN noun IN ('gizmo', 'anvil', 'widget') THEN CASE WHEN noun = 'widget' THEN 'named' END WHEN p_size % 3 = 0 AND noun NOT IN ('ring', 'plate') THEN 'no change' WHEN p_size % 3 = 0 THEN 'no change' END AS why FROM (
  SELECT *, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun FROM part)""")
def scope_drop_cascade(spark, d):
    p = b.part_names(spark, d)
    state = lambda label: F.array(F.struct(F.col("noun").alias("entity_id"), F.lit(label).alias("physics_state"), F.lit(label).alias("k2_label"))).cast(nested.CONDITIONS)
    rows = p.select("p_partkey", F.lit("r").alias("recipe_id"), F.col("p_partkey").alias("step_number"), F.lit(1).alias("sub_step"), F.lit("Process").alias("node_type"), F.col("p_name").alias("action_phrase"), state("liquid").alias("pre"), F.when(F.col("p_size") % 3 == 0, F.array().cast(nested.CONDITIONS)).otherwise(state("solid")).alias("post"), F.array().cast("array<string>").alias("ingredients"), F.array().cast("array<string>").alias("tools"), (F.col("p_size") % 10 != 0).alias("in_scope"))
    reason = F.col("reason")
    why = F.when(reason.startswith("generator"), "marked").when(reason.startswith("action_phrase"), "named").when(reason.startswith("no inventory"), "nothing").when(reason.startswith("Process"), "no change")
    return scope.apply_scope(rows, b.DIMS).select("p_partkey", why.alias("why"))


@query(WITH_ACTIONS + """, g AS (SELECT recipe_id, bool_or(node_type = 'Plate' AND k < 3) AS plate, arg_max(post_label, step_number) AS last_state, max(step_number) AS last FROM act GROUP BY 1)
SELECT recipe_id, last_state, last + 1 AS step_number, last_state IN ('coagulating', 'solid') AS added FROM g WHERE NOT plate""")
def goal_completion(spark, d):
    rows = b.actions(spark, d).withColumns({"node_type": F.when((F.col("node_type") == "Plate") & (F.col("k") >= 3), "Process").otherwise(F.col("node_type")), "post": nested.resolve_conditions(F.col("post"), nested.literal_map(b.ALIASES))})
    return scope.complete_to_goal(rows, b.DIMS)[1]


# Graph


@query("""WITH RECURSIVE e AS (SELECT a, b FROM (SELECT p_partkey AS a, lag(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def components(spark, d):
    """Chains of parts of a brand and type."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    return graph.components(b.table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.lag("p_partkey").over(w).alias("b")).filter("b is not null"))


@query(WITH_ACTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + """, x AS (SELECT recipe_id || ':' || (step_number // 6) AS scope, step_number, event_type AS f FROM ev),
e AS (SELECT DISTINCT scope, f, t FROM (SELECT scope, f, lead(f) OVER (PARTITION BY scope ORDER BY step_number) AS t FROM x) WHERE t IS NOT NULL),
r(scope, a, z) AS (SELECT scope, f, t FROM e UNION SELECT r.scope, r.a, e.t FROM r JOIN e ON e.scope = r.scope AND e.f = r.z)
SELECT DISTINCT scope FROM r WHERE a = z""")
def cycle_scopes(spark, d):
    """Runs of six events of a branch in which a kind comes back."""
    rows = b.events(spark, d).withColumn("scope", F.concat("recipe_id", F.lit(":"), F.floor(F.col("step_number") / 6).cast("string")))
    w = Window.partitionBy("scope").orderBy("step_number")
    edges = rows.select("scope", F.col("event_type").alias("from_id"), F.lead("event_type").over(w).alias("to_id")).filter("to_id is not null")
    return graph.cyclic_scopes(edges).select("scope")


@query(WITH_ACTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT DISTINCT recipe_id AS scope, f, t FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL),
r(scope, a, z) AS (SELECT scope, f, t FROM e UNION SELECT r.scope, r.a, e.t FROM r JOIN e ON e.scope = r.scope AND e.f = r.z)
SELECT DISTINCT scope AS subject, 2::BIGINT AS gate FROM r WHERE a = z""")
def gate2(spark, d):
    """Whole branches whose order holds a cycle, by the gate, which names up to three cycles of each."""
    return gates.gate2(fuse.next_edges(b.fused(spark, d))).select("subject", "gate").distinct()


@query()
def break_cycles(spark, d):
    """Removed edges of all branches' order."""
    edges = fuse.next_edges(b.fused(spark, d)).unionByName(_required(spark, d))
    return graph.break_cycles(edges)[1].select("edge_type", "recipe_id", "from_id", "to_id")


def merge_inputs(spark, d):
    """(nodes, edges, labels): all branches with NEXT and REQUIRES edges, cycles broken; all steps of a block are labelled
    the same, in every block."""
    rows = b.fused(spark, d)
    nodes = graph.cut(fuse.nodes(rows))
    edges = graph.break_cycles(fuse.next_edges(rows).unionByName(_required(spark, d)))[0]
    pairs = merge.candidate_pairs(merge.with_block(nodes))
    return nodes, graph.cut(edges), pairs.select(tx.pair_id(F.col("a"), F.col("b")).alias("pair_id"), F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.lit("same").alias("label"))


@query()
def apply_merges(spark, d):
    """The order of all branches after merging the steps of every block, as far as no cycle comes of it."""
    return merge.apply_merges(*merge_inputs(spark, d))[1].select("edge_type", "recipe_id", "from_id", "to_id")


@query(WITH_ACTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT DISTINCT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp),
e AS (SELECT * FROM n WHERE t IS NOT NULL), st AS (SELECT recipe_id, node_id FROM fp WHERE step_number = 1),
w(recipe_id, node) AS (SELECT recipe_id, node_id FROM st UNION SELECT e.recipe_id, e.t FROM w JOIN e ON e.recipe_id = w.recipe_id AND e.f = w.node)
SELECT recipe_id, node FROM w""")
def branch_walk(spark, d):
    rows = b.fused(spark, d)
    starts = rows.filter("step_number = 1").select("recipe_id", F.col("node_id").alias("node"))
    return graph.walk(fuse.next_edges(rows), starts).select("recipe_id", "node")


@query(WITH_ACTIONS + _REQUIRED_SQL + """, nx AS (SELECT DISTINCT recipe_id, f, t FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL),
br AS (SELECT recipe_id, f AS n FROM nx UNION SELECT recipe_id, t FROM nx)
SELECT scope, count(*) AS n FROM (SELECT recipe_id AS scope FROM nx UNION ALL SELECT '*requires*' FROM req UNION ALL SELECT a.recipe_id FROM req JOIN br a ON a.n = req.from_id JOIN br b ON b.n = req.to_id AND b.recipe_id = a.recipe_id) GROUP BY scope""")
def order_scopes(spark, d):
    edges = fuse.next_edges(b.fused(spark, d)).unionByName(_required(spark, d))
    return graph.order_scopes(edges).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query(WITH_ACTIONS + """, a AS (SELECT DISTINCT node_id FROM fp WHERE value < 60), f AS (SELECT DISTINCT node_id FROM fp WHERE value > 40)
SELECT (SELECT count(*) FROM a JOIN f USING (node_id)) AS kept, (SELECT count(*) FROM a ANTI JOIN f USING (node_id)) AS removed, (SELECT count(*) FROM f ANTI JOIN a USING (node_id)) AS added""")
def graph_diff(spark, d):
    rows = b.fused(spark, d)
    return metrics.graph_diff(rows.filter("value < 60"), rows.filter("value > 40")).select("kept", "removed", "added")


@query(WITH_ACTIONS + "SELECT f AS node_id, string_agg(DISTINCT t, '|' ORDER BY t) AS next_ids FROM (SELECT node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL GROUP BY 1")
def union_next(spark, d):
    edges = fuse.next_edges(b.fused(spark, d))
    return query_api.GraphQuery(spark.createDataFrame([], "node_id string"), edges).followers().select("node_id", F.array_join("next_ids", "|").alias("next_ids"))


@query(WITH_ACTIONS + """, nx AS (SELECT DISTINCT recipe_id, f, t FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL),
br AS (SELECT recipe_id, f AS n FROM nx UNION SELECT recipe_id, t FROM nx),
ph AS (SELECT node_id AS n, arg_min(action_phrase, (recipe_id, step_number)) AS p, arg_min(post_label, (recipe_id, step_number)) AS post FROM fp GROUP BY 1)
SELECT br.recipe_id, br.n AS node_id, any_value(p) AS action_phrase, any_value(post) AS post_label, coalesce(string_agg(t, '|' ORDER BY t), '') AS next_ids, CASE WHEN any_value(p) LIKE 'view%' THEN 'full|onset' ELSE '' END AS bounds
FROM br JOIN ph USING (n) LEFT JOIN nx ON nx.recipe_id = br.recipe_id AND nx.f = br.n GROUP BY 1, 2""")
def step_context(spark, d):
    rows = b.fused(spark, d)
    nodes = fuse.nodes(rows)
    found = fuse.bounds_of(nodes.drop("seq").withColumn("thermal", F.col("action_phrase").startswith("view")), b.DIMS.bounds_df(spark), "egg")
    q = query_api.GraphQuery(nodes, fuse.next_edges(rows).unionByName(fuse.bound_edges(found)))
    return q.contexts().select("recipe_id", "node_id", "action_phrase", F.get("post", F.lit(0))["k2_label"].alias("post_label"), F.array_join("next_ids", "|").alias("next_ids"), F.array_join("bounds", "|").alias("bounds"))


# Gates


@query(WITH_ACTIONS + "SELECT DISTINCT node_id AS subject, 'Process has no ' || s AS message FROM fp, (VALUES ('pre_conditions'), ('post_conditions')) t(s) WHERE node_type = 'Process' AND (s = 'pre_conditions' OR post_label = 'solid')")
def gate3(spark, d):
    none = F.array().cast(nested.CONDITIONS)
    nodes = b.fused(spark, d).dropDuplicates(["node_id"]).withColumns({"post": F.when(F.get("post", F.lit(0))["k2_label"] == "solid", none).otherwise(F.col("post")), "pre": none})
    return gates.gate3(nodes).select("subject", "message")


@query(WITH_ACTIONS + """SELECT DISTINCT node_id AS subject, CASE WHEN pre_label = 'solid' THEN 'thermal Process has no safety bounds' ELSE 'thermal Process has safety bounds but no edge to one' END AS message FROM fp
WHERE node_type = 'Process' AND canonical_action LIKE 'view%' AND (pre_label = 'solid' OR post_label = 'solid')""")
def gate4(spark, d):
    rows = b.fused(spark, d).dropDuplicates(["node_id"]).withColumn("action_phrase", F.regexp_replace("action_phrase", "^view", "cook"))
    before, after = F.get("pre", F.lit(0))["k2_label"], F.get("post", F.lit(0))["k2_label"]
    nodes = rows.withColumn("safety_bounds", F.when(before == "solid", F.array().cast("array<string>")).otherwise(F.array(F.lit("onset"))))
    edges = fuse.as_edges(nodes.filter(after != "solid").select(F.col("node_id").alias("from_id"), F.lit("bound_onset").alias("to_id"), F.lit("HAS_SAFETY_BOUND").alias("edge_type")))
    return gates.gate4(nodes, edges).select("subject", "message")


@query(WITH_ACTIONS + "SELECT DISTINCT node_id AS subject, 'invalid label: ' || upper(post_label) AS message FROM fp WHERE post_label = 'solid'")
def gate5(spark, d):
    nodes = b.fused(spark, d).dropDuplicates(["node_id"])
    upper = F.transform("post", lambda c: c.withField("k2_label", F.when(c["k2_label"] == "solid", F.upper(c["k2_label"])).otherwise(c["k2_label"])))
    return gates.gate5(nodes.withColumn("post", upper)).select("subject", "message")


@query("SELECT conv_id, turn FROM conversations JOIN (SELECT conv_id, text AS first FROM conversations WHERE turn = 0) USING (conv_id) WHERE NOT contains(text, split_part(first, ' ', 1))")
def gate6(spark, d):
    c = b.table(spark, d, "conversations").withColumns({"recipe_id": F.col("conv_id").cast("string"), "step_number": F.col("turn").cast("int")})
    first = c.filter("turn = 0").select("recipe_id", F.substring_index("text", " ", 1).alias("source_span"))
    rows = c.select("recipe_id", "step_number").join(first, "recipe_id").withColumn("node_id", F.concat_ws("/", "recipe_id", F.col("step_number").cast("string")))
    at = F.split("subject", "/")
    return gates.gate6(rows, c.select("recipe_id", "step_number", "text")).select(F.get(at, F.lit(0)).cast("long").alias("conv_id"), F.get(at, F.lit(1)).cast("long").alias("turn"))


@query("""WITH p AS (SELECT printf('%08d', p_partkey) AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n, p_size FROM part),
m AS (SELECT DISTINCT n FROM p)
SELECT k AS subject, 'uses' AS kind FROM p WHERE n NOT IN ('bolt', 'gear', 'rod', 'plate', 'ring')
UNION ALL SELECT k, 'names' FROM p WHERE n IN ('gizmo', 'anvil') OR a = 'blue'
UNION ALL SELECT k, 'excluded' FROM p WHERE p_size % 50 IN (7, 9)
UNION ALL SELECT n, 'ingredient' FROM m WHERE n NOT IN ('bolt', 'gear', 'rod') UNION ALL SELECT n, 'tool' FROM m WHERE n NOT IN ('plate', 'ring')""")
def gate7(spark, d):
    p = b.part_names(spark, d).withColumn("node_id", F.format_string("%08d", "p_partkey"))
    state = F.array(F.struct(F.col("noun").alias("entity_id"), F.lit("new").alias("physics_state"), F.lit("liquid").alias("k2_label"))).cast(nested.CONDITIONS)
    nodes = p.select("node_id", F.col("p_name").alias("action_phrase"), state.alias("pre"), F.array().cast(nested.CONDITIONS).alias("post"), F.array().cast("array<string>").alias("ingredients"), F.array().cast("array<string>").alias("tools"))
    seen = p.select("node_id", F.concat(F.lit("u"), (F.col("p_size") % 50).cast("string")).alias("recipe_id"))
    named = p.select(F.concat(F.lit("x_"), "noun").alias("id"), F.col("noun").alias("name")).distinct()
    kind = F.when(F.col("message").startswith("uses"), "uses").when(F.col("message").startswith("action"), "names").when(F.col("message").startswith("ingredient"), "ingredient").when(F.col("message").startswith("tool"), "tool").otherwise("excluded")
    return gates.gate7(nodes, seen, named, named, b.DIMS).select("subject", kind.alias("kind"))


@query("SELECT printf('%08d', p_partkey) AS key, c AS check FROM part, (VALUES ('size'), ('price')) t(c) WHERE (c = 'size' AND p_size < 10) OR (c = 'price' AND p_retailprice > 1000)")
def check_violations(spark, d):
    rows = b.table(spark, d, "part").withColumn("key", F.format_string("%08d", "p_partkey"))
    return schema.violations(rows, {"size": F.col("p_size") < 10, "price": F.col("p_retailprice") > 1000}, ["key"])


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def not_unique(spark, d):
    return schema.not_unique(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# Metrics


@query(WITH_ACTIONS + "SELECT count(*) AS verdicts, count(*) FILTER (WHERE k NOT IN (8, 9)) AS accept, count(*) FILTER (WHERE k = 8) AS revise, count(*) FILTER (WHERE k = 9) AS reject FROM act")
def verdict_histogram(spark, d):
    return metrics.verdict_histogram(b.actions(spark, d).withColumn("pass", F.lit(1))).select("verdicts", "accept", "revise", "reject")


_REVIEW_SQL = "WITH r AS (SELECT l.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN 'from_scratch' ELSE 'corrected' END AS mode, quality, toxic, coalesce(n_chars >= 400, false) AS auto, quality = 1 AS gold, source, CASE WHEN l.doc_id % 5 <> 0 THEN (l.doc_id % 97)::DOUBLE END AS s FROM labels l LEFT JOIN documents d USING (doc_id)) "


def _compared(spark, d):
    """Reviews in the shape of compared steps."""
    r = b.reviews(spark, d)
    auto, gold = F.coalesce(F.col("auto") == 1, F.lit(False)), F.col("quality") == 1
    changed = F.array_compact(F.array(F.when(F.col("toxic") == 1, "tools"), F.when(F.col("source") > "src5", "node_type"), F.when(F.col("doc_id") % 4 == 0, "action_phrase")))
    rows = r.withColumns({"auto_in_scope": auto, "gold_in_scope": gold, "scope_agrees": auto == gold})
    rows = rows.withColumn("fields_changed", F.when(F.col("auto_in_scope") & F.col("gold_in_scope"), changed).otherwise(F.array().cast("array<string>")))
    one = lambda c: F.when(F.col("auto_in_scope") & F.col("gold_in_scope"), c.cast("int"))
    sides = {f"{s}_{k}": one(v) for s in ("pre_conditions", "post_conditions") for k, v in (("tp", F.col("doc_id") % 3), ("fp", F.col("doc_id") % 2), ("fn", F.col("doc_id") % 5))}
    neither = ~F.col("auto_in_scope") & ~F.col("gold_in_scope")
    both = F.col("auto_in_scope") & F.col("gold_in_scope")
    return rows.withColumns({**sides, "unchanged": (both & (F.size("fields_changed") == 0)) | neither, "unchanged_ignoring_wording": (both & (F.size(F.array_remove("fields_changed", "action_phrase")) == 0)) | neither})


_CHANGED = {"tools": "toxic = 1", "node_type": "source > 'src5'", "action_phrase": "doc_id % 4 = 0"}
_KEPT = "count(*) FILTER (WHERE auto AND gold)"


@query(_REVIEW_SQL + """SELECT mode, count(*) AS steps, round(100.0::DOUBLE * count(*) FILTER (WHERE auto = gold) / count(*), 1) AS scope_agreement_pct, count(*) FILTER (WHERE auto AND NOT gold) AS wrongly_kept, count(*) FILTER (WHERE NOT auto AND gold) AS wrongly_dropped,
""" + _KEPT + " AS steps_kept_by_both, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (WHERE auto AND gold AND NOT coalesce({c}, false)) / {_KEPT}, 1) AS {f}_pct" for f, c in _CHANGED.items()) + """,
round(100.0::DOUBLE * count(*) FILTER (WHERE (auto AND gold AND NOT toxic = 1 AND NOT coalesce(source > 'src5', false)) OR (NOT auto AND NOT gold)) / count(*), 1) AS unchanged_ignoring_wording_pct,
round(sum(doc_id % 3) FILTER (WHERE auto AND gold) / sum(doc_id % 3 + doc_id % 2) FILTER (WHERE auto AND gold)::DOUBLE, 3) AS pre_conditions_precision,
round(sum(doc_id % 3) FILTER (WHERE auto AND gold) / sum(doc_id % 3 + doc_id % 5) FILTER (WHERE auto AND gold)::DOUBLE, 3) AS pre_conditions_recall FROM r GROUP BY GROUPING SETS ((mode), ())""")
def accuracy_grouping_sets(spark, d):
    return metrics.accuracy(_compared(spark, d)).select("mode", "steps", "scope_agreement_pct", "wrongly_kept", "wrongly_dropped", "steps_kept_by_both", *[f"{f}_pct" for f in _CHANGED], "unchanged_ignoring_wording_pct", "pre_conditions_precision", "pre_conditions_recall")


@query(_REVIEW_SQL + """, b AS (SELECT mode, sum(doc_id % 3) AS tp, sum(doc_id % 2) AS fp, sum(doc_id % 5) AS fn FROM r WHERE auto AND gold GROUP BY mode),
p AS (SELECT mode, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM b)
SELECT mode, round(p, 3) AS precision, round(r, 3) AS recall, round(2 * p * r / (p + r), 3) AS f1 FROM p""")
def prf_micro(spark, d):
    out = metrics.accuracy(_compared(spark, d)).filter("mode is not null")
    return out.select("mode", *[F.col(f"pre_conditions_{k}").alias(k) for k in ("precision", "recall", "f1")])


@query(_REVIEW_SQL + """, f AS (SELECT doc_id, unnest(list_filter([CASE WHEN toxic = 1 THEN 'tools' END, CASE WHEN source > 'src5' THEN 'node_type' END, CASE WHEN doc_id % 4 = 0 THEN 'action_phrase' END], lambda x: x IS NOT NULL)) AS field FROM r WHERE auto AND gold)
SELECT field, count(*) AS edits FROM f GROUP BY field""")
def edits_by_field(spark, d):
    return metrics.edits_by_field(_compared(spark, d))


@query(_REVIEW_SQL + """SELECT (count(*) FILTER (WHERE auto AND gold AND toxic = 1) + count(*) FILTER (WHERE auto AND gold AND source > 'src5') + count(*) FILTER (WHERE auto AND gold AND doc_id % 4 = 0) + count(*) FILTER (WHERE auto <> gold))::BIGINT AS total_edits, count(*) FILTER (WHERE auto <> gold) AS scope_fixes,
count(*) FILTER (WHERE auto AND gold AND toxic = 1) AS tools FROM r""")
def effort(spark, d):
    return metrics.effort(_compared(spark, d)).select("total_edits", "scope_fixes", "tools")


@query(_REVIEW_SQL + "SELECT mode, count(*) AS steps, count(s) AS steps_timed, sum(s)::BIGINT AS total_seconds, median(s) AS median_seconds FROM r GROUP BY mode")
def time_stats(spark, d):
    rows = b.reviews(spark, d)
    stats = metrics.time_stats(rows).select("mode", "steps", "steps_timed", F.col("median_seconds_per_step").alias("median_seconds"))
    return stats.join(rows.groupBy("mode").agg(F.sum("seconds_spent").cast("long").alias("total_seconds")), "mode")


@query(_REVIEW_SQL + """, f AS (SELECT *, auto AND gold AS kept, auto AND gold AND source > 'src5' AS off FROM r)
SELECT count(*) FILTER (WHERE kept AND NOT off) AS tp, count(*) FILTER (WHERE off) AS fp, (count(*) FILTER (WHERE off) + count(*) FILTER (WHERE NOT auto AND gold))::BIGINT AS fn FROM f""")
def gold_comparison(spark, d):
    return metrics.gold_comparison(_compared(spark, d)).select("tp", "fp", "fn")


@query(_REVIEW_SQL + """, t AS (SELECT round(avg(s) FILTER (WHERE mode = 'corrected'), 1) AS c, round(avg(s) FILTER (WHERE mode = 'from_scratch'), 1) AS s FROM r)
SELECT round(s - c, 1) AS seconds_saved_per_step FROM t""")
def savings(spark, d):
    return metrics.savings(metrics.time_stats(b.reviews(spark, d)), 100).select("seconds_saved_per_step")


@query("SELECT count(*) AS steps_in_queue, count(l.doc_id) FILTER (WHERE l.doc_id % 7 <> 0) AS steps_reviewed, count(l.doc_id) FILTER (WHERE l.doc_id % 7 = 0) AS gold_files_out_of_date FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark, d):
    at = {"recipe_id": F.lit("r"), "step_number": F.col("doc_id")}
    queue = b.table(spark, d, "documents").withColumns(at).select("recipe_id", "step_number")
    gold = b.table(spark, d, "labels").withColumns({**at, "definition_version": F.when(F.col("doc_id") % 7 == 0, "1").otherwise("2"), "seeded_from_run": F.lit("")}).select("recipe_id", "step_number", "definition_version", "seeded_from_run")
    return metrics.coverage(queue, gold, "2", "run").select("steps_in_queue", "steps_reviewed", "gold_files_out_of_date")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS steps_checked, count(*) FILTER (WHERE o_custkey % 3 > 1) AS steps_split_by_reviewer, sum(o_custkey % 3)::BIGINT AS actions_reviewer, count(*) FILTER (WHERE o_custkey % 3 > 0 AND o_orderkey % 3 > 0) AS steps_kept_by_both FROM orders")
def split_metrics(spark, d):
    rows = b.table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("split_checked"), (F.col("o_custkey") % 3).alias("gold_actions"), (F.col("o_orderkey") % 3).alias("auto_actions"), F.lit(1.0).alias("split_seconds_spent")).withColumn("split_agrees", F.col("gold_actions") == F.col("auto_actions"))
    return metrics.split_metrics(rows).select("steps_checked", "steps_split_by_reviewer", "actions_reviewer", "steps_kept_by_both")


@query(WITH_ACTIONS + _MAP_SQL + "SELECT (SELECT count(DISTINCT node_id) FROM fp) AS nodes, (SELECT count(*) FROM (SELECT node_id FROM fp GROUP BY 1 HAVING count(DISTINCT recipe_id) > 1)) AS shared, (SELECT count(*) FROM nx WHERE t IS NOT NULL) AS next_edges")
def graph_summary(spark, d):
    rows = b.fused(spark, d)
    return metrics.graph_summary(fuse.nodes(rows), fuse.next_edges(rows))


# Verification


@query("SELECT o_orderkey, o_orderkey % 10 >= 8 AND o_custkey % 10 >= 8 AND o_orderstatus <> 'F' AS accepted FROM orders")
def gate_acceptance(spark, d):
    score = lambda c: (F.col(c) % 10) / F.lit(10.0)
    pairs = [(verify.QUESTIONS[0], score("o_orderkey")), ("verdict_accept", score("o_custkey"))] + [(q, F.lit(0.9)) for q in verify.QUESTIONS[1:]]
    scores = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    choice = F.when(F.col("o_orderstatus") == "F", "revise").otherwise("accept")
    return b.table(spark, d, "orders").select("o_orderkey", verify.gate_accepts(scores, choice, 0.8).alias("accepted"))


@query(WITH_ACTIONS + "SELECT recipe_id, CAST(step_number // 3 AS BIGINT) AS step_number, string_agg('fix ' || step_number, ' / ' ORDER BY step_number) AS hint FROM act WHERE k = 8 GROUP BY 1, 2")
def revision_hints(spark, d):
    rows = b.actions(spark, d).select("recipe_id", F.floor(F.col("step_number") / 3).cast("int").alias("step_number"), F.col("step_number").alias("sub_step"), "verdict", F.concat(F.lit("fix "), F.col("step_number").cast("string")).alias("revision_instructions"), F.array().cast("array<string>").alias("issues"))
    return verify.steps_to_revise(rows)


# Review


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS annotator, (CASE WHEN doc_id % 4 = 0 THEN 7.0 + CASE WHEN doc_id % 3 = 0 THEN 10.0 ELSE 0 END ELSE 10.0 END)::DOUBLE AS seconds FROM labels""")
def review_upsert(spark, d):
    version = F.when(F.col("doc_id") % 3 == 0, "2").otherwise("1")
    base = b.table(spark, d, "labels").select(F.lit("r").alias("recipe_id"), F.col("doc_id").cast("int").alias("step_number"), "doc_id", version.alias("definition_version"))
    expected = schema._EXPECTED
    gold = base.select("recipe_id", "step_number", F.lit(None).cast(expected).alias("expected"), F.array().cast(f"array<{expected}>").alias("sub_steps"), F.lit(False).alias("split_checked"), F.lit(None).cast("double").alias("split_seconds_spent"), F.lit("old").alias("annotator"), F.lit("2020-01-01").alias("annotation_date"), F.lit("").alias("notes"), F.lit("corrected").alias("mode"), F.lit(10.0).alias("seconds_spent"), F.lit("").alias("seeded_from_run"), "definition_version")
    when = lambda s, n, who: base.filter("doc_id % 4 = 0").select("recipe_id", "step_number", F.lit(None).cast(expected).alias("expected"), F.lit(who).alias("annotator"), F.lit("corrected").alias("mode"), F.lit(s).alias("seconds"), F.timestamp_seconds(F.lit(n)).alias("edited_at"), F.lit("").alias("notes"), F.lit("").alias("seeded_from_run"))
    out = review.save_gold(gold, when(-5.0, 100, "first").union(when(7.0, 200, "new")), "2")
    return out.select(F.col("step_number").cast("long").alias("doc_id"), "annotator", F.col("seconds_spent").alias("seconds"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'open' WHEN l.doc_id % 7 = 0 THEN 'outdated' ELSE 'done' END AS status FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY status")
def review_status(spark, d):
    gold = b.table(spark, d, "labels").select("doc_id", F.col("quality").alias("expected"), F.when(F.col("doc_id") % 7 == 0, "1").otherwise("2").alias("definition_version"))
    return b.table(spark, d, "documents").select("doc_id").join(gold, "doc_id", "left").select(review.status("2").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_partkey % 6 = 0 OR p_partkey % 2 = 0 AS stale FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 2 = 0")
def stale_labels(spark, d):
    p = b.table(spark, d, "part")
    nodes = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").cast("string").alias("node_id"))
    labels = p.select(F.col("p_partkey").cast("string").alias("pair_id"), F.col("p_partkey").cast("string").alias("a_id"), F.col("p_partkey").cast("string").alias("b_id"))
    return merge.stale_labels(labels, nodes).select(F.col("pair_id").cast("long").alias("p_partkey"), F.lit(True).alias("stale"))


# Pages and sinks


@query(r"""SELECT page_id, (len(string_split(html, '<li')) - 1)::BIGINT AS n_items, contains(html, '<h1>') AS has_title FROM pages""")
def html_items(spark, d):
    """What the tag parser finds, against counts in the raw page."""
    pages = b.table(spark, d, "pages")
    parsed = html.by_tags(pages)
    raw = pages.select("page_id", (F.size(F.split("html", "<li")) - 1).alias("n_items"))
    return parsed.join(raw, "page_id").select("page_id", "n_items", (F.col("title") != "Unknown Recipe").alias("has_title"))


_LD_SQL = """SELECT nationkey, name, n FROM (SELECT n_nationkey::BIGINT AS nationkey, n_name AS name, (n_nationkey % 4 + 2)::BIGINT AS n FROM nation)"""


@query(_LD_SQL)
def html_linked_data(spark, d):
    """Linked data in the shapes that pages use: alone, in a list, in a graph; steps as texts or objects."""
    n = b.table(spark, d, "nation")
    step = F.concat(F.lit("step number "), F.lit("of some length"))
    texts = F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 4 + 2), lambda i: F.concat(F.lit('"'), step, F.lit(" "), i.cast("string"), F.lit('"')))
    objects = F.transform(texts, lambda t: F.concat(F.lit('{"@type": "HowToStep", "text": '), t, F.lit("}")))
    steps = F.array_join(F.when(F.col("n_nationkey") % 2 == 0, texts).otherwise(objects), ", ")
    recipe = F.concat(F.lit('{"@type": "Recipe", "name": "'), "n_name", F.lit('", "recipeInstructions": ['), steps, F.lit("]}"))
    body = F.when(F.col("n_nationkey") % 3 == 0, recipe).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('[{"@type": "Person"}, '), recipe, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, '), recipe, F.lit("]}")))
    page = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), body, F.lit("</script></html>"))
    parsed = html.parse(n.select(F.col("n_nationkey").alias("page_id"), page.alias("html")))
    return parsed.filter("enough and via = 'linked'").select(F.col("page_id").cast("long").alias("nationkey"), F.col("title").alias("name"), F.size("steps").alias("n"))


def _quoted(c):
    return f"replace({c}, '''', '\\''')"


@query("WITH p AS (SELECT *, 'k' || p_partkey AS id, p_name || '''s' AS phrase FROM part), n AS (SELECT * FROM p WHERE p_partkey % 2 = 0)" + rf"""
SELECT 1::BIGINT AS section, id AS place, 'MERGE (n:Process {{node_id: ''' || id || '''}}) SET n += {{node_id: ''' || id || ''', node_type: ''Process'', action_phrase: ''' || {_quoted('phrase')} || ''', canonical_action: ''' || {_quoted("replace(lower(phrase), ' ', '_')")} || ''', mean_confidence: ' || round(p_size / 4.0::DOUBLE, 4) || ', source_recipe_ids: [''a'', ''b''], variant_phrases: [''x'']}};' AS statement FROM n
UNION ALL SELECT 2, 'ing_' || id, 'MERGE (n:Ingredient {{node_id: ''ing_' || id || '''}}) SET n += {{name: ''' || {_quoted('phrase')} || ''', node_id: ''ing_' || id || '''}};' FROM p
UNION ALL SELECT 3, 'tool_' || id, 'MERGE (n:Tool {{node_id: ''tool_' || id || '''}}) SET n += {{name: ''' || {_quoted('phrase')} || ''', node_id: ''tool_' || id || '''}};' FROM p
UNION ALL SELECT 4, b, 'MERGE (n:SafetyBound {{node_id: ''bound_' || b || '''}}) SET n += {{node_id: ''bound_' || b || ''', bound_id: ''' || b || ''', label: ''' || l || ''', severity: ''' || s || '''' || coalesce(', temperature_c: ' || t, '') || coalesce(', k2_transition: ''' || k || '''', '') || '}};'
  FROM (VALUES {', '.join("(" + ', '.join('NULL' if x is None else f"'{x}'" for x in (r[1], r[2], r[7], r[3], r[5])) + ")" for r in b.DIMS.bounds)}) v(b, l, s, t, k)
UNION ALL SELECT 5, 'NEXT|' || id || '|z' || CASE WHEN p_size > 25 THEN '|r' ELSE '' END, 'MATCH (a {{node_id: ''' || id || '''}}), (b {{node_id: ''z''}}) MERGE (a)-[:NEXT' || CASE WHEN p_size > 25 THEN ' {{source_recipe_id: ''r''}}' ELSE '' END || ']->(b);' FROM n""")
def cypher_rows(spark, d):
    """Statements of every section; half of the parts are nodes."""
    p = b.table(spark, d, "part").withColumns({"id": F.concat(F.lit("k"), F.col("p_partkey").cast("string")), "phrase": F.concat("p_name", F.lit("'s"))})
    nodes = p.filter("p_partkey % 2 = 0").select(F.col("id").alias("node_id"), F.lit("Process").alias("node_type"), F.col("phrase").alias("action_phrase"), tx.canonical_action(F.col("phrase")).alias("canonical_action"), (F.col("p_size") / F.lit(4.0)).alias("mean_confidence"), F.array(F.lit("x"), F.lit("x")).alias("variant_phrases"), "p_size")
    edges = fuse.as_edges(nodes.select(F.col("node_id").alias("from_id"), F.lit("z").alias("to_id"), F.lit("NEXT").alias("edge_type"), F.when(F.col("p_size") > 25, "r").alias("recipe_id")))
    seen = nodes.select("node_id", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("recipe_id"))
    named = lambda prefix: p.select(F.concat(F.lit(prefix), "id").alias("id"), F.col("phrase").alias("name"))
    return sinks.cypher_rows(nodes.drop("p_size"), edges, named("ing_"), named("tool_"), b.DIMS.bounds_df(spark), seen)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 2::BIGINT AS n, 'A ' || n_name AS first FROM nation")
def cypher_statements(spark, d):
    script = F.concat(F.lit("// head;\n// more\nA "), "n_name", F.lit(";\n\n  // between\nB;\n;\n"))
    found = sinks.statements(F.replace(script, F.lit("head;"), F.lit("head")))
    return b.table(spark, d, "nation").select("n_nationkey", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query(_REVIEW_SQL + "SELECT doc_id, CASE WHEN auto AND gold THEN array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'tools' END, CASE WHEN source > 'src5' THEN 'node_type' END, CASE WHEN doc_id % 4 = 0 THEN 'action_phrase' END], lambda x: x IS NOT NULL), ';') ELSE '' END AS fields_changed FROM r")
def step_table(spark, d):
    rows = _compared(spark, d).withColumn("step_number", F.col("doc_id"))
    return sinks.step_table(rows).select(F.col("step_number").alias("doc_id"), "fields_changed")


# More of the graph


@query(WITH_ACTIONS + _MAP_SQL + """, m AS (SELECT rep, fp.* FROM fp JOIN mp ON mp.node = fp.node_id)
SELECT rep AS node_id, count(*) AS n_observations, round(sum(k)::DOUBLE / count(*) / 10, 6) AS mean_confidence, (count(DISTINCT node_id) - 1)::BIGINT AS n_variants, count(DISTINCT CASE WHEN k > 5 THEN 'bolt' ELSE 'gear' END) + 1 AS n_ingredients FROM m GROUP BY rep""")
def contracted_nodes(spark, d):
    """All nodes of a block folded into its least one."""
    out = merge.contract(fuse.nodes(b.fused(spark, d)), _mapping(spark, d))
    return out.select("node_id", "n_observations", F.round("mean_confidence", 6).alias("mean_confidence"), F.size("variant_phrases").alias("n_variants"), F.size("ingredients").alias("n_ingredients"))


@query(WITH_ACTIONS + """SELECT node_id, coalesce(arg_min('b' || k, (recipe_id, step_number)) FILTER (WHERE k > 4), '') AS bounds FROM fp GROUP BY node_id""")
def first_bounds(spark, d):
    """The first safety bounds of a node's observations that aren't empty."""
    bounds = F.when(F.col("k") > 4, F.array(F.concat(F.lit("b"), F.col("k").cast("string")))).otherwise(F.array().cast("array<string>"))
    return fuse.nodes(b.fused(spark, d).withColumn("safety_bounds", bounds)).select("node_id", F.array_join("safety_bounds", "|").alias("bounds"))


@query(WITH_ACTIONS + """, nx AS (SELECT DISTINCT recipe_id, f, t FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL),
p AS (SELECT recipe_id, t AS n, string_agg(f, '|' ORDER BY f) AS previous_ids FROM nx GROUP BY 1, 2), q AS (SELECT recipe_id, f AS n, string_agg(t, '|' ORDER BY t) AS next_ids FROM nx GROUP BY 1, 2)
SELECT recipe_id, n AS node_id, coalesce(previous_ids, '') AS previous_ids, coalesce(next_ids, '') AS next_ids FROM p FULL JOIN q USING (recipe_id, n)""")
def neighbours(spark, d):
    edges = fuse.next_edges(b.fused(spark, d))
    return query_api.GraphQuery(spark.createDataFrame([], "node_id string"), edges).around().select("recipe_id", "node_id", F.array_join("previous_ids", "|").alias("previous_ids"), F.array_join("next_ids", "|").alias("next_ids"))


@query(WITH_ACTIONS + _REQUIRED_SQL + """, nx AS (SELECT DISTINCT recipe_id, f, t FROM (SELECT recipe_id, node_id AS f, lead(node_id) OVER (PARTITION BY recipe_id ORDER BY step_number) AS t FROM fp) WHERE t IS NOT NULL)
SELECT (SELECT count(DISTINCT node_id) FROM fp) AS nodes, (SELECT count(*) FROM nx) + (SELECT count(*) FROM req) AS edges, (SELECT count(*) FROM nx) AS next, (SELECT count(*) FROM req) AS requires, 0::BIGINT AS uses_tool""")
def graph_counts(spark, d):
    rows = b.fused(spark, d)
    return metrics.graph_counts(fuse.nodes(rows), fuse.next_edges(rows).unionByName(_required(spark, d))).select("nodes", "edges", "next", "requires", "uses_tool")


@query(WITH_ACTIONS + "SELECT DISTINCT 'egg:' || post_label AS entity_id FROM fp WHERE post_label <> 'solid'")
def unknown_entities(spark, d):
    """Entities of nodes that no dimension has."""
    nodes = b.fused(spark, d).withColumn("post", F.transform("post", lambda c: c.withField("entity_id", F.concat(c["entity_id"], F.lit(":"), c["k2_label"]))))
    return metrics.non_canonical(nodes, ["egg", "egg:solid"])


@query(WITH_ACTIONS + "SELECT recipe_id, step_number // 3 AS step_number, arg_max(node_id, step_number) AS node_id FROM fp GROUP BY 1, 2")
def nodes_of_steps(spark, d):
    """The node that a step of a branch became, by its last observation."""
    seen = fuse.provenance(b.fused(spark, d)).withColumn("step_number", F.floor(F.col("step_number") / 3).cast("int"))
    return metrics.nodes_of_steps(seen)
