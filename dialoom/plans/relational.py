"""Queries over parts, suppliers, customers, orders and line items, as catalogues, manifests and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import cues, text
from dialoom.functions.scalars import joined, top_distinct
from dialoom.operators import catalogue, evaluation, ranking, verify
from dialoom.plans.registry import query

SURFACES = r"""s AS (SELECT DISTINCT p_partkey AS id, p_partkey AS ord, trim(regexp_replace(translate(lower(trim(x)), '_-', '  '), '[^a-z0-9]+', ' ', 'g')) AS surface
  FROM part, unnest([p_name, p_brand || ' ' || p_name]) u(x))"""


def _surfaces(t):
    return catalogue.surfaces(t("part"), "p_partkey", [F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")], F.col("p_partkey"), text.character_name)


@query(f"WITH {SURFACES} SELECT surface, max(id) AS id FROM s WHERE surface <> '' GROUP BY surface")
def surface_lookup_lastwins(t):
    return catalogue.last_wins(_surfaces(t))


@query(f"WITH {SURFACES} SELECT surface, min(id) AS id FROM s WHERE surface <> '' GROUP BY surface HAVING count(DISTINCT id) = 1")
def surface_lookup_unique(t):
    return catalogue.unique(_surfaces(t))


@query(f"WITH {SURFACES} SELECT surface, count(DISTINCT id) AS owners FROM s WHERE surface <> '' GROUP BY surface HAVING count(DISTINCT id) > 1")
def ambiguous_surfaces(t):
    return catalogue.ambiguous(_surfaces(t))


@query(f"WITH {SURFACES}, u AS (SELECT surface, min(id) AS id FROM s GROUP BY surface) SELECT p_partkey, u.id AS first_of_name FROM part LEFT JOIN u ON u.surface = p_name")
def resolve_names(t):
    first = _surfaces(t).groupBy("surface").agg(F.min("id").alias("id"))
    return catalogue.resolve(t("part").select("p_partkey", "p_name"), first, text.character_name(F.col("p_name")), "first_of_name").drop("p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_clips(t):
    done = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return catalogue.missing(t("customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("""
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def manifest_reconcile(t):
    listed = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return catalogue.reconcile(listed, t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), ["k"])


@query("""
WITH w AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT c_custkey, o_orderpriority AS carried FROM customer LEFT JOIN w ON o_custkey = c_custkey AND r = 1""")
def carry_forward(t):
    history = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return catalogue.carried_forward(t("customer").select("c_custkey"), history, "c_custkey", F.struct("o_orderdate", "o_orderkey"), F.col("o_orderpriority"))


@query("""
WITH a AS (SELECT c_nationkey AS k, min(c_mktsegment) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey + 5 AS k, min(s_name) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.k IS NULL THEN 'new' WHEN a.v IS NULL AND b.v IS NOT NULL THEN 'filled' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def upsert_voices(t):
    """Customers' nations against suppliers', moved on so that some are new."""
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_mktsegment").alias("v"))
    return catalogue.upsert(a, t("supplier").groupBy((F.col("s_nationkey") + 5).alias("k")).agg(F.min("s_name").alias("v")), "k", ["v"])


@query("""
WITH a AS (SELECT c_custkey AS k, min(c_mktsegment) AS v FROM customer GROUP BY 1), b AS (SELECT s_suppkey * 40 AS k, min(s_name) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.k IS NULL THEN 'new' WHEN a.v IS NULL AND b.v IS NOT NULL THEN 'filled' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def upsert_voices_all(t):
    """Whole customers against whole suppliers, whose keys are spread so that some are new."""
    a = t("customer").groupBy(F.col("c_custkey").alias("k")).agg(F.min("c_mktsegment").alias("v"))
    return catalogue.upsert(a, t("supplier").groupBy((F.col("s_suppkey") * 40).alias("k")).agg(F.min("s_name").alias("v")), "k", ["v"])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_type) AS copies FROM part)
SELECT p_brand, p_type, p_partkey, copies FROM r WHERE r = 1""")
def voice_survivor(t):
    kept = catalogue.survivors(t("part"), ["p_brand", "p_type"], [F.desc("p_size"), F.asc("p_partkey")])
    return kept.select("p_brand", "p_type", "p_partkey", "copies")


@query("""
WITH b AS (SELECT lower(trim(CAST(p_size AS VARCHAR))) AS id, p_name AS surface FROM part)
SELECT 'duplicate_id' AS rule, id AS value, count(*) AS n FROM b WHERE id <> '' GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'ambiguous_surface', surface, count(DISTINCT id) FROM b WHERE surface <> '' GROUP BY surface HAVING count(DISTINCT id) > 1""")
def constraint_report(t):
    return catalogue.violations(t("part"), "p_size", F.col("p_name"))


@query("""
WITH b AS (SELECT lower(trim(CAST(p_size AS VARCHAR))) AS id, p_name AS surface FROM part)
SELECT 'duplicate_id' AS rule, id AS value, count(*) AS n FROM b WHERE id <> '' GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'ambiguous_surface', surface, count(DISTINCT id) FROM b WHERE surface <> '' GROUP BY surface HAVING count(DISTINCT id) > 1""")
def constraint_report_all(t):
    """constraint_report over the whole of part."""
    return catalogue.violations(t("part"), "p_size", F.col("p_name"))


@query(r"""
WITH b AS (SELECT lower(trim(CASE WHEN c_custkey % 97 = 0 THEN ' ' WHEN c_custkey % 5 = 0 THEN 'C' || CAST(c_custkey // 10 AS VARCHAR) ELSE 'c' || CAST(c_custkey AS VARCHAR) END)) AS id, c_mktsegment || CAST(c_custkey // 3 AS VARCHAR) AS surface,
  lower(trim(regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END || ':' || CAST(c_custkey % 600 AS VARCHAR), '[:#]+', ' ', 'g'))) AS file FROM customer)
SELECT 'missing_id' AS rule, '' AS value, count(*) AS n FROM b WHERE id IS NULL OR id = '' HAVING count(*) > 0
UNION ALL SELECT 'duplicate_id', id, count(*) FROM b WHERE id <> '' GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'ambiguous_surface', surface, count(DISTINCT id) FROM b WHERE surface <> '' GROUP BY surface HAVING count(DISTINCT id) > 1
UNION ALL SELECT 'file_collision', file, count(DISTINCT id) FROM b WHERE file <> '' GROUP BY file HAVING count(DISTINCT id) > 1""")
def constraint_report_files(t):
    """Customers under ids of which some are missing or repeat, with file names that collide without regard to case."""
    key = F.col("c_custkey")
    id = F.when(key % 97 == 0, " ").when(key % 5 == 0, F.concat(F.lit("C"), F.floor(key / 10).cast("string"))).otherwise(F.concat(F.lit("c"), key.cast("string")))
    segment = F.when(key % 2 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    file = F.trim(F.regexp_replace(F.concat(segment, F.lit(":"), (key % 600).cast("string")), "[:#]+", " "))
    return catalogue.violations(t("customer").withColumn("id", id), "id", F.concat("c_mktsegment", F.floor(key / 3).cast("string")), file)


@query("""
WITH x AS (SELECT p_partkey, lpad(bin(CAST('0x' || substr(sha256('book::v3::' || p_partkey), 1, 10) AS BIGINT)), 40, '0') AS b FROM part)
SELECT p_partkey, list_aggregate(list_transform(range(8), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(b, CAST(5 * k + j + 1 AS BIGINT), 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS BIGINT) + 1, 1)), 'string_agg', '') AS guid FROM x""")
def guid_mint(t):
    return t("part").select("p_partkey", text.guid(F.concat(F.lit("book::v3::"), F.col("p_partkey").cast("string"))).alias("guid"))


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS confidence, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS reasons, min(l_orderkey * 10 + l_linenumber) AS first_place FROM lineitem GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY confidence DESC, first_place, l_suppkey) AS INT) AS rank FROM c""")
def collapse_candidates(t):
    rows = t("lineitem").withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = ranking.collapsed(rows, ["l_partkey"], "l_suppkey", "l_quantity", "l_returnflag", "place").withColumn("reasons", joined(F.col("reasons")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("confidence"), "first_place", "l_suppkey")))


@query("""
WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity / 50 AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS rank, lead(score) OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS next FROM c)
SELECT l_orderkey, l_linenumber, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN greatest(0.0, score - coalesce(next, 0.0)) END AS margin,
  CASE WHEN rank = 1 THEN score < 0.74 OR greatest(0.0, score - coalesce(next, 0.0)) < 0.14 END AS suggestion FROM r""")
def rank_margin(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score")).distinct()
    return ranking.ranked(rows, ["l_orderkey"], "score", "l_linenumber").drop("score")


@query("""
WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber * 100000000 + l_suppkey) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS r FROM f)
SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY p) FILTER (r <= 3) AS top FROM r GROUP BY l_orderkey""")
def topk_distinct(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("a"))
    return rows.select("l_orderkey", joined(top_distinct(F.transform("a", lambda x: x["l_suppkey"]), 3)).alias("top"))


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM orders),
b AS (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1)
SELECT l_orderkey, count(o.o_orderkey) AS orders_by_then FROM b JOIN orders m ON m.o_orderkey = l_orderkey LEFT JOIN orders o ON o.o_custkey = m.o_custkey AND o.o_orderdate <= ship GROUP BY l_orderkey""")
def orders_as_of_shipping(t):
    """How many orders of its customer there were when an order first shipped: an as-of count by one window, without pairs."""
    ship = t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("at"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    asked = ship.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "at", F.lit(1).alias("late"), "l_orderkey", F.lit(0).alias("one"))
    known = orders.select("o_custkey", F.col("o_orderdate").alias("at"), F.lit(0).alias("late"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(1).alias("one"))
    w = Window.partitionBy("o_custkey").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    return asked.unionByName(known).withColumn("orders_by_then", F.sum("one").over(w)).where("l_orderkey IS NOT NULL").select("l_orderkey", "orders_by_then")


@query("""
WITH l AS (SELECT o_orderkey, o_orderstatus <> 'O' AS said, ['4b_tag_continuation', '4_contiguous_dialogue', '5_suggest_alternatives', '2_forward_explicit_tags'][o_custkey % 4 + 1] AS rule,
  o_orderpriority LIKE '%LOW%' AS own, o_orderstatus = 'P' AS suggestion, o_totalprice / 500000 AS conf, (o_custkey % 100) / 100 AS margin, o_orderkey % 7 = 0 AS decoded FROM orders),
r AS (SELECT o_orderkey, said AND rule LIKE '4%' AND NOT own AS carried, said, suggestion, conf, margin, decoded, rule FROM l)
SELECT o_orderkey, concat_ws(',', CASE WHEN carried THEN 'carryover_rule' END, CASE WHEN said AND suggestion THEN 'already_suggestion' END, CASE WHEN said AND conf < 0.74 THEN 'low_confidence' END,
  CASE WHEN said AND margin < 0.14 THEN 'tight_margin' END, CASE WHEN said AND decoded THEN 'episode_decoder' END, CASE WHEN said AND rule LIKE '5%' THEN 'suggestion_string' END) AS reasons,
  CASE WHEN carried THEN 'carryover_rule' ELSE '' END AS carryover_only FROM r""")
def verify_gate(t):
    rule = F.element_at(F.array(*map(F.lit, (*verify.CARRYOVER[:2], verify.SUGGESTED, "2_forward_explicit_tags"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    own = F.when(F.col("o_orderpriority").contains("LOW"), F.array(F.lit("coref_support"))).otherwise(F.array(F.lit("recent_named_mention")))

    def why(gate):
        return joined(verify.gate_reasons(gate, F.col("o_orderstatus") != "O", rule, own, F.col("o_orderstatus") == "P", F.col("o_totalprice") / 500000, (F.col("o_custkey") % 100) / 100, F.col("o_orderkey") % 7 == 0))

    return t("orders").select("o_orderkey", why("full").alias("reasons"), why("carryover").alias("carryover_only"))


@query("""
WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS choice, (o_custkey % 100) / 100 AS conf, o_orderstatus = 'F' AS same FROM orders)
SELECT o_orderkey, CASE WHEN choice IS NULL THEN 'skip' WHEN conf < 0.4 THEN 'note' WHEN same THEN CASE WHEN conf >= 0.7 THEN 'confirm' ELSE 'note' END WHEN conf >= 0.6 THEN 'downgrade' ELSE 'note' END AS verdict FROM a""")
def verdicts(t):
    choice = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t("orders").select("o_orderkey", verify.verdict(choice, (F.col("o_custkey") % 100) / 100, F.col("o_orderstatus") == "F").alias("verdict"))


@query("""
WITH c AS (SELECT l_suppkey, nullif(l_shipmode, '') AS v, count(*) AS n, max(l_suppkey % 50) AS t FROM (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag END AS l_shipmode FROM lineitem) GROUP BY ALL)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS clips, string_agg(v || '=' || n, ',' ORDER BY v) AS voices, arg_min(v, (-n, v)) FILTER (v IS NOT NULL) AS "primary", max(t) AS total,
  CASE WHEN max(t) > 0 THEN sum(n) / max(t) END AS coverage FROM c GROUP BY l_suppkey""")
def voice_stats(t):
    voice = F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_returnflag"))
    found = evaluation.voice_stats(t("lineitem"), ["l_suppkey"], voice, F.col("l_suppkey") % 50)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("voices")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.withColumn("voices", shown)


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders")
def outcome_counts(t):
    return evaluation.outcome_counts(t("orders"), F.col("o_orderstatus"), ["F", "P"])


@query("SELECT count(*) AS reports, count(*) FILTER (p_size > 45) AS flagged, md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (p_size > 45)) AS lines FROM part")
def flagged_summary(t):
    return evaluation.flagged_summary(t("part"), F.col("p_size") > 45, "p_partkey").withColumn("lines", F.md5(joined(F.col("lines"))))


@query("""
WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || 's'), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)
SELECT p_partkey, s || ',the-' || s || ',' || s[:-2] || ',the-' || s[:-2] AS candidates FROM s""")
def id_candidates(t):
    return t("part").select("p_partkey", joined(text.id_candidates(F.concat("p_name", F.lit("s")))).alias("candidates"))


@query("""
WITH w AS (SELECT p_partkey, p_partkey * 37 % 10000 AS n, ['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS o,
  ['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS t FROM part),
h AS (SELECT *, CASE WHEN n % 100 < 20 THEN o[n % 100] WHEN n % 10 = 0 THEN t[n % 100 // 10] ELSE t[n % 100 // 10] || ' ' || o[n % 10] END AS low, o[n // 100 % 10] || ' hundred' AS mid, o[n // 1000] || ' thousand' AS high FROM w)
SELECT p_partkey, 'no. ' || CASE WHEN n = 0 THEN 'zero' ELSE concat(CASE WHEN n >= 1000 THEN high END, CASE WHEN n >= 1000 AND n % 1000 > 0 THEN CASE WHEN n % 1000 < 100 THEN ' and ' ELSE ' ' END END,
  CASE WHEN n % 1000 >= 100 THEN mid END, CASE WHEN n % 1000 >= 100 AND n % 100 > 0 THEN ' and ' END, CASE WHEN n % 100 > 0 THEN low END) END || '!' AS words FROM h""")
def numbers_in_words(t):
    return t("part").select("p_partkey", text.numbers_in_words(F.concat(F.lit("no. "), F.col("p_partkey") * 37 % 10000, F.lit("!"))).alias("words"))


@query("""
WITH d AS (SELECT p_partkey, trim(['The ', 'any ', 'a same ', 'An '][p_partkey % 4 + 1] || p_name, '"''“”‘’.,;:!? ') AS d FROM part), w AS (SELECT *, regexp_extract_all(lower(d), '[a-z]+(?:''[a-z]+)?') AS w FROM d)
SELECT p_partkey, CASE WHEN length(d) <= 80 AND len(w) BETWEEN 2 AND 6 AND w[1] IN ('a', 'an', 'the') AND NOT list_has_any(w[:-2], ['all', 'any', 'each', 'every', 'few', 'other', 'same', 'some']) THEN d END AS descriptor FROM w""")
def descriptors(t):
    lead = F.element_at(F.array(*map(F.lit, ("The ", "any ", "a same ", "An "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", text.descriptor(F.concat(lead, F.col("p_name"))).alias("descriptor"))


@query("SELECT p_partkey, trim(p_name) IN ('-', '--', '---') OR p_partkey % 3 = 0 AS dashes FROM part")
def dash_lines(t):
    return t("part").select("p_partkey", text.dash_only(F.when(F.col("p_partkey") % 3 == 0, " –— ").otherwise(F.col("p_name"))).alias("dashes"))


@query("""
WITH a AS (SELECT p_partkey, trim(p_name) AS n, lower(trim(p_name)) AS l FROM part)
SELECT p_partkey, l = '' OR l IN ('he', 'she', 'the man') OR starts_with(l, 'unknown') AS generic, n = '' OR n IN ('Unassigned', 'Unknown') OR starts_with(n, '[') AS blocked FROM a
WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, true, true FROM a WHERE p_partkey % 5 = 0""")
def label_checks(t):
    name = F.when(F.col("p_partkey") % 5 == 0, "Unknown").otherwise(F.col("p_name"))
    return t("part").select("p_partkey", cues.generic_label(name).alias("generic"), cues.blocked_speaker(name).alias("blocked"))
