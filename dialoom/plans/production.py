"""Queries over plans of speech, times of lines, and predicted against curated speakers; shared tables stand in for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import agreement, planning, timing
from dialoom.plans.registry import query
from dialoom.plans.texts import LINES, paragraphs

BLOCKED = ("narrator", "n3")


@query("""
SELECT count(*) FILTER (d IS NOT NULL AND l IS NOT NULL) AS pairs, count(*) FILTER (l IS NULL) AS left_only, count(*) FILTER (d IS NULL) AS right_only
FROM (SELECT DISTINCT doc_id AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON d = l""")
def chapter_pairs(t):
    return planning.pair_counts(t("documents"), t("labels"), ["doc_id"])


@query("""
SELECT o_orderkey AS chapter, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'R' AND l_linenumber = 6 OR l_linenumber > 4 OR l_tax > 0.07 OR l_suppkey % 9 = 0)) AS has_audio FROM orders""")
def chapters_with_audio(t):
    chapter = F.col("l_orderkey").alias("chapter")
    manifests = t("lineitem").select(chapter, (F.col("l_linenumber") - 4).alias("clips"), F.when(F.col("l_tax") > 0.07, 3).alias("total_clips"), F.expr("l_returnflag = 'R' AND l_linenumber = 6").alias("corrupt"))
    files = t("lineitem").select(chapter, F.when(F.col("l_suppkey") % 9 == 0, "clip.WAV").otherwise("notes.txt").alias("file"))
    return planning.with_audio(t("orders").select(F.col("o_orderkey").alias("chapter")), manifests, files)


def _batches(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_suppkey").alias("character"), F.col("l_quantity").cast("long").alias("chars"))
    voices = t("supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("character"), F.col("s_nationkey").alias("voice"))
    return planning.chapter_batches(lines, voices, 40)


BATCHES = """b AS (SELECT l_orderkey, l_suppkey, s_nationkey AS voice, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS c
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 2000 GROUP BY ALL)"""


@query(f"""
WITH {BATCHES} SELECT l_suppkey AS "character", voice, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(c) AS BIGINT) AS chars, count(DISTINCT l_orderkey) AS chapters, count(*) FILTER (c < 40) AS under_target
FROM b WHERE voice IS NOT NULL GROUP BY ALL""")
def voice_plan(t):
    return planning.character_plan(_batches(t))


@query(f"""
WITH {BATCHES} SELECT l_orderkey AS chapter, count(voice) AS queued_batches, CAST(coalesce(sum(n) FILTER (voice IS NOT NULL), 0) AS BIGINT) AS queued_lines,
  CAST(coalesce(sum(n) FILTER (voice IS NULL), 0) AS BIGINT) AS missing_voice_lines FROM b GROUP BY l_orderkey""")
def voice_chapter_totals(t):
    return planning.chapter_totals(_batches(t))


@query("""
SELECT o_orderpriority AS source, arg_min(o_orderstatus, o_orderkey) AS label, arg_min(o_custkey, o_orderkey) AS "primary", count(*) AS lines, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS chars,
  count(DISTINCT o_custkey) AS characters, count(DISTINCT year(o_orderdate)) AS chapters FROM orders GROUP BY 1""")
def speaker_source_batches(t):
    return planning.source_batches(t("orders").select(
        F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("character"),
        F.year("o_orderdate").alias("chapter"), F.lit(1).cast("long").alias("lines"), F.floor("o_totalprice").alias("chars"),
    ))


@query("""
WITH m AS (SELECT p_partkey, p_name AS who, p_brand FROM part WHERE p_size > 20 AND NOT starts_with(p_name, 'cold')), v AS (SELECT p_brand, p_type FROM part WHERE p_size > 25 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)
SELECT 'id ' || who AS "character", p_type AS voice FROM m JOIN v USING (p_brand) QUALIFY row_number() OVER (PARTITION BY who ORDER BY p_partkey) = 1""")
def voice_assignments(t):
    part = t("part")
    named = part.select(F.col("p_name").alias("name"), F.concat(F.lit("id "), "p_name").alias("character")).distinct()
    manifests = part.select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 20, "2.0").otherwise("1.0").alias("version"), F.col("p_brand").alias("provider_voice"))
    voices = part.where("p_size > 25").select(F.col("p_brand").alias("provider_voice"), F.col("p_type").alias("voice"), F.col("p_partkey").alias("ord"))
    return planning.assignments(manifests, named, voices, named.where("name LIKE 'cold%'"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS speaker, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 1000) GROUP BY o_custkey HAVING count(*) >= 2""")
def speaker_blocklist(t):
    gold = t("customer").where("c_acctbal > 1000").select(F.col("c_custkey").cast("string").alias("speaker"))
    return planning.blocklist(t("orders").select(F.col("o_custkey").cast("string").alias("speaker")), gold)


@query("""
WITH l AS (SELECT o_orderkey, o_orderpriority || '  ' || o_custkey % 10 AS spelling, regexp_replace(lower(replace(o_orderpriority, '-', ' ')), '\\s+', ' ', 'g') || ' ' || o_custkey % 10 AS item FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)), k AS (SELECT * FROM l WHERE item <> '1 urgent 3')
SELECT o_orderkey, item, first(spelling) OVER (PARTITION BY item ORDER BY o_orderkey) AS spelling, min(o_orderkey) OVER (PARTITION BY item) AS first_line, count(*) OVER (PARTITION BY item) AS lines FROM k""")
def closed_world_review(t):
    known = t("customer").where("c_acctbal > 1000").select(F.col("c_custkey").cast("string").alias("key")).unionAll(t("customer").select(F.lit("1 urgent 3")).distinct())
    surface = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("  "), (F.col("o_custkey") % 10).cast("string"))
    found = planning.review_items(t("orders"), known, "o_orderkey", F.col("o_custkey").cast("string"), surface, text.character_name)
    return found.select("o_orderkey", "item", "spelling", "first_line", "lines")


def _timed(t):
    """Per user of events: lines, their matched words, and words with times; some of both lack."""
    w = Window.partitionBy("user_id")
    rows = t("events").withColumns({"line": F.row_number().over(w.orderBy("ts", "event_id")) - 1, "n": F.count("*").over(w).cast("int")})
    lines = rows.select("user_id", "line", F.lit(400.0).alias("duration"))
    matches = rows.where("event_type <> 'error'").select("user_id", "line", (F.col("line") * 7 % F.col("n")).alias("word"))
    more = rows.where("event_type = 'click'").select("user_id", "line", (F.col("line") * 5 % F.col("n")).alias("word"))
    words = rows.select("user_id", F.col("line").alias("word"), F.when(F.col("value") > 20, F.col("value")).alias("start"), F.when(F.col("value") > 30, F.col("value") + 1.5).alias("end"))
    return lines, matches.unionAll(more), words


@query("""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line, count(*) OVER (PARTITION BY user_id) AS n FROM events),
a AS (SELECT user_id, line, n, event_type, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN least(line * 7 % n, line * 5 % n) ELSE line * 7 % n END AS f,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN greatest(line * 7 % n, line * 5 % n) ELSE line * 7 % n END AS g, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 2 ELSE 1 END AS matched FROM r),
w AS (SELECT user_id, line AS word, last_value(CASE WHEN value > 30 THEN value + 1.5 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS done,
  first_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS begun FROM r),
s AS (SELECT a.user_id, a.line, a.n, a.matched, coalesce(f, last_value(g IGNORE NULLS) OVER p, 0) AS first_word, coalesce(g, last_value(g IGNORE NULLS) OVER p, 0) AS last_word FROM a WINDOW p AS (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT s.*, coalesce(u.begun, u.done) AS b, coalesce(v.done, v.begun) AS e FROM s JOIN w u ON u.user_id = s.user_id AND u.word = first_word JOIN w v ON v.user_id = s.user_id AND v.word = last_word),
o AS (SELECT user_id, CAST(-1 AS BIGINT) AS line, 0.0::DOUBLE AS b, 0.0::DOUBLE AS e FROM x GROUP BY user_id
  UNION ALL SELECT x.user_id, x.line, greatest(o.e, least(coalesce(x.b, o.e), 400)), greatest(greatest(o.e, least(coalesce(x.b, o.e), 400)), least(coalesce(x.e, x.b, o.e), 400)) FROM o JOIN x ON x.user_id = o.user_id AND x.line = o.line + 1),
z AS (SELECT o.user_id, o.line, round(o.b, 4) AS start, CASE WHEN o.line = n - 1 AND o.e < 400 THEN 400.0 ELSE round(o.e, 4) END::DOUBLE AS stop, matched, first_word, last_word FROM o JOIN x USING (user_id, line))
SELECT user_id, line, start, stop AS "end", round(stop - start, 4) AS seconds, CAST(matched AS BIGINT) AS matched, CAST(first_word AS INT) AS first_word, CAST(last_word AS INT) AS last_word FROM z""")
def line_times(t):
    lines, matches, words = _timed(t)
    return timing.line_times(lines, matches, words, "user_id", "duration").withColumn("line", F.col("line").cast("long"))


def _silences(t):
    runs = t("events").select("user_id", F.col("event_id").alias("place"), F.col("value").alias("center"), (F.col("event_id") % 7).cast("double").alias("seconds"))
    return runs, t("events").select("user_id", (F.col("user_id") * 3 + 40.5).cast("double").alias("anchor")).distinct()


@query("""
SELECT user_id, round(value, 4) AS boundary FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - (user_id * 3 + 40.5)::DOUBLE), event_id % 7 DESC, event_id) = 1""")
def boundary_near_anchor(t):
    return timing.nearest_boundary(*_silences(t), ["user_id"])


@query("""
WITH v AS (SELECT DISTINCT user_id, round(value, 4) AS p, (user_id * 3 + 40.5)::DOUBLE AS a FROM events),
lo AS (SELECT user_id, p FROM v WHERE p < a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC) <= 2), hi AS (SELECT user_id, p FROM v WHERE p > a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) <= 2)
SELECT user_id, p AS position FROM lo UNION ALL SELECT * FROM hi UNION ALL SELECT DISTINCT user_id, a FROM v""")
def boundary_alternates(t):
    return timing.boundary_candidates(*_silences(t), ["user_id"], 2)


def _positional(t):
    """Lines against the line before them."""
    who = F.when(F.col("role") != "system", F.col("role")).alias("who")
    lines = t("conversations")
    return agreement.positional_pairs(lines.select("conv_id", "turn", who), lines.select("conv_id", (F.col("turn") + 1).alias("turn"), who), ["conv_id", "turn"])


SHIFTED = """p AS (SELECT a.conv_id, CASE a.role WHEN 'system' THEN 'narrator' ELSE a.role END AS g, CASE b.role WHEN 'system' THEN 'narrator' ELSE b.role END AS p FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"""


@query(f"""
WITH {SHIFTED} SELECT conv_id, count(*) AS total, count(*) FILTER (g = p) AS correct, count(*) FILTER (g <> 'narrator') AS dialogue_total, count(*) FILTER (g <> 'narrator' AND g = p) AS dialogue_correct FROM p GROUP BY conv_id""")
def positional_report(t):
    return agreement.positional_report(_positional(t), "conv_id")


@query(f"""
WITH {SHIFTED}, c AS (SELECT unnest(['user', 'assistant']) AS "character")
SELECT "character", count(*) FILTER (g = "character" AND p = g) AS tp, count(*) FILTER (g <> 'narrator' AND p = "character" AND p <> g) AS fp, count(*) FILTER (g = "character" AND p IS DISTINCT FROM g) AS fn FROM c, p GROUP BY 1""")
def positional_characters(t):
    return agreement.positional_characters(_positional(t))


@query("""
WITH l AS (SELECT conv_id, CASE role WHEN 'system' THEN 'narrator' ELSE role END AS g, CASE WHEN length(text) % 2 = 0 THEN 'user' ELSE 'assistant' END AS a, coalesce(lag(nullif(role, 'system')) OVER (PARTITION BY conv_id ORDER BY turn), 'narrator') AS b FROM conversations),
m AS (SELECT conv_id, g, 'parity' AS method, a AS p FROM l UNION ALL SELECT conv_id, g, 'previous', b FROM l)
SELECT conv_id, method, count(*) AS total, count(*) FILTER (g <> 'narrator') AS dialogue_total, count(*) FILTER (g = p) AS correct, count(*) FILTER (g = p AND g <> 'narrator') AS dialogue_correct FROM m GROUP BY ALL""")
def method_report(t):
    who = F.when(F.col("role") != "system", F.col("role"))
    lines = t("conversations").withColumn("before", F.lag(who).over(Window.partitionBy("conv_id").orderBy("turn")))
    parity = F.when(F.length("text") % 2 == 0, "user").otherwise("assistant")
    return agreement.method_report(lines, "conv_id", who, {"parity": parity, "previous": F.col("before")})


@query("""
SELECT v AS verdict, count(o_orderkey) AS n, count(o_orderkey) / (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')) AS share
FROM (SELECT unnest(['F', 'O', 'absent']) AS v) LEFT JOIN orders ON o_orderstatus = v GROUP BY v""")
def audit_verdicts(t):
    return agreement.verdict_counts(t("orders"), F.col("o_orderstatus"), ["F", "O", "absent"])


@query(f"""
WITH {LINES} SELECT doc_id, idx, CAST(1 AS INT) AS start, length(line)::INT AS "end" FROM paragraphs WHERE length(line) > 1 AND idx % 2 = 0 AND idx % 3 > 0""")
def rebased_quotes(t):
    """Spans of every second paragraph stay within it, the others reach over; every third paragraph has changed since."""
    rows = paragraphs(t)
    chapters = rows.withColumn("sha256", F.sha2(F.when(F.col("idx") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")), 256))
    quotes = rows.select("doc_id", (F.col("start") + 1).alias("start"), (F.col("end") + F.col("idx") % 2).cast("int").alias("end"))
    return agreement.rebased(quotes, chapters, "doc_id").select("doc_id", "idx", "start", "end")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[' || p_name || '|' || p_brand || ']' WHEN 1 THEN p_name WHEN 2 THEN p_brand END AS speaker FROM part""")
def cleaned_suggestions(t):
    name, brand = F.col("p_name"), F.col("p_brand")
    given = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("["), name, F.lit("| Narrator||"), brand, F.lit(" |"), F.upper(name), F.lit("]")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("[narrator|"), name, F.lit("]"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit(" "), brand, F.lit(" "))).otherwise("[N3 | narrator]")
    )
    return t("part").select("p_partkey", agreement.cleaned_suggestions(given, BLOCKED).alias("speaker"))


@query("""
WITH m AS (SELECT user_id, event_id % 5 AS cluster, event_id, event_id % 50 AS start, CASE event_id % 6 WHEN 0 THEN 'I' ELSE 'n' || event_id % 4 END AS text, event_type = 'purchase' AS known FROM events),
c AS (SELECT user_id, cluster, text FROM m WHERE known OR text NOT IN ('I', 'n3') QUALIFY row_number() OVER (PARTITION BY user_id, cluster ORDER BY known DESC, CASE WHEN known THEN 0 ELSE -length(text) END, event_id) = 1)
SELECT user_id, start, arg_max(upper(c.text), cluster) AS name FROM m JOIN c USING (user_id, cluster) WHERE lower(c.text) <> 'n3' GROUP BY user_id, start""")
def coref_lookup(t):
    said = F.when(F.col("event_id") % 6 == 0, "I").otherwise(F.concat(F.lit("n"), F.col("event_id") % 4))
    mentions = t("events").select(
        "user_id", (F.col("event_id") % 5).alias("cluster"), F.col("event_id").alias("place"), (F.col("event_id") % 50).alias("start"), said.alias("text"), F.upper(said).alias("name"), (F.col("event_type") == "purchase").alias("known"),
    )
    return agreement.coref_names(mentions, "user_id", BLOCKED)


@query("""
SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'click') AND value <= 200 AND event_id % 3 < 2) AS usable, count(*) FILTER (event_type <> 'error') AS reviewable FROM events GROUP BY user_id""")
def learnable_lines(t):
    speaker = F.when(F.col("event_type") == "error", " Narrator ").when(F.col("event_type") == "click", "unknown").otherwise(F.col("event_type"))
    cue = F.element_at(F.array(F.lit("M"), F.lit("female "), F.lit("Unknown")), (F.col("event_id") % 3 + 1).cast("int"))
    usable = agreement.usable_gender_cue(speaker, F.col("value") > 200, F.lit(None).cast("boolean"), cue)
    return t("events").groupBy("user_id").agg(F.count_if(usable).alias("usable"), F.count_if(agreement.reviewable(speaker)).alias("reviewable"))


@query("""
WITH r AS (SELECT c_custkey AS k, 'cust_' || c_custkey AS id, c_name, c_acctbal > 3000 AS known, c_acctbal < 0 AS alias FROM customer), e AS (SELECT o_orderstatus, o_custkey, min(o_orderkey) AS place FROM orders GROUP BY ALL),
m AS (SELECT id, c_name FROM r WHERE known ORDER BY id LIMIT 1)
SELECT o_orderstatus AS chapter, 'cust_' || o_custkey AS "character", CASE WHEN alias THEN m.id ELSE coalesce(r.id, 'cust_' || o_custkey) END AS id, CASE WHEN known THEN r.c_name WHEN alias THEN m.c_name ELSE 'Cust ' || o_custkey END AS name, place
FROM e LEFT JOIN r ON k = o_custkey LEFT JOIN m ON true""")
def chapter_cast(t):
    customers = t("customer").withColumn("id", F.concat(F.lit("cust_"), "c_custkey"))
    records = customers.where("c_acctbal > 3000").select("id", F.col("c_name").alias("name"))
    least = records.agg(F.min("id").alias("id")).withColumn("one", F.lit(1))
    lookup = customers.where("c_acctbal < 0").select(F.concat(F.lit("cust "), "c_custkey").alias("surface"), F.lit(1).alias("one")).join(least, "one").select("surface", "id")
    lines = t("orders").select(F.col("o_orderstatus").alias("chapter"), F.concat(F.lit("cust_"), "o_custkey").alias("character"), "o_orderkey")
    return agreement.chapter_characters(lines, records, lookup, "o_orderkey")


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber AS place, CAST(l_partkey AS VARCHAR) AS surface, CASE WHEN p_size > 10 THEN p_brand END AS id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, place, id, surface FROM m QUALIFY id IS NULL OR row_number() OVER (PARTITION BY l_orderkey, id ORDER BY place, surface) = 1""")
def migrated_roster(t):
    entries = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.col("l_partkey").cast("string").alias("surface"))
    lookup = t("part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("surface"), F.col("p_brand").alias("id"))
    return agreement.migrated_roster(entries, lookup, "l_orderkey")
