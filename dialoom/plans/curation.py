"""Queries over curated speakers and clips; shared tables stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import clips, curation, placing
from dialoom.plans.registry import query
from dialoom.plans.texts import LINES, paragraphs


def _curated(t):
    speaker = F.when(F.col("l_linenumber") == 1, "Narrator").when(F.col("l_linenumber") > 2, F.col("l_returnflag")).otherwise("")
    two = F.when(F.col("l_linenumber") != 3, F.array("l_returnflag", F.nullif("l_linestatus", F.lit("F")))).otherwise(F.array("l_returnflag"))
    return t("lineitem").select(F.col("l_suppkey").alias("chapter"), speaker.alias("speaker"), (F.col("l_tax") > 0.05).alias("conflict"), two.alias("candidates"))


@query("""
SELECT l_suppkey AS chapter, grouping(l_suppkey) = 1 AS whole, count(*) AS lines, count(*) FILTER (l_linenumber > 2) AS dialogue, count(*) FILTER (l_tax > 0.05) AS conflicts FROM lineitem GROUP BY ROLLUP (l_suppkey)""")
def curation_totals(t):
    return curation.curation_report(_curated(t))


@query("SELECT l_returnflag AS speaker, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def speaker_totals(t):
    return curation.speaker_frequency(_curated(t))


@query("""
SELECT l_returnflag || ' vs ' || CASE l_linestatus WHEN 'F' THEN '' ELSE l_linestatus END AS pattern, count(*) AS n FROM lineitem WHERE l_tax > 0.05 AND l_linenumber <> 3 GROUP BY 1""")
def conflict_pairs(t):
    return curation.conflict_patterns(_curated(t))


@query("""
WITH m AS (SELECT o_custkey, o_orderstatus = 'F' AS book, count(*) FILTER (o_totalprice > 100000) AS n FROM orders GROUP BY ALL),
c AS (SELECT o_custkey, arg_max(n, book) AS n, bool_or(book) AS book FROM m GROUP BY 1)
SELECT c_custkey AS "character", CASE WHEN book THEN 'book' WHEN NOT book THEN 'chapters' END AS origin, coalesce(n, 0) AS entries FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def manifest_origins(t):
    rows = t("orders").select("o_orderstatus", F.col("o_custkey").alias("character"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey")).alias("entry"))
    return curation.manifest_summary(t("customer").select(F.col("c_custkey").alias("character")), rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), "character")


@query(r"""
WITH l AS (SELECT p_partkey AS place, p_brand AS chapter, CASE WHEN p_size >= 10 THEN string_split(p_name, ' ')[2] END AS speaker, p_type || ': the ' || p_name || '-like ' || p_size AS text FROM part),
n AS (SELECT name, min(place) AS since, count(chapter) AS said, arg_min(chapter, place) FILTER (chapter IS NOT NULL) AS first_seen FROM
  (SELECT speaker AS name, place, chapter FROM l WHERE speaker IS NOT NULL UNION ALL SELECT DISTINCT p_name, -1, NULL FROM part WHERE starts_with(p_name, 'cold')) GROUP BY name)
SELECT name, said AS count_dialogue, (SELECT count(*) FROM l WHERE place >= since AND regexp_matches(text, '\b' || name || '\b')) AS count_mentions, first_seen FROM n""")
def ingest_counts(t):
    part = t("part")
    body = F.concat("p_type", F.lit(": the "), "p_name", F.lit("-like "), F.col("p_size").cast("string"))
    lines = part.select(F.col("p_partkey").alias("place"), F.col("p_brand").alias("chapter"), F.when(F.col("p_size") >= 10, F.split("p_name", " ")[1]).alias("speaker"), body.alias("text"))
    known = part.where("p_name LIKE 'cold%'").select(F.col("p_name").alias("name"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("chapter")).distinct()
    return curation.ingested(lines, known)


@query("""
WITH r AS (SELECT 0 AS scope, s_suppkey AS ord, 's ' || s_suppkey AS id, 'nation ' || s_nationkey AS name FROM supplier UNION ALL SELECT 1, c_custkey, 'c ' || c_custkey, 'nation ' || c_nationkey FROM customer WHERE c_acctbal > 8000),
s AS (SELECT id AS surface, * FROM r UNION ALL SELECT name, * FROM r)
SELECT surface, scope, id FROM s QUALIFY row_number() OVER (PARTITION BY surface ORDER BY scope DESC, ord DESC) = 1""")
def scoped_names(t):
    side = lambda rows, key, nation, mark: rows.select(F.col(key).alias("ord"), F.concat_ws("-", F.lit(mark), key).alias("id"), F.concat_ws("_", F.lit("Nation"), nation).alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    found = curation.scoped_lookup(side(t("supplier"), "s_suppkey", "s_nationkey", "s"), side(t("customer").where("c_acctbal > 8000"), "c_custkey", "c_nationkey", "c"))
    return found.withColumn("id", text.character_name(F.col("id")))


@query("""
WITH l AS (SELECT o_orderpriority AS chapter, CASE o_custkey % 3 WHEN 0 THEN 'ID ' WHEN 1 THEN 'al ' ELSE 'name ' END || o_custkey % 40 AS identity FROM orders),
k AS (SELECT 2 AS rank, n_nationkey AS ord, 'id ' || n_nationkey AS key, 'Name ' || n_nationkey AS name FROM nation UNION ALL SELECT 0, n_nationkey, 'name ' || n_nationkey, 'Name ' || n_nationkey FROM nation
  UNION ALL SELECT 1, n_nationkey, 'al ' || n_nationkey + d, 'Name ' || n_nationkey FROM nation, (VALUES (0), (1)) v(d)),
b AS (SELECT key, name FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, ord DESC) = 1),
c AS (SELECT chapter, coalesce(name, identity) AS name, count(*) AS lines FROM l LEFT JOIN b ON key = lower(identity) GROUP BY ALL),
a AS (SELECT key AS alias, arg_max(name, ord) AS owner FROM k WHERE rank = 1 GROUP BY key)
SELECT chapter, name, lines FROM c WHERE name NOT IN (SELECT alias FROM a) UNION ALL SELECT chapter, alias, lines FROM c JOIN a ON owner = name""")
def identity_line_counts(t):
    kind = F.when(F.col("o_custkey") % 3 == 0, "ID ").when(F.col("o_custkey") % 3 == 1, "al ").otherwise("name ")
    lines = t("orders").select(F.col("o_orderpriority").alias("chapter"), F.concat(kind, F.col("o_custkey") % 40).alias("identity"))
    named = lambda mark, add=0: F.concat(F.lit(mark), (F.col("n_nationkey") + add).cast("string"))
    characters = t("nation").select(F.col("n_nationkey").alias("ord"), named("id ").alias("id"), named("Name ").alias("name"), F.array(named("al "), named("al ", 1)).alias("aliases"))
    return curation.line_counts(lines, characters)


@query("""
SELECT CAST(l_suppkey AS VARCHAR) AS name, l_orderkey * 10 + l_linenumber AS line, count(*) OVER (PARTITION BY l_suppkey) AS lines, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey) AS first_line FROM lineitem WHERE l_returnflag = 'R'""")
def suggested_assignments(t):
    rows = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_returnflag") == "R", "suggestion").alias("outcome"), F.concat(F.lit(" "), "l_suppkey", F.lit(" ")).alias("name"))
    return curation.suggested_lines(rows)


@query("""
SELECT o_orderkey AS line, CASE WHEN c_custkey IS NOT NULL THEN 'c' || c_custkey END AS "character", c_mktsegment AS name, c_mktsegment <> 'FURNITURE' AND c_nationkey <> 7 AS add_descriptor
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def descriptor_assignments(t):
    characters = t("customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("array<string>").alias("aliases"),
        F.array(F.when(F.col("c_nationkey") == 7, " Furniture ")).alias("descriptors"),
    )
    return curation.descriptor_plan(t("orders").select(F.col("o_orderkey").alias("line"), F.concat(F.lit(" C"), "o_custkey").alias("target")), characters, "furniture ")


@query("""
WITH l AS (SELECT year(o_orderdate) AS chapter, o_orderkey AS place, o_custkey, o_orderpriority AS gold, c_custkey IS NOT NULL AS listed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000),
g AS (SELECT *, CASE WHEN listed THEN '3-MEDIUM' WHEN min(chapter) OVER c < chapter THEN first(gold) OVER (PARTITION BY o_custkey ORDER BY chapter, place) END AS guess,
  NOT listed AND row_number() OVER (PARTITION BY o_custkey ORDER BY chapter, place) = 1 AS learns FROM l WINDOW c AS (PARTITION BY o_custkey))
SELECT chapter, count(*) AS total, count(guess) AS matched, count(*) FILTER (guess = gold) AS correct, count(*) FILTER (learns) AS learned FROM g GROUP BY chapter""")
def prequential_chapters(t):
    lines = t("orders").select(F.year("o_orderdate").cast("long").alias("chapter"), F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("surface"), F.col("o_orderpriority").alias("gold"))
    return curation.prequential(lines, t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("surface"), F.lit("3-MEDIUM").alias("id")))


@query(r"""
WITH l AS (SELECT o_orderkey AS line, 'Nation ' || o_custkey % 5 AS "character", CASE WHEN o_custkey % 2 = 0 THEN 'nation-' || o_custkey % 3 || '/' || o_orderkey || '-1.wav' ELSE '' END AS output FROM orders),
c AS (SELECT l_orderkey AS line, 'nation_' || l_suppkey % 5 AS id, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'Nation ' || l_suppkey % 3 END AS name, 'nation-' || l_suppkey % 4 AS folder, CASE WHEN l_tax > 0.04 THEN 'a/chapter.txt' END AS source,
  'nation-' || l_suppkey % 4 || '/' || l_orderkey || '-' || l_linenumber || CASE WHEN l_quantity > 25 THEN '.wav' ELSE '.mp3' END AS path, l_tax < 0.07 AS ok FROM lineitem),
j AS (SELECT c.*, "character", output, CASE WHEN output <> '' THEN string_split(output, '/')[1] ELSE '' END AS want FROM l JOIN c USING (line)),
s AS (SELECT line, path, ok, ends_with(path, '.wav') AS wav, CASE WHEN source IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN ends_with(path, '.wav') THEN 5 ELSE 0 END + CASE WHEN output <> '' AND string_split(path, '/')[2] = string_split(output, '/')[2] THEN 250 ELSE 0 END
    + CASE WHEN want <> '' AND folder = want THEN 200 ELSE 0 END + CASE WHEN output <> '' AND ends_with(path, output) THEN 300 ELSE 0 END
    + CAST(list_sum(list_transform(list_filter([id, name, folder], lambda v: v <> ''), lambda v: CASE WHEN v = "character" THEN 120 ELSE 0 END + CASE WHEN replace(v, ' ', '-') = replace("character", ' ', '-') THEN 70 ELSE 0 END
      + CASE WHEN regexp_replace(lower(v), '[ _-]', '', 'g') = regexp_replace(lower("character"), '[ _-]', '', 'g') THEN 40 ELSE 0 END
      + CASE WHEN want = '' THEN 0 ELSE CASE WHEN v = want THEN 110 ELSE 0 END + CASE WHEN replace(v, ' ', '-') = want THEN 60 ELSE 0 END + CASE WHEN regexp_replace(lower(v), '[ _-]', '', 'g') = replace(want, '-', '') THEN 30 ELSE 0 END END)) AS INT) AS score,
  list_sort(list_distinct([replace(id, '_', ''), replace(folder, '-', '')])) AS owner FROM j),
b AS (SELECT line, path, score, owner FROM s WHERE ok QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, NOT wav, path) = 1)
SELECT l.line, b.path, b.score, (SELECT count(*) FROM s WHERE s.line = l.line) AS candidates, CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.line = l.line) THEN 'none' WHEN b.line IS NULL THEN 'missing'
  WHEN EXISTS (SELECT 1 FROM s WHERE s.line = l.line AND s.ok AND s.score = b.score AND s.owner <> b.owner) THEN 'ambiguous' ELSE 'ok' END AS status FROM l LEFT JOIN b ON b.line = l.line""")
def published_clips(t):
    mod = lambda column, n: (F.col(column) % n).cast("string")
    output = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("nation-"), mod("o_custkey", 3), F.lit("/"), "o_orderkey", F.lit("-1.wav"))).otherwise("")
    lines = t("orders").select(F.col("o_orderkey").alias("line"), F.concat(F.lit("Nation "), mod("o_custkey", 5)).alias("character"), output.alias("output"))
    folder = F.concat(F.lit("nation-"), mod("l_suppkey", 4))
    candidates = t("lineitem").select(
        F.col("l_orderkey").alias("line"), F.concat(F.lit("nation_"), mod("l_suppkey", 5)).alias("id"), F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.concat(F.lit("Nation "), mod("l_suppkey", 3))).alias("name"),
        folder.alias("folder"), F.when(F.col("l_tax") > 0.04, "a/chapter.txt").alias("source"), (F.col("l_tax") < 0.07).alias("exists"),
        F.concat(folder, F.lit("/"), "l_orderkey", F.lit("-"), "l_linenumber", F.when(F.col("l_quantity") > 25, ".wav").otherwise(".mp3")).alias("path"),
    )
    return clips.resolved_clips(lines, candidates)


@query("""
WITH c AS (SELECT l_orderkey AS chapter, CAST(round(l_extendedprice * 100) AS BIGINT) AS clip, l_linenumber % 4 AS line, l_linenumber % 4 AS expected, l_discount * 5 AS similarity, l_suppkey % 4 AS best, l_tax * 10 AS best_score, least(0.05, 0.05 * l_quantity / (l_linenumber * 5)) AS bonus FROM lineitem),
s AS (SELECT *, similarity + bonus AS own, CASE WHEN abs(best - expected) = 1 THEN best END AS target, best_score + bonus AS shift FROM c),
o AS (SELECT chapter, line AS target, max(own) AS owner FROM s GROUP BY ALL),
m AS (SELECT chapter, expected, arg_max(target, clip) AS target FROM s WHERE target IS NOT NULL GROUP BY ALL),
h AS (SELECT a.chapter, a.expected FROM m a JOIN m b ON b.chapter = a.chapter AND a.target = a.expected - 1 AND b.expected = a.expected + 1 AND b.target = a.expected),
r AS (SELECT s.*, coalesce(owner, 0) AS owner, row_number() OVER (PARTITION BY chapter, line ORDER BY own DESC, clip) > 1 AS dup, target IS NOT NULL AND row_number() OVER (PARTITION BY chapter, target ORDER BY shift DESC, clip) > 1 AS late,
  target IS NOT NULL AND coalesce(owner, 0) >= max(shift) OVER (PARTITION BY chapter, target) + 0.05 AS weak FROM s LEFT JOIN o USING (chapter, target))
SELECT chapter, clip, CASE WHEN weak OR late THEN 'adjacent_shift_lower_match' WHEN dup THEN 'duplicate_weaker_match' END AS status, weak OR late OR dup AS regenerate, coalesce(target, CASE WHEN dup THEN line END) AS suggested,
  EXISTS (SELECT 1 FROM h WHERE h.chapter = r.chapter AND r.expected IN (h.expected, h.expected + 1)) AS in_chain FROM r""")
def shifted_clips(t):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("chapter"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("clip"), (F.col("l_linenumber") % 4).alias("line"), (F.col("l_linenumber") % 4).alias("expected"),
        (F.col("l_discount") * 5).alias("similarity"), (F.col("l_suppkey") % 4).alias("best"), (F.col("l_tax") * 10).alias("best_score"), F.col("l_quantity").alias("said"), (F.col("l_linenumber") * 5).alias("wanted"),
    )
    return clips.clip_conflicts(rows).select("chapter", "clip", "status", "regenerate", "suggested", "in_chain")


@query(r"""
WITH t AS (SELECT doc_id, replace(replace(translate(coalesce(text, ''), '‘’“”–—', '''''""--'), '…', '...'), 'Lvl.', 'lvl.') AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '[\[(]\s*\?{3}\s*[\])]', ' unknown ', 'g'), '(?i)\blvl\b\.?', 'level', 'g'), '(^|\W)\+(\d[\d,]*(\.\d+)?)', '\1plus \2', 'g') AS x FROM t),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, ',([''"](\s|$))', '.\1', 'g'), ':\s*([\[(])', ' ... \1', 'g'), '[\[\]()]', ' ... ', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\s-\s', ' ... ', 'g'), ',\s*(?i:(plus\b))', ' ... \1', 'g'), '(\s*\.\.\.\s*)+', ' ... ', 'g') AS x FROM b)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(x, '\s+([,;:!?])', '\1', 'g'), '\s+', ' ', 'g'))) AS digest FROM c""")
def spoken_texts(t):
    return t("documents").select("doc_id", F.md5(text.spoken_text(F.col("text"))).alias("digest"))


@query("""
SELECT doc_id, CASE WHEN n_chars > 40 AND length(text) > 40 THEN md5(trim(CASE WHEN doc_id % 2 = 0 THEN '[Last speaker: ' || source || ']' || chr(10) ELSE '' END
  || ltrim(text[11:40], chr(10) || chr(9) || ' ') || '<quote>' || text[41:60] || '</quote>' || rtrim(text[61:90], chr(10) || chr(9) || ' '))) END AS digest FROM documents""")
def line_questions(t):
    last = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return t("documents").select("doc_id", F.md5(text.line_query(F.col("text"), F.lit(40), F.least(F.lit(60), F.col("n_chars")), last, 30)).alias("digest"))


@query("""
WITH d AS (SELECT doc_id, text, CAST(20 + doc_id % 7 AS BIGINT) AS a, CAST(60 + doc_id % 5 AS BIGINT) AS b, CAST(90 AS BIGINT) AS c FROM documents)
SELECT doc_id, CASE WHEN length(text) >= 110 THEN md5(text[1:a] || '<q1>' || text[a + 1:a + 15] || '</q1>' || text[a + 16:b] || '<q0>' || text[b + 1:b + 20] || '</q0>' || text[b + 21:c] || '<q2>' || text[c + 1:c + 20] || '</q2>' || text[c + 21:c + 60]) END AS digest FROM d""")
def run_questions(t):
    """Runs of three lines of a text, marked in one window, their spans not in order."""
    span = lambda start, n: F.struct(start.cast("int").alias("start"), (start + n).cast("int").alias("end"))
    spans = F.array(span(60 + F.col("doc_id") % 5, 20), span(20 + F.col("doc_id") % 7, 15), span(F.lit(90), 20))
    return t("documents").select("doc_id", F.md5(text.run_query(F.col("text"), spans, 40)).alias("digest"))


@query("""
SELECT l_returnflag AS stage, l_suppkey AS chapter, grouping(l_suppkey) = 1 AS whole, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(sum(CASE WHEN l_tax > 0.03 THEN l_linenumber ELSE 0 END) AS BIGINT) AS correct,
  sum(CASE WHEN l_tax > 0.03 THEN l_linenumber ELSE 0 END)::DOUBLE / sum(l_linenumber) AS accuracy FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_suppkey), (l_returnflag))""")
def stage_totals(t):
    correct = F.when(F.col("l_tax") > 0.03, F.col("l_linenumber")).otherwise(0)
    return curation.stage_summary(t("lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_suppkey").alias("chapter"), F.col("l_linenumber").alias("total"), correct.alias("correct")))


def _key(of: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(replace(replace(lower(trim({of})), 'â€™', chr(39)), '’', chr(39)), '["â€œ“”]', '', 'g'), '[^a-z0-9'']+', ' ', 'g'))"""


@query(rf"""
WITH {LINES}, p AS (SELECT doc_id, idx, start, "end" AS stop, line, {_key("line")} AS body, list_transform(regexp_extract_all(line, '["â€œ“](.+?)["â€”]', 1), lambda x: {_key("x")}) AS units FROM paragraphs),
l AS (SELECT doc_id, idx AS l, CASE WHEN idx % 4 > 0 THEN start + 60 END AS a, CASE WHEN idx % 4 > 0 THEN start + 80 END AS b, CASE WHEN len(units) > 0 AND idx % 3 = 0 THEN units[1] ELSE {_key("line[1:12 + idx % 5 * 4]")} END AS key FROM p),
s AS (SELECT l.doc_id, l.l, p.idx FROM l JOIN p ON p.doc_id = l.doc_id AND a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.l
  ORDER BY NOT (a < stop AND b > start), CASE WHEN a < stop AND b > start THEN 0 WHEN (a + b) / 2 BETWEEN start AND stop THEN 0 ELSE least(abs((a + b) / 2 - start), abs((a + b) / 2 - stop)) END, p.idx) = 1),
r AS (SELECT l.*, s.idx AS spot FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.l = l.l),
f AS (SELECT r.*, p.idx, NOT coalesce(list_contains(units, key), false) AS plain, CASE WHEN a IS NULL OR (a + b) / 2 BETWEEN start AND stop THEN 0 ELSE least(abs((a + b) / 2 - start), abs((a + b) / 2 - stop)) END AS d
  FROM r JOIN p ON p.doc_id = r.doc_id AND key <> '' AND (list_contains(units, key) OR contains(' ' || body || ' ', ' ' || key || ' '))
  QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.l ORDER BY plain, d, CASE WHEN spot > 0 THEN abs(p.idx - spot) ELSE 0 END, p.idx) = 1)
SELECT r.doc_id, CAST(r.l AS BIGINT) AS l, CAST(coalesce(f.idx, r.spot) AS BIGINT) AS paragraph, CASE WHEN f.idx IS NULL THEN CASE WHEN r.spot IS NULL THEN 'unresolved' ELSE 'span_fallback' END ELSE CASE WHEN plain THEN 'quote_text' ELSE 'quote_unit' END || CASE WHEN f.idx <> r.spot THEN '_span_corrected' ELSE '' END END AS method,
  CASE WHEN f.idx IS NULL THEN CASE WHEN r.spot IS NULL THEN 0.0 ELSE 0.45 END WHEN NOT plain OR length(r.key) >= 6 THEN 1.0 ELSE 0.92 END::DOUBLE AS confidence, CAST(r.spot AS BIGINT) AS span_paragraph, CASE WHEN f.idx IS NULL AND r.spot IS NULL THEN NULL ELSE coalesce(d, 0) END::DOUBLE AS distance
FROM r LEFT JOIN f ON f.doc_id = r.doc_id AND f.l = r.l""")
def line_paragraphs(t):
    rows = paragraphs(t)
    units = F.regexp_extract_all("text", F.lit('["â€œ“](.+?)["â€”]'), F.lit(1))
    said = F.when((F.size(units) > 0) & (F.col("idx") % 3 == 0), F.get(units, F.lit(0))).otherwise(F.substring("text", F.lit(1), 12 + F.col("idx") % 5 * 4))
    at = lambda n: F.when(F.col("idx") % 4 > 0, F.col("start") + n)
    lines = rows.select("doc_id", F.col("idx").cast("long").alias("l"), at(60).alias("start"), at(80).alias("end"), said.alias("text"))
    return placing.resolved_lines(lines, rows)
