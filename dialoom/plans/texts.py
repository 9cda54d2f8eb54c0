"""Queries over documents, pages, labels and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import cues, text
from dialoom.operators import aggregate, passes, ranking, sequence, spans
from dialoom.plans.registry import query

LINES = r"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
paragraphs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS idx, CAST(start AS INT) AS start, CAST(start + length(line) AS INT) AS "end", line
  FROM placed WHERE trim(line, ' ' || chr(9)) <> '')"""


def paragraphs(t):
    return t("documents").select("doc_id", F.explode(text.paragraphs(F.col("text"))).alias("p")).select("doc_id", "p.idx", "p.start", "p.end", "p.text")


@query(f'WITH {LINES} SELECT doc_id, idx, start, "end", md5(line) AS digest FROM paragraphs')
def paragraph_ranges(t):
    return paragraphs(t).select("doc_id", "idx", "start", "end", F.md5("text").alias("digest"))


@query(r"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, md5(s[1]) AS first, md5(s[-1]) AS last, len(s) AS n FROM t""")
def first_last_sentence(t):
    body = F.col("text")
    n = F.size(F.split(F.trim(F.coalesce(body, F.lit(""))), r"(?<=[.!?])\s+")).cast("long")
    return t("documents").select("doc_id", F.md5(text.sentence(body, False)).alias("first"), F.md5(text.sentence(body, True)).alias("last"), n.alias("n"))


@query(r"""
WITH q AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '["“”][^\n]*?["“”]') AS q FROM documents)
SELECT doc_id, len(q) AS quotes, coalesce(CAST(list_sum(list_transform(q, lambda x: length(x))) AS BIGINT), 0) AS chars FROM q""")
def quote_units(t):
    found = text.quotes(F.col("text"))
    chars = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return t("documents").select("doc_id", F.size(found).cast("long").alias("quotes"), chars.alias("chars"))


@query(r"""
WITH q AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS q FROM documents)
SELECT doc_id, len(q) AS n, len(list_distinct(q)) AS kinds, md5(array_to_string(q, ' ')) AS digest FROM q""")
def token_counts(t):
    found = text.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(found).cast("long").alias("n"), F.size(F.array_distinct(found)).cast("long").alias("kinds"), F.md5(F.array_join(found, " ")).alias("digest"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9'']+', ' ', 'g'))) AS digest FROM documents""")
def phrase_text(t):
    return t("documents").select("doc_id", F.md5(text.phrase(F.col("text"))).alias("digest"))


@query("""
SELECT source, grouping(source) = 1 AS is_total, count(*) AS total, count(l.doc_id) AS parsed, count(*) - count(l.doc_id) AS unparsed
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY GROUPING SETS ((source), ())""")
def chapter_status(t):
    known = t("labels").select("doc_id").distinct().withColumn("parsed", F.lit(True))
    rows = t("documents").join(known, "doc_id", "left").rollup("source")
    return rows.agg((F.grouping("source") == 1).alias("is_total"), F.count("*").alias("total"), F.count("parsed").alias("parsed"), F.count_if(F.col("parsed").isNull()).alias("unparsed"))


@query(rf"""
WITH {LINES},
points AS (SELECT doc_id, p AS at FROM documents, unnest(generate_series(CAST(50 AS BIGINT), CAST(length(text) AS BIGINT) - 1, CAST(997 AS BIGINT))) u(p))
SELECT p.doc_id, CAST(p.at AS INT) AS at, coalesce(max(q.idx), -1) AS idx FROM points p LEFT JOIN paragraphs q ON p.doc_id = q.doc_id AND q.start <= p.at AND p.at < q."end" GROUP BY ALL""")
def point_in_paragraph(t):
    end = F.length("text") - 1
    at = F.when(end >= 50, F.sequence(F.lit(50), end, F.lit(997)))
    points = t("documents").select("doc_id", F.explode(at).alias("at"))
    return spans.interval_of(points, paragraphs(t).drop("text")).select("doc_id", "at", "idx")


@query(rf"""
WITH {LINES},
blocks AS (SELECT doc_id, CAST(b AS INT) AS r, CAST(b * 300 AS INT) AS s, CAST(least(b * 300 + 300, length(text)) AS INT) AS e FROM documents, unnest(generate_series(CAST(0 AS BIGINT), CAST((length(text) - 1) // 300 AS BIGINT))) u(b) WHERE length(text) > 0),
pairs AS (SELECT p.doc_id, p.idx AS l, b.r, least(p."end", b.e) - greatest(p.start, b.s) AS shared FROM paragraphs p JOIN blocks b ON p.doc_id = b.doc_id AND p.start < b.e AND b.s < p."end"),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY shared DESC, r) AS k FROM pairs)
SELECT doc_id, l, r, shared FROM best WHERE k = 1""")
def span_overlap_best(t):
    left = paragraphs(t).select("doc_id", F.col("idx").alias("l"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    n = F.length("text")
    right = t("documents").where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 300).cast("int"))).alias("r"))
    right = right.select("doc_id", "r", (F.col("r") * 300).alias("r_start"), F.least(F.col("r") * 300 + 300, "n").alias("r_end"))
    return spans.best_overlap(spans.overlapping(left, right)).select("doc_id", "l", "r", "shared")


def _judged(t):
    said = F.when(F.col("n_chars") > 120, 1).otherwise(0)
    return t("labels").join(t("documents"), "doc_id").select("doc_id", "lang", "quality", "toxic", "n_chars", said.alias("said"))


JUDGED = "j AS (SELECT doc_id, lang, quality, toxic, n_chars, CASE WHEN n_chars > 120 THEN 1 ELSE 0 END AS said FROM labels JOIN documents USING (doc_id))"


@query(f"""
WITH {JUDGED}, c AS (SELECT said AS k, quality = said AS hit, false AS meant FROM j UNION ALL SELECT quality, false, true FROM j WHERE quality <> said),
s AS (SELECT CAST(k AS VARCHAR) AS class, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit AND NOT meant) AS fp, count(*) FILTER (meant) AS fn FROM c GROUP BY k)
SELECT class, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s""")
def class_report(t):
    return aggregate.class_report(_judged(t), "quality", "said")


@query(f"""
WITH {JUDGED}
SELECT lang, CAST(grouping(lang) AS INT) AS is_total, count(*) AS total, count(*) FILTER (quality = said) AS correct, count(*) FILTER (n_chars > 400) AS asserted,
  count(*) FILTER (quality = said AND n_chars > 400) AS assert_correct, coalesce(count(*) FILTER (quality = said) / nullif(count(*), 0), 0) AS accuracy,
  coalesce(count(*) FILTER (quality = said AND n_chars > 400) / nullif(count(*) FILTER (n_chars > 400), 0), 0) AS assert_precision
FROM j GROUP BY GROUPING SETS ((lang), ())""")
def micro_report(t):
    return aggregate.micro_report(_judged(t), "lang", F.col("quality") == F.col("said"), F.col("n_chars") > 400)


@query(f"""
WITH {JUDGED}, a AS (SELECT lang, count(*) FILTER (quality = 1) / count(*) AS v FROM j GROUP BY lang HAVING count(*) > 0), b AS (SELECT lang, count(*) FILTER (said = 1) / count(*) AS v FROM j WHERE toxic = 0 GROUP BY lang)
SELECT lang, a.v AS left, b.v AS right, b.v - a.v AS delta FROM a FULL JOIN b USING (lang)""")
def report_delta(t):
    share = lambda df, c: df.groupBy("lang").agg((F.count_if(F.col(c) == 1) / F.count("*")).alias("v"))
    return aggregate.report_delta(share(_judged(t), "quality"), share(_judged(t).where("toxic = 0"), "said"), "lang", "v")


@query(f"""
WITH {JUDGED}, c AS (SELECT 'short' AS cue, quality AS g, said AS c, 0 AS p FROM j WHERE n_chars < 300 UNION ALL SELECT 'clean', quality, said, 1 FROM j WHERE toxic = 0)
SELECT cue, count(*) AS support, count(*) FILTER (g = p) AS cue_correct, count(*) FILTER (c <> p) AS changed, count(*) FILTER (c <> p AND g = p) AS fixes,
  count(*) FILTER (c <> p AND g = c) AS regressions, count(*) FILTER (c <> p AND g <> c AND g <> p) AS wrong_to_wrong FROM c GROUP BY cue""")
def cue_report(t):
    cues = {"short": F.when(F.col("n_chars") < 300, 0), "clean": F.when(F.col("toxic") == 0, 1)}
    return aggregate.cue_report(_judged(t), F.col("quality"), F.col("said"), cues)


@query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r FROM documents) WHERE r <= 100""")
def exact_sample(t):
    return ranking.exact_sample(t("documents").select("doc_id"), F.col("doc_id"), 100)


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
b AS (SELECT *, coalesce(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY i)) = '', true) AS open FROM lines),
k AS (SELECT *, sum(CASE WHEN NOT open AND coalesce(regexp_matches(line, '^[^\p{L}\p{Nd}]*\p{Ll}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
m AS (SELECT doc_id, CAST(min(i) - 1 AS INT) AS "at", count(*) AS merged, string_agg(trim(line), chr(10) ORDER BY i) AS t FROM k GROUP BY doc_id, run)
SELECT doc_id, "at", merged, md5(replace(replace(t, '-' || chr(10), '-'), chr(10), ' ')) AS digest FROM m""")
def line_wrap_merge(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return sequence.merged_lines(lines, ["doc_id"], "at", "line").select("doc_id", "at", "merged", F.md5("line").alias("digest"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM pages")
def slugs(t):
    return t("pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query(r"""
WITH c AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(["“”].*?["“”])', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM c),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
f AS (SELECT * FROM o WHERE regexp_matches(piece, '\S'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS i, CASE WHEN regexp_matches(piece, '^["“”]') THEN 'dialogue' ELSE 'narration' END AS type,
  md5(trim(piece, '"“” ')) AS digest, CAST(start AS BIGINT) AS start, CAST(start + length(piece) AS BIGINT) AS "end" FROM f""")
def quote_chunks(t):
    return passes.chunks(t("documents"), "doc_id", "text").drop("at", "breaks", "paragraph").withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")


@query(r"""
SELECT doc_id, regexp_matches(' ' || lower(trim(coalesce(text, ''))) || ' ',
  ' (?:said|asked|replied|answered|muttered|shouted|whispered|snapped|yelled|growled|sighed|hissed|called|told|added|continued|remarked|noted|stated|declared|insisted) ') AS speech FROM documents""")
def speech_verbs_nearby(t):
    return t("documents").select("doc_id", cues.nearby_speech_verb(F.col("text")).alias("speech"))
