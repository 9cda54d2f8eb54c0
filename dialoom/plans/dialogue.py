"""Queries over conversations and events: a conversation is a chapter, a turn a line, a role a character; system narrates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import cues
from dialoom.functions.scalars import joined, ratio
from dialoom.operators import aggregate, evaluation, passes, sequence, training
from dialoom.plans.registry import query

CHAPTER, LINE = ["conv_id"], ["turn"]


def speaker():
    return F.when(F.col("role") != "system", F.col("role"))


@query("SELECT role AS character, count(*) AS total_lines, count(DISTINCT conv_id) AS chapter_count FROM conversations WHERE trim(role) <> '' GROUP BY role")
def character_stats(t):
    return aggregate.character_stats(aggregate.counts_matrix(t("conversations"), F.col("role"), F.col("conv_id")))


@query("""
WITH n AS (SELECT conv_id, role, count(*) AS n FROM conversations WHERE trim(role) <> '' GROUP BY ALL)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS total, string_agg(role || '=' || n, ',' ORDER BY role) AS breakdown FROM n GROUP BY conv_id""")
def character_breakdown(t):
    found = aggregate.breakdown(aggregate.counts_matrix(t("conversations"), F.col("role"), F.col("conv_id")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("breakdown")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select(F.col("chapter").alias("conv_id"), "total", shown.alias("breakdown"))


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AND bool_or(role = 'user') OVER (PARTITION BY conv_id) AS is_returning FROM conversations""")
def is_returning(t):
    return t("conversations").select("conv_id", "turn", sequence.returning(F.col("role") == "user", CHAPTER, LINE).alias("is_returning"))


@query("""
WITH s AS (SELECT *, nullif(role, 'system') AS who FROM conversations)
SELECT conv_id, turn,
  coalesce(last_value(who IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'None') AS before,
  last_value(who IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until_here,
  first_value(who IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
FROM s""")
def speaker_neighbours(t):
    return t("conversations").select(
        "conv_id", "turn",
        F.coalesce(sequence.last_known(speaker(), CHAPTER, LINE), F.lit("None")).alias("before"),
        sequence.last_known(speaker(), CHAPTER, LINE, inclusive=True).alias("until_here"), sequence.next_known(speaker(), CHAPTER, LINE).alias("next"),
    )


@query("""
WITH d AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, previous, following, next_role FROM d""")
def dialogue_neighbours(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").where("role <> 'system'")
    return rows.select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"), F.lead("role").over(w).alias("next_role"))


@query("""
SELECT conv_id, turn, coalesce(list_aggregate(list_transform(list_filter(list({'t': turn, 'r': role}) OVER w, lambda x: x.t <> turn), lambda x: x.t || ':' || x.r), 'string_agg', ','), '') AS history
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)""")
def turn_history(t):
    around = sequence.turn_history(F.col("role"), F.col("turn"), CHAPTER, LINE)
    return t("conversations").select("conv_id", "turn", around.alias("h")).select(
        "conv_id", "turn", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["at"].cast("string"), x["row"])), ",").alias("history")
    )


@query("""
SELECT conv_id, turn, coalesce(list_aggregate(list_sort(list_distinct(list(nullif(role, 'system')) OVER w)), 'string_agg', ','), '') AS roster
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def scene_roster(t):
    return t("conversations").select("conv_id", "turn", joined(sequence.roster(speaker(), CHAPTER, LINE)).alias("roster"))


@query("""
WITH a AS (SELECT conv_id, turn, list(nullif(role, 'system')) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS near FROM conversations),
e AS (SELECT conv_id, turn, unnest(near) AS who, generate_subscripts(near, 1) AS i FROM a),
f AS (SELECT conv_id, turn, who, min(i) AS i FROM e WHERE who IS NOT NULL GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(who, ',' ORDER BY i) AS roster FROM f GROUP BY ALL)
SELECT conv_id, turn, coalesce(roster, '') AS roster FROM conversations LEFT JOIN g USING (conv_id, turn)""")
def scene_roster_by_value(t):
    return t("conversations").select("conv_id", "turn", joined(sequence.roster_by_value(speaker(), "turn", CHAPTER)).alias("roster"))


@query("""
WITH m AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, count(*) AS size, count(*) FILTER (length(text) > 200) AS targets, min(turn) AS first, max(turn) AS last
FROM m WHERE role <> 'system' GROUP BY conv_id, run HAVING count(*) FILTER (length(text) > 200) > 0""")
def dialogue_runs(t):
    return sequence.runs(t("conversations"), F.col("role") != "system", CHAPTER, LINE, F.length("text") > 200).drop("run")


@query("""
WITH d AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations WHERE role = 'user'),
e AS (SELECT *, CAST(sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS episode FROM d)
SELECT conv_id, episode, count(*) AS lines, min(turn) AS first, max(turn) AS last FROM e GROUP BY ALL""")
def speaker_episodes(t):
    rows = t("conversations").where("role = 'user'")
    rows = rows.withColumn("episode", sequence.episode_ids(F.col("turn"), CHAPTER, LINE, 2))
    return rows.groupBy("conv_id", "episode").agg(F.count("*").alias("lines"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("""
WITH s AS (SELECT *, epoch_us(ts) AS us FROM events), d AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM s),
e AS (SELECT *, CAST(sum(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM d)
SELECT user_id, session, count(*) AS events, min(event_id) AS least_event, count(DISTINCT event_type) AS kinds FROM e GROUP BY ALL""")
def event_sessions(t):
    rows = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("session", sequence.episode_ids(F.col("us"), ["user_id"], ["us", "event_id"], 1_800_000_000))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("least_event"), F.count_distinct("event_type").alias("kinds"))


@query("""
SELECT conv_id, turn, role, CAST(sum(greatest(1, length(text))) OVER (PARTITION BY conv_id, role ORDER BY turn) AS BIGINT) AS chars_so_far FROM conversations""")
def running_characters(t):
    size = F.greatest(F.lit(1), F.length("text"))
    return t("conversations").select("conv_id", "turn", "role", sequence.running_count(size, ["conv_id", "role"], LINE).alias("chars_so_far"))


@query("""
WITH s AS (SELECT conv_id, turn, length(text) < 200 AND role = 'user' AS a, lead(length(text) < 400 AND role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn FROM s WHERE a AND b""")
def short_then_short(t):
    first, second = (F.length("text") < 200) & (F.col("role") == "user"), (F.length("text") < 400) & (F.col("role") == "assistant")
    return t("conversations").select("conv_id", "turn", sequence.followed_by(first, second, CHAPTER, LINE).alias("hit")).where("hit").drop("hit")


@query("""
WITH s AS (SELECT conv_id, turn, role, length(text) > 150 AS sure, CASE WHEN length(text) > 150 THEN role END AS known FROM conversations),
n AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(known IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM s)
SELECT conv_id, turn, CASE WHEN NOT sure AND a = b AND b IN ('user', 'assistant') THEN b ELSE role END AS settled FROM n""")
def paragraph_consistency(t):
    sure = F.length("text") > 150
    settled = sequence.between_equals(F.col("role"), sure, F.array(F.lit("user"), F.lit("assistant")), CHAPTER, LINE)
    return t("conversations").select("conv_id", "turn", settled.alias("settled"))


@query("""
WITH RECURSIVE o AS (SELECT conv_id, CASE length(text) % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN '[a|b]' WHEN 2 THEN NULL ELSE role || length(text) % 3 END AS who,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
f(conv_id, i, n, stack) AS (SELECT conv_id, CAST(0 AS BIGINT), max(n), CAST([] AS VARCHAR[]) FROM o GROUP BY conv_id
  UNION ALL SELECT o.conv_id, o.i, o.n, CASE WHEN who IS NULL OR who = 'Unknown' OR starts_with(who, '[') OR stack[1] = who THEN stack ELSE ([who] || stack)[1:5] END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, array_to_string(stack, ',') AS stack FROM f WHERE i = n""")
def recency_stack(t):
    # a conversation's roles, not its texts, are gathered: the stack is a fold over them in order
    size = F.length("text")
    who = F.when(size % 7 == 0, "Unknown").when(size % 7 == 1, "[a|b]").when(size % 7 > 2, F.concat("role", (size % 3).cast("string")))
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("who")))).alias("a"))
    return rows.select("conv_id", joined(sequence.recency_stack(F.transform("a", lambda x: x["who"]))).alias("stack"))


@query("""
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  CAST(length(text) % 7 AS DOUBLE) AS a, CAST(length(text) % 5 AS DOUBLE) AS b FROM conversations),
f AS (SELECT conv_id, i, n, a, b, [0] AS pa, [1] AS pb FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, o.n, greatest(f.a - 0.25, f.b + 0.25) + o.a, greatest(f.a + 0.25, f.b - 0.25) + o.b,
    (CASE WHEN f.a - 0.25 >= f.b + 0.25 THEN f.pa ELSE f.pb END) || [0], (CASE WHEN f.a + 0.25 >= f.b - 0.25 THEN f.pa ELSE f.pb END) || [1]
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, array_to_string(CASE WHEN a >= b THEN pa ELSE pb END, '') AS path FROM f WHERE i = n""")
def two_speaker_path(t):
    score = F.struct("turn", (F.length("text") % 7).cast("double").alias("a"), (F.length("text") % 5).cast("double").alias("b"))
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(score)).alias("s"))
    path = sequence.two_speaker_path(F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), -0.25, 0.25)
    return rows.select("conv_id", F.array_join(path.cast("array<string>"), "").alias("path"))


@query("""
WITH RECURSIVE o AS (SELECT conv_id, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE trim(text) <> ''),
f AS (SELECT conv_id, i, 0 AS chunk, len AS size FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.i, f.chunk + CAST(f.size >= 300 OR f.size + 1 + o.len > 900 AS INT), CASE WHEN f.size >= 300 OR f.size + 1 + o.len > 900 THEN o.len ELSE f.size + 1 + o.len END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1),
c AS (SELECT conv_id, chunk, sum(len) + count(*) - 1 AS size FROM f JOIN o USING (conv_id, i) GROUP BY ALL),
tails AS (SELECT a.conv_id, a.chunk FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.chunk = a.chunk - 1
  WHERE a.size < 300 AND b.size + 1 + a.size <= 900 AND a.chunk = (SELECT max(chunk) FROM c x WHERE x.conv_id = a.conv_id))
SELECT f.conv_id, string_agg(CAST(f.chunk - CAST(tails.chunk IS NOT NULL AS INT) AS VARCHAR), ',' ORDER BY i) AS chunks
FROM f LEFT JOIN tails ON tails.conv_id = f.conv_id AND tails.chunk = f.chunk GROUP BY f.conv_id""")
def chunk_plan(t):
    rows = t("conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("a"))
    return rows.select("conv_id", joined(sequence.packed_chunks(F.transform("a", lambda x: x["n"]), 300, 900)).alias("chunks"))


@query("""
SELECT role, grouping(role) = 1 AS is_total, count(*) AS lines, count(*) FILTER (length(text) > 300) AS long_lines,
  coalesce(count(*) FILTER (length(text) > 300) / nullif(count(*), 0), 0) AS long_share
FROM conversations GROUP BY GROUPING SETS ((role), ())""")
def line_totals(t):
    sums = t("conversations").rollup("role").agg((F.grouping("role") == 1).alias("is_total"), F.count("*").alias("lines"), F.count_if(F.length("text") > 300).alias("long_lines"))
    return sums.withColumn("long_share", ratio(F.col("long_lines"), F.col("lines")))


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, arg_min(event_type, (-n, first)) AS mode, max(n) AS n FROM n GROUP BY user_id""")
def first_seen_mode(t):
    return aggregate.first_seen_mode(t("events"), ["user_id"], "event_type", F.col("event_id"))


@query("""
WITH w AS (SELECT user_id, event_type, sum(CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 2 ELSE 1 END) AS w FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC) AS r FROM w)
SELECT user_id, CASE WHEN max(w) FILTER (r = 2) IS NULL OR max(w) FILTER (r = 1) > max(w) FILTER (r = 2) THEN max(event_type) FILTER (r = 1) END AS winner,
  CAST(max(w) FILTER (r = 1) AS BIGINT) AS top, CAST(max(w) FILTER (r = 2) AS BIGINT) AS second FROM r GROUP BY user_id""")
def strict_vote(t):
    weight = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "click", 2).otherwise(1)
    return aggregate.strict_vote(t("events"), ["user_id"], "event_type", weight)


@query("""
WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS m, count(*) FILTER (event_type = 'view') AS f FROM events GROUP BY user_id)
SELECT user_id, m AS male, f AS female, CASE WHEN m - f >= 2 THEN 'male' WHEN f - m >= 2 THEN 'female' ELSE 'unknown' END AS learned FROM n""")
def learned_gender(t):
    sums = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("male"), F.count_if(F.col("event_type") == "view").alias("female"))
    return sums.withColumn("learned", aggregate.learned_gender(F.lit("unknown"), F.col("male"), F.col("female")))


@query("""
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
n AS (SELECT a.conv_id, a.turn, a.role, min(b.i) AS next FROM r a LEFT JOIN r b ON b.conv_id = a.conv_id AND b.i >= a.i + 2 AND b.role <> 'system' GROUP BY ALL),
w AS (SELECT a.conv_id, a.turn, min(b.turn) AS within FROM r a LEFT JOIN r b ON b.conv_id = a.conv_id AND b.i BETWEEN a.i + 2 AND a.i + 4 AND b.role = a.role AND a.role <> 'system' GROUP BY ALL)
SELECT w.conv_id, w.turn, within, CASE WHEN r.role = n.role THEN r.turn END AS next_dialogue
FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.turn LEFT JOIN r ON r.conv_id = n.conv_id AND r.i = n.next""")
def same_speaker_followup(t):
    def found(window):
        return sequence.same_speaker_followup(F.col("turn"), F.col("role"), F.col("role") == "system", CHAPTER, LINE, window)

    return t("conversations").select("conv_id", "turn", found(3).alias("within"), found(None).alias("next_dialogue"))


@query("""
WITH RECURSIVE d AS (SELECT conv_id, turn, role, length(text) > 150 AS hard, CAST(length(text) % 7 + 1 AS DOUBLE) / 10 AS u, CAST(length(text) % 5 + 1 AS DOUBLE) / 9.5 AS s,
  turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations WHERE role <> 'system'),
e AS (SELECT *, CAST(sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS episode FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, episode ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id, episode) AS n,
  count(*) FILTER (hard) OVER (PARTITION BY conv_id, episode) AS anchors,
  CASE WHEN NOT hard THEN ln(s) WHEN role = 'assistant' THEN 0.0 ELSE CAST('-inf' AS DOUBLE) END AS a, CASE WHEN NOT hard THEN ln(u) WHEN role = 'user' THEN 0.0 ELSE CAST('-inf' AS DOUBLE) END AS b FROM e),
f AS (SELECT conv_id, episode, i, n, a, b, [0] AS pa, [1] AS pb FROM g WHERE i = 1 AND anchors >= 2
  UNION ALL SELECT g.conv_id, g.episode, g.i, g.n, greatest(f.a + g.a - 0.28, f.b + g.a + 0.28), greatest(f.a + g.b + 0.28, f.b + g.b - 0.28),
    (CASE WHEN f.a + g.a - 0.28 > f.b + g.a + 0.28 THEN f.pa ELSE f.pb END) || [0], (CASE WHEN f.a + g.b + 0.28 > f.b + g.b - 0.28 THEN f.pa ELSE f.pb END) || [1]
  FROM f JOIN g ON g.conv_id = f.conv_id AND g.episode = f.episode AND g.i = f.i + 1),
p AS (SELECT conv_id, episode, CASE WHEN a > b THEN pa ELSE pb END AS path FROM f WHERE i = n),
c AS (SELECT g.conv_id, g.turn, g.role, g.hard, CASE WHEN path[g.i] = 0 THEN 'assistant' WHEN path[g.i] = 1 THEN 'user' END AS chosen FROM g LEFT JOIN p ON p.conv_id = g.conv_id AND p.episode = g.episode)
SELECT conv_id, turn, CASE WHEN NOT hard AND chosen IS NOT NULL THEN chosen ELSE role END AS decoded, coalesce(NOT hard AND chosen <> role, false) AS overridden FROM c""")
def decoded_episodes(t):
    size = F.length("text")
    option = lambda name, of, by: F.struct(F.lit(name).alias("name"), ((size % of + 1).cast("double") / by).alias("confidence"))
    rows = t("conversations").where("role <> 'system'").select(
        "conv_id", "turn", F.col("turn").alias("paragraph"), F.col("role").alias("speaker"), (size > 150).alias("hard"), (size <= 150).alias("suggestion"),
        F.array(option("user", 7, 10.0), option("assistant", 5, 9.5)).alias("candidates"),
    )
    return sequence.decoded_episodes(rows, CHAPTER, "turn")


@query("""
WITH l AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'narrator' ELSE role END AS who, text, length(text) AS n FROM conversations),
s AS (SELECT *, CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  coalesce(list_aggregate(list_sort(list_distinct(list(nullif(who, 'narrator')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))), 'string_agg', ', '), 'None') AS roster,
  coalesce(last_value(nullif(who, 'narrator') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'None') AS before FROM l),
c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS raw FROM l GROUP BY conv_id),
j AS (SELECT s.*, raw, length(raw) AS m, start + n + turn % 3 AS e, least(start + n + turn % 3, length(raw)) AS stop,
  CASE WHEN who = 'narrator' AND CAST('0x' || substr(sha256(s.conv_id || ':' || turn), 1, 8) AS BIGINT) / 4294967296.0 > 0.5 THEN 'excluded' WHEN start >= length(raw) THEN 'invalid_span' ELSE 'kept' END AS outcome FROM s JOIN c ON c.conv_id = s.conv_id)
SELECT conv_id, turn, outcome, outcome = 'kept' AND e > m AS clipped, outcome = 'kept' AND text <> substr(raw, start + 1, stop - start) AS mismatch,
  CASE WHEN outcome = 'kept' THEN 'Scene Characters: ' || roster || chr(10) || 'Last Speaker: ' || before || chr(10) || chr(10) || 'Context:' || chr(10) || regexp_replace(
    substr(raw, greatest(0, start - 600) + 1, start - greatest(0, start - 600)) || '<quote>' || substr(raw, start + 1, stop - start) || '</quote>' || substr(raw, stop + 1, least(m, stop + 600) - stop), '^\\s+|\\s+$', '', 'g') END AS asked,
  CASE WHEN outcome = 'kept' THEN CASE who WHEN 'narrator' THEN 'None' ELSE who END END AS answer FROM j""")
def training_rows(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    lines = t("conversations").withColumn("start", start).select(
        "conv_id", "turn", F.when(F.col("role") == "system", "narrator").otherwise(F.col("role")).alias("character"), "start",
        (F.col("start") + F.length("text") + F.col("turn") % 3).alias("end"), "text",
    )
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    chapters = t("conversations").groupBy("conv_id").agg(raw.alias("raw"))
    found = training.training_rows(lines, chapters, CHAPTER, "turn", "Who speaks?", 0.5)
    return found.select("conv_id", "turn", "outcome", "clipped", "mismatch", F.col("messages")[1]["content"].alias("asked"), F.col("messages")[2]["content"].alias("answer"))


@query("""
WITH p AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context, coalesce(text, '') AS quote FROM conversations)
SELECT conv_id, turn, CASE WHEN context = '' OR quote = '' THEN 0.35 ELSE least(1.0, 0.35 + CASE WHEN regexp_matches(context, '["“”]') THEN 0.35 ELSE 0.0 END
  + CASE WHEN ends_with(quote, '?') OR ends_with(quote, '!') OR ends_with(quote, '.') THEN 0.15 ELSE 0.0 END
  + CASE WHEN len(list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> '')) >= 4 THEN 0.1 ELSE 0.0 END) END::DOUBLE AS quality FROM p""")
def quote_boundary_quality(t):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", "turn", before.alias("c"), "text").select("conv_id", "turn", cues.boundary_quality(F.col("c"), F.col("text")).alias("quality"))


@query("""
WITH r AS (SELECT conv_id, turn, role, length(text) % 3 = 0 AS asks, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
a AS (SELECT r.conv_id, r.turn, r.i, b.role AS asked FROM r LEFT JOIN r b ON b.conv_id = r.conv_id AND b.i = r.i - 1 AND b.asks AND b.role <> '')
SELECT a.conv_id, a.turn, arg_max(e.role, e.i) AS answers FROM a LEFT JOIN r e ON e.conv_id = a.conv_id AND e.i BETWEEN a.i - 4 AND a.i - 1 AND a.asked IS NOT NULL AND e.role <> a.asked AND e.role <> '' GROUP BY a.conv_id, a.turn""")
def question_sandwich(t):
    return t("conversations").select("conv_id", "turn", passes.sandwich_speaker(F.col("role"), F.length("text") % 3 == 0, CHAPTER, LINE).alias("answers"))


@query("""
WITH l AS (SELECT conv_id, turn, role <> 'system' AS said, length(text) % 4 = 0 AS unsure, length(text) % 3 AS n, role, text FROM conversations),
w AS (SELECT *, lag(said) OVER o AS s1, lag(said, 2) OVER o AS s2, lead(said) OVER o AS s3, coalesce(lag(text) OVER o, '') AS before FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, CASE WHEN unsure THEN 0.62 ELSE 0.98 END::DOUBLE - CASE WHEN n > 1 THEN 0.06 ELSE 0 END::DOUBLE - CASE WHEN n <= 0 THEN 0.04 ELSE 0 END::DOUBLE - CASE WHEN coalesce(s1, false) THEN 0.05 ELSE 0 END::DOUBLE
  - CASE WHEN coalesce(s3, false) THEN 0.03 ELSE 0 END::DOUBLE AS c, coalesce(NOT s1, false) AS told FROM w),
m AS (SELECT *, CASE WHEN told AND contains(lower(before), lower(trim(role))) AND contains(' ' || lower(trim(before)) || ' ', ' said ') THEN CASE WHEN coalesce(s2, false) THEN least(c, 0.95) ELSE greatest(c, 0.99) END ELSE c END::DOUBLE AS d FROM b)
SELECT conv_id, turn, round(CASE WHEN NOT said THEN 1.0 ELSE greatest(0.0, least(1.0, d - CASE WHEN told AND contains(before, chr(10) || chr(10)) THEN 0.08 ELSE 0 END
  - CASE WHEN told AND len(list_filter(regexp_split_to_array(before, '\\s+'), lambda x: x <> '')) >= 24 THEN 0.08 ELSE 0 END)) END::DOUBLE, 6) AS confidence FROM m""")
def dialogue_confidence(t):
    size = F.length("text")
    said = F.concat(F.lit(" "), F.lower(F.trim("text")), F.lit(" ")).contains(" said ")
    found = evaluation.dialogue_confidence(F.col("role") != "system", size % 4 == 0, F.array_repeat(F.lit("x"), (size % 3).cast("int")), F.col("role"), F.col("text"), said, CHAPTER, LINE)
    return t("conversations").select("conv_id", "turn", F.round(found, 6).alias("confidence"))


@query("""
WITH r AS (SELECT user_id AS doc, event_id % 5 AS coref, CASE event_type WHEN 'purchase' THEN 'PROP' WHEN 'click' THEN 'NOM' ELSE 'PRON' END AS prop, event_id, 'n' || event_id % 7 AS text FROM events),
s AS (SELECT doc, coref, text, sum(CASE prop WHEN 'PROP' THEN 10000 WHEN 'NOM' THEN 1000 ELSE 1 END) AS w, min(event_id) AS place FROM r GROUP BY ALL)
SELECT doc, coref, arg_max(text, (w, -place)) AS name FROM s GROUP BY doc, coref""")
def cluster_names(t):
    prop = F.when(F.col("event_type") == "purchase", "PROP").when(F.col("event_type") == "click", "NOM").otherwise("PRON")
    rows = t("events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 5).alias("coref"), prop.alias("prop"), F.lit("PER").alias("cat"), F.col("event_id").alias("at"), F.concat(F.lit("n"), F.col("event_id") % 7).alias("text"))
    return evaluation.cluster_names(rows, "doc")


@query("""
WITH f AS (SELECT user_id, event_id % 5 AS coref, lower('The N' || event_id % 7) AS k, min(event_id) AS place FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, CAST(coref AS VARCHAR) AS coref, string_agg('The N' || substr(k, 6), ',' ORDER BY place) AS mentions FROM f GROUP BY user_id, coref""")
def nominal_mentions(t):
    rows = t("events").select("user_id", (F.col("event_id") % 5).cast("string").alias("coref"), F.when(F.col("event_type") == "click", "NOM").otherwise("PRON").alias("prop"), F.lit("PER").alias("cat"), F.col("event_id").alias("at"), F.concat(F.lit("The N"), F.col("event_id") % 7).alias("text"))
    return evaluation.nominal_mentions(rows, "user_id").withColumn("mentions", joined(F.col("mentions")))


@query("""
SELECT count(*) AS lines, count(*) FILTER (role = ['user', 'assistant'][length(text) % 2 + 1]) AS hits_1, count(*) FILTER (role IN ('user', 'assistant')) AS hits_2 FROM conversations""")
def guess_hits(t):
    a, b = F.lit("user"), F.lit("Assistant ")
    offered = F.when(F.length("text") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a))
    return evaluation.guess_hits(t("conversations"), F.col("role"), offered, (1, 2))


@query("""
SELECT doc_id, CAST(coalesce(sum(length(text) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM documents""")
def corpus_offsets(t):
    return evaluation.corpus_offsets(t("documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "offset")
