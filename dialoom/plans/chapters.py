"""Queries over chapters made of conversations: each turn's first sentence, set in narration that names nations as its cast."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import cues, quoting
from dialoom.operators import assist, narration, passes, ranking
from dialoom.plans.registry import query

#: How a turn becomes a paragraph, by turn: {s} is its first sentence, {a} and {b} are two of the cast.
FORMS = (
    "“{s},” {a} said.", "{a} replied, “{s}”", "“{s},” the old man muttered softly.", "“{s},” she asked. “{s}?”", "{a} walked to the door. “{s}”", "“I am {a}, friend.”", "“{s},”",
    "{a}, the captain, looked up and nodded.", "“{s}?”", "“{s},” the captain growled.", "“This is {b}.” the other priest hissed.", "Then {b} turned, and {a} stood by. “{s}”", "{a} shouted. {b} added nothing.",
    "Old Tom whispered. “{s},” he went on, “{s}”", "“{a}, {s},” {b} asked. “{s}” {a} nodded. “{s}”", "“{s},” Old Tom replied. “{s}” Nobody looked, and nobody at all of those who stood there said a word of it. “{s}”",
)
_SENTENCE = r"trim(regexp_replace(split_part(trim(coalesce(text, '')), '.', 1), '[\"“”\s]+', ' ', 'g'))"
CHAPTERS = f"""cast_ AS (SELECT n_nationkey AS ord, lower(n_name) AS id, upper(n_name[1]) || translate(lower(n_name[2:]), '_ 0123456789', 'xyabcdefghij') AS name FROM nation),
p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, {_SENTENCE} AS s FROM conversations),
told AS (SELECT conv_id, CAST(idx AS INT) AS idx, CASE CAST((conv_id * 5 + turn) % {len(FORMS)} AS INT) {" ".join(f"WHEN {i} THEN " + "replace(replace(replace('" + f + "', '{s}', s), '{a}', a.name), '{b}', b.name)" for i, f in enumerate(FORMS))} END AS text
  FROM p JOIN cast_ a ON a.ord = (conv_id + turn) % 25 JOIN cast_ b ON b.ord = (conv_id * 3 + turn * 7) % 25)"""


def cast(t):
    """Nations under names of letters only."""
    name = F.initcap(F.translate(F.lower("n_name"), "_ 0123456789", "xyabcdefghij"))
    return t("nation").select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))


def chapters(t):
    """(conv_id, idx, text): a paragraph per turn."""
    said = F.trim(F.regexp_replace(F.split_part(F.trim(F.coalesce("text", F.lit(""))), F.lit("."), F.lit(1)), r'["“”\s]+', " "))
    # turns of a conversation are numbered from 0 without gaps
    rows = t("conversations").select("conv_id", "turn", said.alias("s"), ((F.col("conv_id") + F.col("turn")) % 25).alias("_a"), ((F.col("conv_id") * 3 + F.col("turn") * 7) % 25).alias("_b"))
    for side in ("a", "b"):
        rows = rows.join(cast(t).select(F.col("ord").alias(f"_{side}"), F.col("name").alias(side)), f"_{side}")
    form = F.element_at(F.array(*map(F.lit, FORMS)), ((F.col("conv_id") * 5 + F.col("turn")) % len(FORMS) + 1).cast("int"))
    for key in "sab":
        form = F.replace(form, F.lit(f"{{{key}}}"), F.col(key))
    return rows.select("conv_id", F.col("turn").cast("int").alias("idx"), form.alias("text"))


def quoted_lines(t, paragraphs):
    """(conv_id, i, text, speaker, paragraph, certain): every quotation, with a speaker of the cast and one place in nine unsure."""
    rows = paragraphs.select("conv_id", "idx", F.posexplode(F.regexp_extract_all("text", F.lit(quoting.QUOTE), F.lit(1))).alias("k", "text"))
    who = cast(t).select(F.col("ord").alias("_w"), F.col("id").alias("speaker"))
    rows = rows.withColumn("_w", (F.col("conv_id") + F.col("idx") * 2) % 25).join(who, "_w")
    return rows.select("conv_id", (F.col("idx") * 8 + F.col("k")).alias("i"), "text", "speaker", F.col("idx").alias("paragraph"), ((F.col("conv_id") + F.col("idx")) % 9 != 0).alias("certain"))


_LONGEST = "|".join(sorted(quoting.VERBS, key=lambda v: -len(v)))
_VERB = lambda x: f"nullif(regexp_extract({x}, '(?i)\\b({_LONGEST})\\b', 1), '')"
_HEAD = lambda x: f"trim(string_split_regex(trim({x}, ' ,;:-—–'), '[.!?]')[1])"
_ACTS = lambda m: f"regexp_matches({m}, '(?i)(ed|ing)$|^({'|'.join((*quoting.VERBS, *cues.REACTION))})$')"
_Q = lambda p: p.replace("'", "''")
_ACTING = lambda x: f"({_ACTS('regexp_extract(' + _HEAD(x) + ', ' + chr(39) + _Q(quoting.NAME_ACTS) + chr(39) + ', 2)')} OR {_ACTS('regexp_extract(' + _HEAD(x) + ', ' + chr(39) + _Q(quoting.ROLE_ACTS) + chr(39) + ', 2)')})"
_SAYS = lambda x: f"({_VERB(x)} IS NOT NULL OR {_ACTING(x)})"


@query(f"""
WITH {CHAPTERS},
q AS (SELECT conv_id, idx, regexp_extract_all(text, '(?s)["“](.+?)["”]', 1) AS q, string_split_regex(text, '(?s)["“].+?["”]') AS s FROM told),
u AS (SELECT conv_id, idx, unnest(range(1, len(q) + 1)) AS k, q, s FROM q),
v AS (SELECT conv_id, idx, CAST(k - 1 AS INT) AS k, trim(q[k]) AS quote, trim(s[k]) AS pre, trim(s[k + 1]) AS suf FROM u),
w AS (SELECT *, CASE WHEN {_SAYS('suf')} THEN 'after' WHEN {_SAYS('pre')} THEN 'before' ELSE 'none' END AS position FROM v)
SELECT conv_id, idx, k, quote, position, verb, CASE WHEN lower(verb) IN ({', '.join(map(repr, cues.SPEECH))}) THEN 'speech' WHEN verb IS NOT NULL THEN 'attribution' END AS kind,
  coalesce((SELECT string_agg(name, ',' ORDER BY ord) FROM cast_ WHERE regexp_matches(quote, '(?i)\\b' || name || '\\b')), '') AS mentions
FROM (SELECT *, {_VERB("CASE WHEN position = 'after' THEN suf ELSE pre END")} AS verb FROM w)""")
def quoted_cues(t):
    """The quotations of a chapter's paragraphs with where their cues are, the cues' verbs, and whom they mention."""
    names = cast(t).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    rows = chapters(t).join(F.broadcast(names))  # one row
    found = rows.select("conv_id", "idx", F.explode(quoting.quote_structure(F.col("text"), F.col("names"))).alias("u")).select("conv_id", "idx", "u.*")
    return found.select("conv_id", "idx", "k", "quote", "position", "verb", "kind", F.array_join("mentions", ",").alias("mentions"))


@query()
def assisted_lines(t):
    """Speakers suggested by rules, with surfaces that earlier lines of a chapter have explained: a fold, without SQL."""
    paragraphs = chapters(t)
    whole = paragraphs.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    memory = assist.scene_aliases(whole, cast(t), "conv_id")
    found = assist.assist(quoted_lines(t, paragraphs), paragraphs, cast(t), memory, "conv_id")
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query()
def assist_totals(t):
    return assist.assist_summary(assisted_lines(t).withColumn("reasons", F.split("reasons", ",")), "conv_id")


_VERBS = "|".join(dict.fromkeys(cues.ATTRIBUTION))
_NEW = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b\s+(?:" + _VERBS + r")\b"
_KNOWN = "coalesce(list_filter(known, lambda x: lower(x) = lower({0}))[1], {0})"


def _all(pattern: str) -> str:
    """The names that a pattern around `pat` finds in a body, as known."""
    return f"list_transform(regexp_extract_all(body, {pattern}, 1), lambda n: {_KNOWN.format('n')})"


def _one(pattern: str, other: str) -> str:
    found = f"coalesce(nullif(regexp_extract({{0}}, {pattern}, 1), ''), nullif(regexp_extract({{0}}, '{other}', 1), ''))"
    return found


_OPENS = _one(rf"'(?i)^\s*(' || pat || ')\s*(?:{_VERBS})'", rf"^\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?i:{_VERBS})\b").format("ltrim(body, ', ')")
_CLOSES = _one(rf"'(?i)(' || pat || ')\s+(?:{_VERBS})\s*\.?\s*$'", rf"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:{_VERBS})\s*\.?\s*$").format("trim(body)")
_BARE = "('Unassigned', 'Unknown')"


@query(rf"""
WITH RECURSIVE {CHAPTERS},
w AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY idx) AS text FROM told GROUP BY conv_id),
e AS (SELECT conv_id, text, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT *, string_split(regexp_replace(text, '(["“”].*?["“”])', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM w)),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS INT) AS i, NOT regexp_matches(piece, '^["“”]') AS told, trim(piece, '"“” ') AS body,
    CASE WHEN piece LIKE chr(10) || '%' THEN -1 ELSE length(regexp_replace(substr(text, 1, CAST(start AS BIGINT)), '[^\n]', '', 'g')) END AS par, regexp_matches(piece, '\n\s*\n') AS breaks
  FROM o WHERE regexp_matches(piece, '\S')),
given AS (SELECT list(name) AS names FROM cast_),
new AS (SELECT conv_id, lower(n) AS low, min(struct_pack(i := i, k := k, n := n)) AS f FROM (
    SELECT conv_id, i, unnest(x) AS n, generate_subscripts(x, 1) AS k FROM (SELECT conv_id, i, regexp_extract_all(body, '{_NEW}', 1) AS x FROM c WHERE told))
  WHERE NOT EXISTS (SELECT 1 FROM cast_ WHERE lower(name) = lower(n)) GROUP BY ALL),
v AS (SELECT c.*, list_concat(names, coalesce((SELECT list(f.n) FROM new WHERE new.conv_id = c.conv_id AND f.i <= c.i), [])) AS known FROM c, given),
b AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(known, lambda x: struct_pack(l := -length(x), x := x))), lambda y: y.x), '|') AS pat FROM v),
x AS (SELECT *, {_KNOWN.format(_OPENS)} AS opens, {_KNOWN.format(_CLOSES)} AS closes,
    {_all(f"'(?i)\\b(' || pat || ')\\b\\s+(?:{_VERBS})\\b'")} AS subjects, CASE WHEN told THEN {_all("'(?i)\\b(' || pat || ')\\b'")} ELSE [] END AS mentions,
    CASE WHEN NOT told THEN {_KNOWN.format("nullif(regexp_extract(body, '^\\s*(' || pat || ')\\s*,', 1), '')")} END AS addresses FROM b),
n AS (SELECT conv_id, i, told, mentions, breaks, addresses,
    CASE WHEN lead(told) OVER w AND lead(par) OVER w = par AND par >= 0 THEN lead(opens) OVER w END AS opens, coalesce(lag(told) OVER w AND lag(par) OVER w = par AND par >= 0, false) AS behind,
    coalesce(NOT lag(told) OVER w AND lag(par) OVER w = par AND par >= 0, false) AS beside, coalesce(NOT lag(told, 2) OVER w AND lag(par, 2) OVER w = par AND par >= 0, false) AS two,
    lag(closes) OVER w AS closes, lag(subjects) OVER w AS subjects, lag(length(body)) OVER w <= 60 AS short FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f AS (
  SELECT DISTINCT conv_id, -1 AS i, true AS told, CAST([] AS VARCHAR[]) AS st, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS speaker, CAST(NULL AS VARCHAR) AS rule FROM n
  UNION ALL
  SELECT conv_id, i, told, CASE WHEN told THEN list_filter(q, lambda y, j: j = 1 OR q[j - 1] <> y) WHEN sp IN {_BARE} OR sp LIKE '[%' OR st[-1] = sp THEN st ELSE list_append(st, sp) END,
    CASE WHEN told THEN 'Narrator' ELSE sp END, s1, CASE WHEN told THEN NULL ELSE sp END, CASE WHEN told THEN NULL ELSE ru END
  FROM (SELECT *, list_concat(CASE WHEN breaks THEN CAST([] AS VARCHAR[]) ELSE st END, mentions) AS q, CASE WHEN addresses = s0 THEN coalesce(near, s0) ELSE s0 END AS sp FROM (
    SELECT *, CASE WHEN opens IS NOT NULL THEN opens WHEN behind AND closes IS NOT NULL THEN closes WHEN ru = '4b_tag_continuation' OR ru LIKE '4c%' THEN earlier WHEN near IS NOT NULL THEN near
        WHEN len(st) = 0 THEN 'Unknown' WHEN len(st) > 1 THEN '[' || st[-2] || '|' || st[-1] || ']' ELSE '[' || st[-1] || '|Narrator]' END AS s0 FROM (
      SELECT *, CASE WHEN opens IS NOT NULL THEN '2_forward_explicit_tags' WHEN behind AND closes IS NOT NULL THEN '2b_backward_explicit_tags' WHEN list_contains(subjects, earlier) THEN '4b_tag_continuation'
          WHEN near IS NOT NULL THEN '4_contiguous_dialogue' WHEN earlier IS NOT NULL AND short AND (len(subjects) = 0 OR lower(subjects[1]) = lower(earlier)) THEN '4c_carry_across_short_narration'
          WHEN len(st) = 0 THEN 'none' ELSE '5_suggest_alternatives' END AS ru FROM (
        SELECT n.*, f.st, f.s1, CASE WHEN behind AND two AND f.s2 NOT IN {_BARE} THEN f.s2 END AS earlier, CASE WHEN beside AND f.s1 NOT IN {_BARE} AND f.s1 NOT LIKE '[%' THEN f.s1 END AS near
        FROM f JOIN n ON n.conv_id = f.conv_id AND n.i = f.i + 1)))))
SELECT conv_id, i, speaker, rule FROM f WHERE NOT told""")
def attributed_chapters(t):
    """Who says each quotation of a chapter, by the passes: explicit tags, carried speakers, latest names, and names that a chapter brings."""
    whole = chapters(t).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    names = cast(t).select(F.col("name").alias("alias"), "name")
    return passes.attributed(passes.chunks(whole, "conv_id", "text"), "conv_id", names)


_TAG = lambda x: f"(len(regexp_extract_all({x}, '\\S+')) <= 12 AND regexp_matches(lower({x}), '\\b({'|'.join(cues.SPEECH)})\\b'))"
_EDGES = lambda x: f"regexp_replace({x}, '^[\\s\"''“”‘’`]+|[\\s\"''“”‘’`]+$', '', 'g')"
_BARE_TAG = lambda x: f"trim(regexp_replace({_EDGES(x)}, '[.,;:!?…]+$', ''))"


@query(f"""
WITH {CHAPTERS},
w AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY idx) AS text FROM told GROUP BY conv_id),
e AS (SELECT conv_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT *, string_split(regexp_replace(text, '(["“”].*?["“”])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM w)),
c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS INT) AS i, NOT regexp_matches(piece, '^["“”]') AS told, trim(piece, '"“” ') AS body FROM e WHERE regexp_matches(piece, '\\S')),
n AS (SELECT *, CASE WHEN lag(told) OVER w AND {_TAG('lag(body) OVER w')} THEN {_BARE_TAG('lag(body) OVER w')} END AS pre, CASE WHEN lead(told) OVER w AND {_TAG('lead(body) OVER w')} THEN {_BARE_TAG('lead(body) OVER w')} END AS suf FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, i, trim(concat_ws(' ', CASE WHEN pre IS NULL THEN NULL WHEN regexp_matches(pre, '[.!?]$') THEN pre ELSE pre || '.' END, body, nullif(suf, ''))) AS text FROM n WHERE NOT told""")
def tagged_lines(t):
    """Quotations of a chapter with the short tags of narration that stand right before and after them."""
    whole = chapters(t).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    speaker = F.when(F.col("type") == "narration", narration.NARRATOR).otherwise("somebody")
    lines = passes.chunks(whole, "conv_id", "text").select("conv_id", "i", "text", speaker.alias("speaker"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return narration.tagged_texts(lines, whole, "conv_id")


def _pool(x: str) -> str:
    """One of seven names, in SQL of both engines, by a whole number."""
    names = ("Narrator", "he", "Ann", "Bo", "Cid", "Dee", "Unknown man")
    return f"CASE CAST(floor({x}) AS BIGINT) % 7 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(names))} END"


_SOMETIMES = lambda when, x: f"CASE WHEN {when} THEN {x} END"
#: What is known of an order's line, as arithmetic on its keys that both engines read alike.
LINE_SIGNALS = {
    "predicted": _pool("c"), "legacy": _pool("c / 3"), "previous": _SOMETIMES("k % 5 <> 0", _pool("k / 2")), "following": _SOMETIMES("k % 7 <> 0", _pool("k / 3")), "fallback": "k % 6 = 0", "exact": "k % 2 = 0",
    "boundary": "CAST(k % 10 AS DOUBLE) / 10", "speech_verb": "k % 3 = 0", "coref": "k % 4 = 0", "alias_strength": "CAST(k % 5 AS DOUBLE) / 4", "addressed": _SOMETIMES("k % 3 = 0", _pool("k / 5")),
    "attributed": _SOMETIMES("k % 8 = 0", _pool("k / 11")), "recent": _SOMETIMES("k % 5 = 1", _pool("k / 13")), "previous_paragraph": _SOMETIMES("k % 5 = 2", _pool("k / 17")),
    "gender": "CASE k % 6 WHEN 1 THEN 'male' WHEN 2 THEN 'Female ' WHEN 3 THEN '' END", "returning": "k % 2 = 1", "continues": "k % 9 = 0", "question": "k % 4 < 2", "next_legacy": _pool("k / 4"),
    "descriptor": _SOMETIMES("k % 10 = 3", _pool("k / 19")), "post_quote": _SOMETIMES("k % 9 = 4", _pool("k / 23")), "sibling": _SOMETIMES("k % 11 = 5", _pool("k / 29")),
}
_N = lambda c: f"lower(trim(coalesce({c}, '')))"
_GENERIC = lambda c: f"(regexp_matches({_N(c)}, '^(|{'|'.join(cues.GENERIC)})$') OR {_N(c)} LIKE 'unknown%')"
_IS = lambda c: f"key = {_N(c)}"
_ONE = lambda c: f"{_N(c)} <> '' AND {_IS(c)}"
_FREE = f"(coalesce(nullif({_N('attributed')}, ''), nullif({_N('post_quote')}, '')) IS NULL OR key = coalesce(nullif({_N('attributed')}, ''), nullif({_N('post_quote')}, '')))"
_SOMEBODY, _TWO = "key <> 'narrator'", "others >= 2"
_SEX = "CASE key WHEN 'ann' THEN 'female' WHEN 'bo' THEN 'male' WHEN 'cid' THEN 'male' WHEN 'dee' THEN 'female' END"
_STEPS = (  # condition, reason, delta, in the order in which they are added
    (f"{_IS('predicted')} AND {_FREE}", "parser_match", "CASE WHEN exact THEN 0.2::DOUBLE ELSE 0.08::DOUBLE END"), (f"{_IS('legacy')} AND {_SOMEBODY} AND {_FREE}", "legacy_match", "0.16"),
    (f"{_IS('legacy')} AND {_SOMEBODY} AND {_FREE} AND (fallback OR {_GENERIC('predicted')})", "legacy_anchor_boost", "0.1"), (f"{_ONE('previous')} AND continues", "same_paragraph_continuation", "0.4"),
    (f"{_ONE('previous')} AND NOT continues", "prev_continuity", "0.1"), (_ONE("following"), "next_continuity", "0.1"), (_ONE("sibling"), "paragraph_sibling_confirmed", "0.3"),
    (f"{_ONE('previous')} AND {_ONE('following')}", "two_sided_continuity", "0.08"), (f"{_IS('predicted')} AND coref", "coref_support", "0.08"), (f"{_IS('predicted')} AND alias_strength > 0", "alias_strength", "alias_strength * 0.08::DOUBLE"),
    (f"{_IS('descriptor')} AND {_SOMEBODY}", "learned_descriptor_match", "0.4"), (f"{_ONE('attributed')} AND {_SOMEBODY}", "post_quote_attribution", "0.4"), (f"{_ONE('post_quote')} AND {_SOMEBODY}", "post_quote_mention", "0.4"),
    (f"{_ONE('recent')} AND {_SOMEBODY}", "recent_named_mention", "0.16"), (f"{_ONE('previous_paragraph')} AND {_SOMEBODY}", "previous_paragraph_named_mention", "0.16"), ("true", "", "boundary * 0.08::DOUBLE"), ("speech_verb", "speech_verb", "0.06"),
    (f"fallback AND {_IS('predicted')}", "fallback_penalty", "-0.1"), (f"specific AND {_GENERIC('key')}", "generic_label_penalty", "-0.2"), (f"{_ONE('addressed')} AND {_SOMEBODY} AND {_TWO}", "addressed_target_penalty", "-0.18"),
    (f"k % 4 = 1 AND key IN (lower({_pool('k')}), lower({_pool('k / 7')})) AND {_SOMEBODY} AND {_TWO}", "self_name_mention_penalty", "-0.15"), (f"{_N('gender')} <> '' AND {_SEX} = {_N('gender')}", "context_gender_match", "0.18"),
    (f"{_N('gender')} <> '' AND {_SEX} <> {_N('gender')}", "context_gender_conflict", "-0.34"), (f"\"returning\" AND question AND {_ONE('next_legacy')} AND {_SOMEBODY} AND {_TWO}", "question_next_speaker_penalty", "-0.18"),
)


@query(f"""
WITH named AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_linenumber % 3 = 0 THEN ' ' || upper({_pool('l_suppkey')}) ELSE {_pool('l_suppkey')} END AS n FROM lineitem),
firsts AS (SELECT k, lower(trim(n)) AS key, min(struct_pack(i := i, n := n)) AS f FROM named GROUP BY ALL),
o AS (SELECT k, {', '.join(f'{x} AS "{n}"' for n, x in LINE_SIGNALS.items())} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),
j AS (SELECT o.*, key, f AS i, trim(f.n) AS name, count(*) FILTER (key <> 'narrator') OVER (PARTITION BY k) AS others, bool_or(key <> 'narrator' AND NOT {_GENERIC('key')}) OVER (PARTITION BY k) AS specific FROM o JOIN firsts USING (k)),
s AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for c, r, _ in _STEPS)}], lambda x: x <> '') AS reasons,
  greatest(0.02::DOUBLE, least(0.98::DOUBLE, 0.38::DOUBLE{''.join(f" + CASE WHEN {c} THEN ({d})::DOUBLE ELSE 0 END" for c, _, d in _STEPS)})) AS score FROM j),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY k ORDER BY score DESC, i)),
t AS (SELECT *, score - coalesce(next, 0) AS margin, len(list_intersect(reasons, [{', '.join(repr(x) for x in ranking.HARD)}])) AS hard FROM r WHERE r = 1)
SELECT k, name AS chosen, score AS top, margin, CAST(hard AS INT) AS hard, array_to_string(reasons, ',') AS reasons,
  fallback OR score < 0.74::DOUBLE OR margin < 0.14::DOUBLE OR list_contains(reasons, 'question_next_speaker_penalty') OR list_contains(reasons, 'context_gender_conflict')
    OR ({_GENERIC('name')} AND specific) OR (hard = 0 AND score < 0.8::DOUBLE) AS suggestion,
  (SELECT string_agg(name, ',' ORDER BY x.r) FROM r x WHERE x.k = t.k) AS ranked FROM t""")
def ranked_speakers(t):
    """Candidates of an order's lines ranked by everything that is known of it, with the choice and whether it is only a suggestion."""
    name = F.expr(f"CASE WHEN l_linenumber % 3 = 0 THEN ' ' || upper({_pool('l_suppkey')}) ELSE {_pool('l_suppkey')} END")
    named = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("n")))), lambda x: x["n"]).alias("candidates"))
    rows = named.join(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "k")
    fields = {n: F.expr(x) for n, x in LINE_SIGNALS.items()}
    fields["mentions"] = F.when(F.col("k") % 4 == 1, F.array(F.expr(_pool("k")), F.expr(_pool("k / 7"))))
    fields["genders"] = F.create_map(*(F.lit(x) for x in ("ann", "female", "bo", "male", "cid", "male", "dee", "female")))
    names = [f.split(" ")[0] for f in ranking.SIGNALS.split(", ")]
    rows = rows.select("k", "candidates", F.struct(*(fields[n].alias(n) for n in names)).alias("signals"))
    found = rows.select("k", ranking.decision(F.col("candidates"), F.col("signals")).alias("d")).select("k", "d.*")
    ranked = F.array_join(F.transform("ranked", lambda x: x["name"]), ",")
    return found.select("k", "chosen", "top", "margin", "hard", F.array_join(F.col("ranked")[0]["reasons"], ",").alias("reasons"), "suggestion", ranked.alias("ranked"))
