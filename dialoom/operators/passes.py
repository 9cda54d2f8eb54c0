"""Attribution passes over a chapter's chunks of dialogue and narration, which depend on the speakers found before.

What a chunk's own text says is worked out by Spark, row by row; the walk over a chapter, which only compares names, is one
fold per chapter. A chapter is one group; it holds names and flags of its chunks, no texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.cues import ATTRIBUTION, UNASSIGNED, _quoted
from dialoom.functions.scalars import let, prefix_sums

SHORT_NARRATION, STACK = 60, 5
VERBS = "|".join(dict.fromkeys(ATTRIBUTION))
PRONOUN = "(?:he|she|they)"


_CUT = "\x01"
OUTER = '"“” '
# What separates scenes, what a speaker calls itself, and an unknown subject before a verb.
BLANK_LINE, SCENE_MARK = r"\n\s*\n", r"(?m)^(?:[-*\u2014\u2013]\s*){3,}$"
FIRST_PERSON = r"(?iU)\b(I|I'm|I’ve|I'd|me|my|mine)\b"
NEW_SUBJECT = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"


def chunks(chapters: DataFrame, group: str, text: str) -> DataFrame:
    """(group, i, type, text, start, end, at, breaks, paragraph): a chapter cut at quotations that end on their own line, blank pieces left out.

    Offsets are code points of the whole piece; text is without quotation marks and blanks around it, and begins at `at`. breaks
    marks narration with a blank line or a line of marks between scenes; paragraph numbers the line in which a piece begins, -1 for a
    piece that begins with a line break.
    """
    body = F.translate(F.coalesce(F.col(text), F.lit("")), _CUT, " ")
    parts = F.split(F.regexp_replace(body, '(["“”].*?["“”])', f"{_CUT}$1{_CUT}"), _CUT)
    sums = lambda x, of: prefix_sums(F.transform(x, lambda p: of(p).cast("long")))
    lines = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    placed = let(parts, lambda x: F.zip_with(F.arrays_zip(x.alias("piece"), sums(x, F.length).alias("start")), sums(x, lines), lambda y, n: F.struct(y["piece"].alias("piece"), y["start"].alias("start"), n.cast("int").alias("line"))))
    rows = chapters.select(group, F.posexplode(F.filter(placed, lambda x: x["piece"].rlike(r"\S"))).alias("i", "x"))
    kind = F.when(F.col("x.piece").rlike('^["“”]'), "dialogue").otherwise("narration")
    text, start = F.btrim("x.piece", F.lit(OUTER)), F.col("x.start")
    breaks = (kind == "narration") & (F.col("x.piece").rlike(BLANK_LINE) | text.rlike(SCENE_MARK))
    at = start + F.length("x.piece") - F.length(F.ltrim("x.piece", F.lit(OUTER)))
    return rows.select(group, "i", kind.alias("type"), text.alias("text"), start, (start + F.length("x.piece")).alias("end"), at.alias("at"), breaks.alias("breaks"), F.when(F.col("x.piece").rlike(r"^[\r\n]"), -1).otherwise(F.col("x.line")).alias("paragraph"))


def tag_subjects(text: Column, names: Column) -> Column:
    """Lower-case names that stand before a verb of attribution, in order of their places; names: alternatives of a pattern."""
    pattern = F.concat(F.lit("(?i)\\b("), names, F.lit(f")\\b\\s+(?:{VERBS})\\b"))
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.lower)


def alternatives(names: Column) -> Column:
    """An array of names as one pattern, longer names first; one that never matches without names."""
    longer = F.array_sort(F.array_distinct(names), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.coalesce(F.nullif(F.array_join(F.transform(longer, _quoted), "|"), F.lit("")), F.lit("(?!x)x"))


def with_vocabulary(chunk_rows: DataFrame, group: str, aliases: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """chunks with map (lower-case name -> whom it names) and names (a pattern of all names known there).

    Besides the aliases (group, alias, name), or (alias, name) for all chapters, one book's cast, a chapter knows every capitalised subject of a verb of attribution from the narration
    on in which it first stands, but for blocked ones; a name is never taken from a later chunk.
    """
    known = [F.map_from_entries(F.collect_list(F.struct(F.lower("alias").alias("alias"), "name"))).alias("map"), F.collect_set("alias").alias("given")]
    if group in aliases.columns:
        rows = chunk_rows.join(aliases.groupBy(group).agg(*known), group, "left")
    else:
        rows = chunk_rows.join(F.broadcast(aliases.agg(*known)))  # one row
    rows = rows.withColumns({"map": F.coalesce("map", F.create_map().cast("map<string,string>")), "given": F.coalesce("given", F.array().cast("array<string>"))})
    found = F.regexp_extract_all("text", F.lit(rf"\b({NEW_SUBJECT})\b\s+(?:{VERBS})\b"), F.lit(1))
    fresh = F.filter(found, lambda x: ~F.lower(x).isin(*blocked) & F.try_element_at("map", F.lower(x)).isNull()) if blocked else F.filter(found, lambda x: F.try_element_at("map", F.lower(x)).isNull())
    # a subject counts where it comes first, so that what is gathered over a chapter is its vocabulary
    new = rows.where("type = 'narration'").select(group, "i", F.posexplode(fresh).alias("k", "name")).groupBy(group, F.lower("name").alias("low")).agg(F.min(F.struct("i", "k", "name")).alias("f"))
    new = new.groupBy(group, F.col("f.i").alias("i")).agg(F.array_sort(F.collect_list(F.struct("f.k", "f.name"))).alias("new"))
    so_far = Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(new.select(group, "i", F.transform("new", lambda x: x["name"]).alias("new")), [group, "i"], "left").withColumn("met", F.flatten(F.collect_list("new").over(so_far)))
    more = F.map_from_entries(F.transform("met", lambda x: F.struct(F.lower(x), x)))
    return rows.withColumns({"map": F.map_concat("map", more), "names": alternatives(F.concat("given", "met"))}).drop("given", "new", "met")


def attributed(
    chunk_rows: DataFrame, group: str, aliases: DataFrame, narrator: str = "Narrator", protagonist: str | None = None, persona: str | None = None, coref: DataFrame | None = None,
    blocked: tuple[str, ...] = (), guard: bool = True,
) -> DataFrame:
    """chunks (group, i, type, text, paragraph, breaks) and aliases (group, alias, name) -> group, i, speaker, rule of dialogue chunks.

    In order: a tag that says "I" (protagonist, if its tag names nobody else), a tag after it that says "I" or "we" (persona),
    a pronoun that opens the tag after or closes the one before, if coref (group, at, name) knows who stands there; these where
    they are given, and coref needs the chunks' `at`. Then the tag after a quotation in its paragraph, the tag before it, a tag between two quotations that names the earlier
    speaker, the quotation right before, a short narration between two that names nobody else, and suggestions from the
    latest names. A name stands for whom aliases say; see with_vocabulary() for names that a chapter brings. The latest names are
    those of speakers and of narration, in order; a break between scenes forgets them. Where nothing applies the speaker is Unknown,
    as is a blocked one (lower case). With a protagonist, one who says "I" and would be Unknown or the persona is the protagonist,
    and so is any other of these. With guard, who addresses a speaker by name is not that speaker if one stands right before.
    """
    rows = with_vocabulary(chunk_rows, group, aliases, blocked)
    said, told = F.col("text"), F.col("type") == "narration"
    found = lambda body, pattern: F.call_function("regexp_extract", body, pattern, F.lit(1))
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    tag = F.regexp_replace(said, r"^[, ]+", "")
    forward = either(found(tag, F.concat(F.lit("(?i)^\\s*("), F.col("names"), F.lit(f")\\s*(?:{VERBS})"))), F.regexp_extract(tag, rf"^\s*({NEW_SUBJECT})\s+(?i:{VERBS})\b", 1))
    backward = either(found(F.trim(said), F.concat(F.lit("(?i)("), F.col("names"), F.lit(f")\\s+(?:{VERBS})\\s*\\.?\\s*$"))), F.regexp_extract(F.trim(said), rf"({NEW_SUBJECT})\s+(?:{VERBS})\s*\.?\s*$", 1))
    who = lambda name: F.coalesce(F.try_element_at("map", F.nullif(F.lower(name), F.lit(""))), F.nullif(name, F.lit("")))
    if coref is None:
        rows = rows.withColumns({"refers": F.lit(None).cast("string"), "referred": F.lit(None).cast("string")})
    else:
        known = coref.groupBy(group, "at").agg(F.min("name").alias("name"))
        lead, before = rf"(?i)^([, ]*){PRONOUN}\s+(?:{VERBS})\b", rf"(?is)^(.*)\b{PRONOUN}\b\s*(?:{VERBS})\b"
        for name, pattern in (("refers", lead), ("referred", before)):
            place = F.when(told & said.rlike(pattern), F.col("at") + F.length(F.regexp_extract(said, pattern, 1)))
            rows = rows.withColumn("_at", place).join(known.select(group, F.col("at").alias("_at"), F.col("name").alias(name)), [group, "_at"], "left").drop("_at")
    mentioned = F.regexp_extract_all(said, F.concat(F.lit("(?i)\\b("), F.col("names"), F.lit(")\\b")), F.lit(1))
    rows = rows.select(
        group, "i", "type", "paragraph", "refers", "referred", said.rlike(rf"(?i)^\s*I\s+(?:{VERBS})\b").alias("mine"), said.rlike(rf"(?i)^[, ]*(?:I|we)\s+(?:{VERBS})\b").alias("ours"), F.when(told, who(forward)).alias("opens"), F.when(told, who(backward)).alias("closes"),
        F.when(told, F.transform(tag_subjects(said, F.col("names")), lambda n: F.col("map")[n])).alias("subjects"), (F.length("text") <= SHORT_NARRATION).alias("short"),
        F.when(told, F.transform(mentioned, who)).alias("mentions"), F.coalesce("breaks", F.lit(False)).alias("breaks"), (~told & said.rlike(FIRST_PERSON)).alias("self"),
        F.when(~told, who(found(said, F.concat(F.lit("^\\s*("), F.col("names"), F.lit(")\\s*,"))))).alias("addresses"),
    )

    def named(speaker: str) -> str:
        """speaker, or suggestions without blocked and repeated ones; a single one left is the speaker."""
        if not (speaker.startswith("[") and speaker.endswith("]")):
            return "Unknown" if speaker.strip().lower() in blocked else speaker
        left = {x.strip().lower(): x.strip() for x in reversed(speaker[1:-1].split("|")) if x.strip() and x.strip().lower() not in blocked}
        kept = [x for x in dict.fromkeys(x.strip() for x in speaker[1:-1].split("|")) if left.get(x.lower()) == x]
        return f"[{'|'.join(kept)}]" if len(kept) > 1 else kept[0] if kept else "Unknown"

    def walk(chapter: pd.DataFrame) -> pd.DataFrame:
        found, stack, of = [], [], chapter.sort_values("i").to_dict("records")

        def latest(name):
            if name and name not in UNASSIGNED and not name.startswith("[") and (not stack or stack[0] != name):
                stack[:] = [name, *stack][:STACK]

        for k, c in enumerate(of):
            if c["type"] != "dialogue":
                c["speaker"] = narrator
                if c["breaks"]:
                    stack.clear()
                for name in c["mentions"] if c["mentions"] is not None else ():
                    latest(name)
                continue
            speaker, rule = _speaker(k, of, stack, narrator, protagonist, persona)
            speaker = "Unknown" if speaker.strip().lower() in blocked else speaker
            if protagonist and speaker in (persona or narrator, "Unknown"):
                speaker, rule = protagonist, "first_person_override" if c["self"] else rule
            if guard and c["addresses"] and c["addresses"] == speaker:
                speaker = _contiguous(k, of) or speaker
            c["speaker"] = speaker = named(speaker)
            latest(speaker)
            found.append((c[group], c["i"], speaker, rule))
        return pd.DataFrame(found, columns=[group, "i", "speaker", "rule"])

    kind = rows.schema[group].dataType.simpleString()
    return rows.groupBy(group).applyInPandas(walk, f"{group} {kind}, i int, speaker string, rule string")


def _same(of: list[dict], k: int, other: int) -> dict | None:
    """The other chunk, if it shares the paragraph of the k-th."""
    c = of[other] if 0 <= other < len(of) else None
    return c if c is not None and c["paragraph"] == of[k]["paragraph"] >= 0 else None


def _contiguous(k: int, of: list[dict]) -> str | None:
    c = _same(of, k, k - 1)
    return c["speaker"] if c and c["type"] == "dialogue" and c["speaker"] not in UNASSIGNED and not c["speaker"].startswith("[") else None


# The names of the rules.
def _speaker(k: int, of: list[dict], stack: list[str], narrator: str, protagonist: str | None, persona: str | None) -> tuple[str, str]:
    before, after, two = (_same(of, k, k + n) for n in (-1, 1, -2))
    ahead, behind = (c if c and c["type"] == "narration" else None for c in (after, before))
    tag = ahead or behind
    if protagonist and tag and tag["mine"]:
        other = next(iter(tag["subjects"]), None)
        if not other or other.lower() == protagonist.lower():
            return protagonist, "0p_protagonist_first_person"
    if persona and ahead and ahead["ours"]:
        return persona, "0a_narrator_identity"
    if ahead and ahead["refers"]:
        return ahead["refers"], "1_coreference"
    if behind and behind["referred"]:
        return behind["referred"], "1b_backward_coreference"
    if ahead and ahead["opens"]:
        return ahead["opens"], "2_forward_explicit_tags"
    if behind and behind["closes"]:
        return behind["closes"], "2b_backward_explicit_tags"
    earlier = two["speaker"] if behind and two and two["type"] == "dialogue" and two["speaker"] not in UNASSIGNED else None
    subjects = list(behind["subjects"]) if earlier else []
    if earlier and earlier in subjects:
        return earlier, "4b_tag_continuation"
    if x := _contiguous(k, of):
        return x, "4_contiguous_dialogue"
    if earlier and behind["short"] and (not subjects or subjects[0] is None or subjects[0].lower() == earlier.lower()):
        return earlier, "4c_carry_across_short_narration"
    if not stack:
        return "Unknown", "none"
    if len(stack) > 1 and stack[1] != stack[0]:
        return f"[{stack[1]}|{stack[0]}]", "5_suggest_alternatives"
    return (f"[{stack[0]}|{narrator}]" if stack[0] != narrator else f"[{narrator}|Unknown]"), "5_suggest_alternatives"


def sandwich_speaker(speaker: Column, asks: Column, group, order, before: int = 4) -> Column:
    """Who answers a question: if the line before asks, the latest speaker among the `before` lines ahead but the one who asked."""
    w = Window.partitionBy(*group).orderBy(*order)
    asked = F.lag(F.when(asks & (F.coalesce(speaker, F.lit("")) != ""), speaker)).over(w)
    earlier = F.reverse(F.collect_list(F.nullif(speaker, F.lit(""))).over(w.rowsBetween(-before, -1)))
    return F.when(asked.isNotNull(), F.get(F.filter(earlier, lambda x: x != asked), F.lit(0)))


def asks(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).endswith("?"), F.lit(False))
