"""Quotations of a paragraph and who their surroundings name, as Column expressions over a text and an array of known names.

A cue is what a stretch of narration beside a quotation says about its speaker: a verb of attribution, a surface (a name, a role or
a pronoun that stands where its subject does) and a known name. A null or blank stretch has no cue.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import cues
from dialoom.functions.scalars import let
from dialoom.functions.text import sentence

# Words that end a surface, words that may follow it, and the patterns of names, roles and subjects, in order.
BREAKS = ("as", "because", "but", "even if", "if", "since", "than", "that", "when", "where", "while", "who", "with")
TRAILING = ("again", "calmly", "just", "only", "openly", "quietly", "sharply", "simply", "slowly", "softly", "still")
QUOTE = '(?s)["“](.+?)["”]'
EDGES = " ,;:-—–"
PLAIN_NAME = r"[A-Z][A-Za-z'\-]*(?:\s+[A-Z][A-Za-z'\-]*){0,3}"
NAME = r"[A-Z][A-Za-z'’\-]*(?:\s+[A-Z][A-Za-z'’\-]*){0,3}"
LATER_NAME = r"[A-Z][A-Za-z'â€™\-]*(?:\s+[A-Z][A-Za-z'â€™\-]*){0,3}"
ROLE = r"(?:the|a|an)\s+[A-Za-z][A-Za-z'’\-]*(?:\s+[A-Za-z][A-Za-z'’\-]*){0,6}"
LATE_WORDS = rf"(?:\s+(?:{'|'.join(TRAILING)}))*$"
LEADING = rf"^({PLAIN_NAME})\s+[a-z][A-Za-z'\-]*\b"
ROLE_OF_NAME = rf"((?:the|a|an)\s+[A-Za-z][A-Za-z'\-]*(?:\s+[A-Za-z][A-Za-z'\-]*){{0,3}})\s+of\s+(?:(?:the|a|an)\s+)?{PLAIN_NAME}$"
APPOSITION = rf"({NAME})\s*,\s*[^.!?]{{0,80}}$"
NAME_AT_END, ROLE_AT_END = rf"({NAME}){LATE_WORDS}", rf"(?i)({ROLE}){LATE_WORDS}"
FIRST_WORDS = r"(?i)^([A-Z][A-Za-z'’\-]*(?:\s+[A-Z][A-Za-z'’\-]*){0,3})"
SUBJECT = r"(?i)(?:(?:the|a|an)\s+)?[a-zA-Z][a-zA-Z'’\-]*+(?:\s++[a-zA-Z][a-zA-Z'’\-]*+){0,4}+"
NAME_ACTS, ROLE_ACTS = rf"^({PLAIN_NAME})\s+([a-z][A-Za-z'\-]*)\b", r"(?i)^((?:[A-Z][A-Za-z'’\-]*|(?:the|a|an))(?:\s+[A-Za-z][A-Za-z'’\-]*){0,5})\s+([A-Za-z][A-Za-z'’\-]*)\b"

VERBS = tuple(v for v in dict.fromkeys(cues.ATTRIBUTION) if v not in cues.REACTION)
_SAID = "|".join(sorted(VERBS, key=lambda v: -len(v)))


def _bare(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(EDGES))


def _blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def surface(text: Column) -> Column:
    """text before the first word that breaks a surface, without the words that may follow one; null if nothing is left."""
    held = F.regexp_extract(_bare(text), rf"(?is)^(.+?)(?: (?:{'|'.join(BREAKS)}) .*)?$", 1)
    words = F.array_join(F.filter(F.split(_bare(held), " "), lambda w: w != ""), " ")
    return _some(F.regexp_replace(words, rf"(?i)(?:(?:^| )(?:{'|'.join(TRAILING)}))+$", ""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches."""
    return _some(F.regexp_extract(text, f"(?U){pattern}", group))


def _last_subject(tail: Column) -> Column:
    every = F.regexp_extract_all(_bare(tail), F.lit(rf"(?U)(?<![\p{{L}}\p{{N}}])(?:{SUBJECT})(?![\p{{L}}\p{{N}}])"), F.lit(0))
    last = F.try_element_at(every, F.lit(-1))
    said = lambda x: F.lower(x).isin("he", "she", "they")
    names = F.regexp_extract_all(F.regexp_extract(tail, r"(?is)^(.*)\b(?:he|she|they)\b", 1), F.lit(rf"(?U)\b({LATER_NAME})\b"), F.lit(1))
    return _some(F.trim(F.when(said(last), F.coalesce(F.try_element_at(names, F.lit(-1)), last)).otherwise(last)))


def surface_before(text: Column) -> Column:
    """The surface that stands before a verb: of the last sentence, a name that leads it, a role of a name, a name set off by a comma,
    a name or a role at the end, else its last subject."""
    last = lambda t: _blanks(F.element_at(F.split(t, r"(?U)[.!?]\s+", -1), -1))

    def of(tail: Column) -> Column:
        leads = F.when(tail.rlike(r"(?iU)\b(?:he|she|they)\s*$") | ~F.contains(F.lower(tail), F.lit(" as ")), _found(tail, LEADING))
        tries = [leads, *(_found(tail, p) for p in (ROLE_OF_NAME, APPOSITION, NAME_AT_END, ROLE_AT_END))]
        chosen = F.coalesce(*tries)
        return F.when(tail == "", None).when(chosen.isNotNull(), surface(chosen)).otherwise(_last_subject(tail))

    return let(last(_bare(text)), of)


def surface_after(text: Column) -> Column:
    """The surface that stands after a verb: the first words of the sentence, four at most."""

    def of(head: Column) -> Column:
        first = _found(head, FIRST_WORDS)
        inside = _some(F.trim(F.regexp_extract(F.split(_bare(head), "[,.!?;:]", -1)[0], f"(?U){SUBJECT}", 0)))
        return F.when(head == "", None).when(first.isNotNull(), surface(first)).otherwise(inside)

    return let(_blanks(F.split(_bare(text), "[.!?]", -1)[0]), of)


def acts(word: Column) -> Column:
    """Whether a word is a verb of attribution or reaction, or ends like a past or a participle."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(word), "_-", "  "), "[^a-z0-9' ]+", " "), r"\s+", " "))
    return F.coalesce((low != "") & (low.isin(*VERBS, *cues.REACTION) | low.endswith("ed") | low.endswith("ing")), F.lit(False))


def surface_acting(text: Column) -> Column:
    """The surface that leads a sentence without a verb of attribution, if an action follows it."""

    def of(head: Column) -> Column:
        pick = lambda p: F.when(acts(_found(head, p, 2)), _found(head, p, 1))
        name = pick(NAME_ACTS)
        return F.when(head == "", None).when(name.isNotNull(), surface(name)).otherwise(surface(pick(ROLE_ACTS)))

    return let(_blanks(F.split(_bare(text), "[.!?]", -1)[0]), of)


def attribution_cue(text: Column, names: Column) -> Column:
    """(text, surface, name, verb, kind): what a stretch of narration says about who speaks; kind is speech or attribution."""

    def of(t: Column) -> Column:
        parts = lambda g: F.regexp_extract(t, rf"(?isU)^(.*?)\b({_SAID})\b(.*)$", g)
        verb = _some(parts(2))
        who = F.when(verb.isNull(), surface_acting(t)).otherwise(F.coalesce(surface_before(parts(1)), surface_after(parts(3))))
        kind = F.when(verb.isNull(), None).when(F.lower(verb).isin(*cues.SPEECH), "speech").otherwise("attribution")
        none = F.lit(None).cast("string")
        pick = lambda x: F.when(t != "", x).otherwise(none)
        return F.struct(t.alias("text"), pick(who).alias("surface"), pick(cues.attributed_speaker(t, names)).alias("name"), verb.alias("verb"), kind.alias("kind"))

    return let(_blanks(text), of)


def quote_structure(text: Column, names: Column, inside: bool = True) -> Column:
    """Array of (k, quote, position, verb, kind, cue, surface, name[, mentions, addressed, first, last]): the quotations of a paragraph.

    A quotation may run over lines. Its cue is what follows it up to the next one, if that says anything, else what leads to it.
    What is inside the quotation itself, the fields from mentions on, takes a pattern per name and is left out if not wanted.
    """
    body = F.coalesce(text, F.lit(""))
    quoted, around = F.regexp_extract_all(body, F.lit(QUOTE), F.lit(1)), F.split(body, QUOTE, -1)
    says = lambda c: c["surface"].isNotNull() | c["name"].isNotNull() | c["verb"].isNotNull()

    def unit(q: Column, k: Column, stretches: Column) -> Column:
        def of(both: Column) -> Column:
            ahead, behind = both[0], both[1]
            cue = F.when(says(behind), behind).otherwise(ahead)
            place = F.when(says(behind), "after").when(says(ahead), "before").otherwise("none")
            said = _blanks(q)
            fields = [cue[n].alias(m) for n, m in (("verb", "verb"), ("kind", "kind"), ("text", "cue"), ("surface", "surface"), ("name", "name"))]
            own = [cues.explicit_mentions(said, names).alias("mentions"), cues.addressed(sentence(said, True), names).alias("addressed"), sentence(said, False).alias("first"), sentence(said, True).alias("last")]
            return F.struct(k.alias("k"), said.alias("quote"), place.alias("position"), *fields, *(own if inside else []))

        return let(F.array(attribution_cue(F.get(stretches, k), names), attribution_cue(F.get(stretches, k + 1), names)), of)

    return let(F.struct(quoted.alias("q"), around.alias("s")), lambda x: F.transform(x["q"], lambda q, k: unit(q, k, x["s"])))


def has_cue(unit: Column) -> Column:
    """Whether the stretch of a quotation holds anything at all: text, a surface, a name or a verb."""
    return F.coalesce(_blanks(F.concat_ws("", unit["cue"], unit["surface"], unit["name"], unit["verb"])) != "", F.lit(False))
