"""Cues about who speaks, as Column expressions over a text and an array of known names.

Names are matched as whole words without regard to case; null and empty names are never found, and a null text has no cue.
Every function looks at one row's own text and names, so nothing is joined or shuffled; catalogues come as an array column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.scalars import let
from dialoom.functions.text import phrase

# Verbs of speech, of reaction, further verbs of attribution and of pronoun cues, verbs of phase; labels without a name.
SPEECH = (
    "said", "asked", "replied", "answered", "muttered", "shouted", "whispered", "snapped", "yelled", "growled", "sighed", "hissed", "called", "told",
    "added", "continued", "remarked", "noted", "stated", "declared", "insisted",
)
REACTION = ("grunted", "sighed", "spat")
ATTRIBUTION = (*SPEECH, *REACTION, "cursed", "gravelled", "keened", "pointed out")
PRONOUN_CUES = (*ATTRIBUTION, "barked", "croaked", "greeted", "murmured")
PHASE = ("began", "started", "finished")
PRONOUNS = {"he": "male", "she": "female", "they": "neutral"}
GENERIC = (
    "he", "she", "they", "we", "you", "i", "it", "this", "that", "these", "those", "him", "her", "them", "his", "hers", "its", "their", "our",
    "protagonist", "person", "speaker", "the man", "the woman", "the crowd", "the boy", "the girl",
)
UNASSIGNED = ("Unassigned", "Unknown")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def generic_label(name: Column) -> Column:
    """Empty, a pronoun or common label, or anything that begins with "unknown"."""
    low = normal(name)
    return (low == "") | low.isin(*GENERIC) | low.startswith("unknown")


def blocked_speaker(name: Column) -> Column:
    """No speaker to carry on: empty, unassigned, or a list of suggestions."""
    return F.coalesce(name.isNull() | (F.trim(name) == "") | name.isin(*UNASSIGNED) | name.startswith("["), F.lit(True))


def known(names: Column) -> Column:
    """Names without blanks around them and without empty ones, in order."""
    return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), F.trim), lambda n: n != "")


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _whole(name: Column, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(f"(?i){before}\\b"), _quoted(name), F.lit(f"{after}\\b"))


def explicit_mentions(text: Column, names: Column) -> Column:
    """The names that the text holds, in the order of names."""
    return F.filter(known(names), lambda n: F.coalesce(F.regexp_like(text, _whole(n)), F.lit(False)))


def addressed(sentence: Column, names: Column) -> Column:
    """The first name that the sentence speaks to: after "to", "toward" or "facing"."""
    hit = F.filter(known(names), lambda n: F.coalesce(F.regexp_like(sentence, _whole(n, r"\b(?:to|toward|facing)\s+")), F.lit(False)))
    return F.get(hit, F.lit(0))


def _places(text: Column, names: Column) -> Column:
    """(first place from 1, number of places, order, name) of every name that occurs, possessives included."""
    pattern = lambda n: _whole(n, after="(?:['’]s)?")
    made = F.transform(known(names), lambda n, i: F.struct(F.regexp_instr(text, pattern(n)).alias("first"), F.regexp_count(text, pattern(n)).alias("times"), i.alias("i"), n.alias("name")))
    return F.filter(made, lambda x: x["first"] > 0)


def first_mention(text: Column, names: Column) -> Column:
    """The name that occurs first; of several at one place, the earlier of names."""
    return F.array_min(F.transform(_places(text, names), lambda x: F.struct(x["first"], x["i"], x["name"].alias("name"))))["name"]


def last_mention(text: Column, names: Column) -> Column:
    """The name that occurs last; of several at one place, the later of names."""
    # the greedy start of a pattern leaves the last occurrence only
    end = lambda n: F.length(F.call_function("regexp_extract", text, F.concat(F.lit("(?is)^(.*)\\b"), _quoted(n), F.lit("(?:['’]s)?\\b")), F.lit(1)))
    found = F.transform(_places(text, names), lambda x: F.struct(end(x["name"]).alias("at"), x["i"].alias("i"), x["name"].alias("name")))
    return F.array_max(found)["name"]


def only_mention(text: Column, names: Column) -> Column:
    """The one name that the text holds, null if it holds none or several."""
    found = _places(text, names)
    several = F.size(F.array_distinct(F.transform(found, lambda x: F.lower(x["name"])))) > 1
    return F.when(~several, last_mention(text, names))


def attributed_speaker(sentence: Column, names: Column) -> Column:
    """The one name that stands before a verb of attribution or phase, or else the one that stands after a verb of attribution."""
    said, phases = "|".join(v for v in dict.fromkeys(ATTRIBUTION) if v not in REACTION), rf"\s+(?:{'|'.join(PHASE)})(?=\s*[,.;:!?]|\s*$)"

    def of(text: Column) -> Column:
        key = lambda n: F.struct(n.alias("name"), phrase(n).alias("key"))
        held = lambda x: (x["key"] != "") & (F.contains(text["padded"], F.concat(F.lit(" "), x["key"], F.lit(" "))) | F.contains(text["low"], x["key"]))
        before = lambda x: F.regexp_like(text["padded"], F.concat(F.lit(" "), _quoted(x["key"]), F.lit(f" (?:{said}) ")))
        phase = lambda x: F.regexp_like(sentence, F.concat(F.lit("(?i)\\b"), _quoted(x["key"]), F.lit(phases)))
        after = lambda x: F.regexp_like(text["padded"], F.concat(F.lit(f" (?:{said}) "), _quoted(x["key"]), F.lit(" ")))
        one = lambda x: F.when(F.size(x) == 1, x[0]["name"])
        by = lambda named: F.struct(F.filter(named, lambda x: before(x) | phase(x)).alias("subjects"), F.filter(named, after).alias("objects"))
        chosen = lambda x: F.when(F.size(x["subjects"]) > 0, one(x["subjects"])).otherwise(one(x["objects"]))
        return let(let(F.filter(F.transform(F.array_distinct(known(names)), key), held), by), chosen)

    texts = F.struct(F.concat(F.lit(" "), phrase(sentence), F.lit(" ")).alias("padded"), F.lower(sentence).alias("low"))
    # names are looked at where a verb stands, and by patterns of their own where the text holds them
    return let(texts, lambda x: F.when(F.rlike(x["padded"], F.lit(f" (?:{said}) ")) | F.rlike(sentence, F.lit(f"(?i){phases}")), of(x)))


def pronoun_cue(sentence: Column) -> Column:
    """(gender, cue): the first pronoun beside a verb of attribution, longer verbs first, the verb after it before the one ahead."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(sentence, F.lit(""))), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    verbs = {n: [v for v in dict.fromkeys(PRONOUN_CUES) if len(v.split()) == n] for n in (2, 1)}

    def of(all_: Column) -> Column:
        def cue(token: Column, i: Column) -> Column:
            word = lambda k: F.get(all_, i + k)
            said = F.when(F.lit(False), F.lit(""))
            for n, known_ in verbs.items():
                after = F.concat(*([word(1)] if n == 1 else [word(1), F.lit(" "), word(2)]))
                ahead = F.concat(*([word(-1)] if n == 1 else [word(-2), F.lit(" "), word(-1)]))
                said = said.when(after.isin(*known_), F.concat(token, F.lit(" "), after)).when(ahead.isin(*known_), F.concat(ahead, F.lit(" "), token))
            return F.when(token.isin(*PRONOUNS), F.struct(token.alias("who"), said.alias("cue")))

        return F.get(F.filter(F.transform(all_, cue), lambda x: x["cue"].isNotNull()), F.lit(0))

    gender = F.create_map(*(F.lit(x) for kv in PRONOUNS.items() for x in kv))
    return let(let(tokens, of), lambda x: F.when(x.isNotNull(), F.struct(F.try_element_at(gender, x["who"]).alias("gender"), x["cue"].alias("cue"))))


def nearby_speech_verb(context: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" "), normal(context), F.lit(" ")).rlike(f" (?:{'|'.join(SPEECH)}) "), F.lit(False))


def boundary_quality(context: Column, quote: Column) -> Column:
    """0.35, more for quotation marks in the context, a closing mark of the quote, and four words or more; 1 at most."""
    context, quote = F.coalesce(context, F.lit("")), F.coalesce(quote, F.lit(""))
    plus = lambda fits, n: F.when(fits, n).otherwise(0.0)
    words = F.size(F.filter(F.split(quote, r"\s+"), lambda w: w != ""))
    score = F.lit(0.35) + plus(context.rlike('["“”]'), 0.35) + plus(quote.rlike(r"(?s)[?!.]\z"), 0.15) + plus(words >= 4, 0.1)
    return F.when((context == "") | (quote == ""), 0.35).otherwise(F.least(F.lit(1.0), score))


def unique_descriptor(text: Column, descriptors: Column) -> Column:
    """The one owner of all descriptors, an array of (descriptor, name), that the text holds between blanks; both normalised."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    owners = F.array_distinct(F.transform(F.filter(descriptors, lambda d: (d["descriptor"] != "") & padded.contains(F.concat(F.lit(" "), d["descriptor"], F.lit(" ")))), lambda d: d["name"]))
    return F.when(F.size(owners) == 1, owners[0])


def suggestion(stack: Column, narrator: str) -> Column:
    """The two latest speakers of a recency stack as [earlier|latest]; with one, it and the narrator; null without any."""
    top, next_ = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
    both = lambda a, b: F.concat(F.lit("["), a, F.lit("|"), b, F.lit("]"))
    who = F.lit(narrator)
    return F.when(next_.isNotNull() & (next_ != top), both(next_, top)).when(top != who, both(top, who)).when(top == who, both(who, F.lit("Unknown")))
