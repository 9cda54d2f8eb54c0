"""Speakers of quoted lines by fixed rules over what their paragraphs say, with surfaces that earlier lines of a chapter have explained.

What a line's surroundings say is worked out by Spark as columns: quotations and cues of its paragraph and of those beside it, turns
near it, and whom each surface in the catalogue can mean. The rules, and the surfaces that a chapter has explained so far, are one
fold per chapter over names and flags, without texts.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialoom.functions import cues, quoting
from dialoom.functions.scalars import clamped, let
from dialoom.functions.text import character_name
from dialoom.operators.curation import role_label, surface_identities
from dialoom.operators.folding import folded
from dialoom.operators.placing import quote_key

# Nouns of roles that name nobody, ids that stand for nobody, what a speaker says of itself, where a mention may stand,
# and the limits of an identity, of a result and of its certainty.
ROLES = ("god", "goddess", "man", "mage", "old man", "primordial", "priest", "the man", "the god", "the goddess", "the mage", "the old man", "the primordial", "the priest", "the woman", "woman")
NOBODY = ("unknown", "primordial")
OWN_NAMES = (r"^you are speaking to\s+(.+?)(?:[,.!?]|$)", r"^i am\s+(.+?)(?:[,.!?]|$)", r"^this is\s+(.+?)(?:[,.!?]|$)")
MENTION = r"\b(?:[A-Z][A-Za-z'’\-]*(?:\s+[A-Z][A-Za-z'’\-]*){0,3}|(?:the|a|an)\s+[A-Za-z][A-Za-z'’\-]*(?:\s+[A-Za-z][A-Za-z'’\-]*){0,5})\b"
MENTION_EDGES = " ,.;:!?()[]{}\"“”"
LEAST_IDENTITY, LEAST_LEAD, HELD, LEAST_LEARNED, SURE = 0.78, 0.08, 0.72, 0.75, 0.75
LEAD_CHARACTERS, BACK, AHEAD, THRESHOLD = 180, 4, 2, 0.92
PRONOUNS = ("he", "she", "they")


def generic_surface(surface: Column) -> Column:
    """Whether a surface is a role, "another ..." or something "of" something, and so may be anybody."""
    low = character_name(surface)
    return F.coalesce(low.isin(*ROLES) | low.rlike("^(?:the )?(?:other|another) .") | F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" of ")), F.lit(False))


def generic_id(id: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(id, F.lit(""))))
    return low.isin(*NOBODY) | low.startswith("unknown-")


def continues(text: Column) -> Column:
    """Whether a text ends as if more of it came."""
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+$", "").rlike("[,:;—-]$"), F.lit(False))


def asks(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+$", "").endswith("?"), F.lit(False))


def own_names(text: Column) -> Column:
    """What a speaker calls itself at the beginning of a text."""
    found = F.array(*(F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), f"(?i){p}", 1) for p in OWN_NAMES))
    return F.filter(F.transform(found, role_label), lambda x: x != "")


def mentions(text: Column) -> Column:
    """Names and roles with an article in a text, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){MENTION}"), F.lit(0))
    return F.filter(F.transform(found, lambda x: role_label(F.btrim(x, F.lit(MENTION_EDGES)))), lambda x: x != "")


def _is_pronoun(surface: Column) -> Column:
    return F.coalesce(character_name(surface).isin(*PRONOUNS), F.lit(False))


def _tries(unit: Column) -> Column:
    """The surfaces by which a quotation's speaker may be known, best first."""
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    first = F.when(_is_pronoun(unit["surface"]) | blank(unit["surface"]), unit["name"]).otherwise(unit["surface"])
    words = F.regexp_extract_all(F.coalesce(unit["cue"], F.lit("")), F.lit(r"[A-Za-z'’\-]+"), F.lit(0))
    led = F.lower(F.get(words, F.lit(0))).isin("the", "a", "an")
    prefix = lambda n: F.when(led & (F.size(words) >= n), F.array_join(F.slice(words, 1, n), " "))
    every = F.array(first, F.coalesce(unit["name"], unit["surface"]), prefix(4), prefix(3), prefix(2))
    return F.array_distinct(F.filter(F.transform(every, role_label), lambda x: (x != "") & ~x.isin(*PRONOUNS)))


def _unit(unit: Column) -> Column:
    """Of a quotation only what the rules compare: no texts but its key."""
    label, learns = F.coalesce(unit["name"], unit["surface"]), F.coalesce(unit["surface"], unit["name"])
    key = character_name(learns)
    return F.struct(
        quote_key(unit["quote"]).alias("said"), _tries(unit).alias("tries"), own_names(unit["quote"]).alias("own"), quoting.has_cue(unit).alias("cue"), F.lower(unit["verb"]).alias("verb"),
        _is_pronoun(label).alias("pronoun"), generic_surface(label).alias("generic"), continues(unit["quote"]).alias("continues"),
        F.when((key != "") & ~key.isin(*PRONOUNS) & ~generic_surface(learns), key).alias("key"),
    )


def paragraph_evidence(paragraphs: DataFrame, names: Column, surfaces: Column, doc: str = "doc_id") -> DataFrame:
    """paragraphs (doc, idx, text) with units, told, tells and mentions of each, and as before, after and earlier those beside it."""
    cue = quoting.attribution_cue(F.col("text"), surfaces)
    who = lambda c: F.when(_is_pronoun(c["surface"]) | c["surface"].isNull(), c["name"]).otherwise(c["surface"])
    told = let(cue, lambda c: F.struct(role_label(who(c)).alias("who"), c["verb"].isNotNull().alias("verb")))
    of = paragraphs.select(
        doc, "idx", "text", F.transform(quoting.quote_structure(F.col("text"), names, inside=False), _unit).alias("units"), told.alias("told"),
        ((F.trim("text") != "") & ~F.col("text").rlike('["“]')).alias("plain"), mentions(F.col("text")).alias("mentions"), mentions(F.substring("text", 1, LEAD_CHARACTERS)).alias("lead"),
    )
    near = Window.partitionBy(doc).orderBy("idx")
    side = F.struct("units", F.col("told.who").alias("who"), F.col("told.verb").alias("verb"), "plain", "mentions")
    of = of.withColumns({"before": F.lag(side).over(near), "after": F.lead(side).over(near), "earlier": F.array(*(F.lag("lead", n).over(near) for n in (1, 2, 3)))})
    # of equal paragraphs the first one's surroundings are looked at
    first = Window.partitionBy(doc, "text").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return of.withColumn("earlier", F.first("earlier").over(first)).select(doc, "idx", "units", "before", "after", "earlier")


def evidence(lines: DataFrame, paragraphs: DataFrame, names: Column, surfaces: Column, doc: str = "doc_id") -> DataFrame:
    """lines (doc, i, text, speaker, name, paragraph, certain), in order of i, with all that the rules compare."""
    within = Window.partitionBy(doc, "paragraph").orderBy("i")
    order = Window.partitionBy(doc).orderBy("i")
    turn = F.struct("speaker", F.coalesce("name", F.initcap(F.replace("speaker", F.lit("_"), F.lit(" ")))).alias("name"), own_names(F.col("text")).alias("own"))
    rows = lines.withColumns({
        "k": F.row_number().over(within) - 1, "others": F.collect_list(role_label(F.col("text"))).over(within.rowsBetween(Window.unboundedPreceding, -1)),
        "past": F.filter(F.array(*(F.lag(turn, n).over(order) for n in range(1, BACK + 1))), lambda x: x.isNotNull()),
        "next": F.filter(F.array(*(F.lead(turn, n).over(order) for n in range(1, AHEAD + 1))), lambda x: x.isNotNull()),
    })
    last = lines.where("paragraph IS NOT NULL").groupBy(doc, (F.col("paragraph") + 1).alias("paragraph")).agg(F.max_by(F.struct("speaker", asks(F.col("text")).alias("asks"), continues(F.col("text")).alias("continues")), "i").alias("last"))
    rows = rows.join(paragraph_evidence(paragraphs, names, surfaces, doc).withColumnRenamed("idx", "paragraph"), [doc, "paragraph"], "left").join(last, [doc, "paragraph"], "left")
    none = F.array().cast(rows.schema["units"].dataType)
    units = F.coalesce("units", none)
    key = quote_key(F.col("text"))
    every = F.concat(units, F.coalesce("before.units", none), F.coalesce("after.units", none))
    same = lambda u: (u["said"] == key) & (key != "")
    at = F.get(units, F.when(F.col("paragraph").isNotNull(), F.col("k")))
    unit = F.when(same(at), at).otherwise(F.coalesce(F.get(F.filter(every, same), F.lit(0)), at))
    rows = rows.withColumns({"units": units, "unit": unit})
    vague = F.col("unit.pronoun") & F.col("unit.verb").isNull()
    some = lambda when, x: F.when(when, x).otherwise(F.array().cast("array<string>"))
    return rows.select(
        doc, "i", "speaker", "certain", "k", "units", "unit", "past", "next", "last", asks(F.col("text")).alias("asks"), continues(F.col("text")).alias("continues"),
        some(F.col("unit.generic") & F.col("paragraph").isNotNull(), F.col("others")).alias("others"),
        F.struct(F.try_element_at("before.units", F.lit(-1)).alias("unit"), F.col("before.who"), some(vague, F.col("before.mentions")).alias("mentions")).alias("before"),
        F.struct(F.get("after.units", F.lit(0)).alias("unit"), F.coalesce(F.size("after.units"), F.lit(0)).alias("n"), F.col("after.who"), F.col("after.verb"), F.col("after.plain"), some(vague, F.col("after.mentions")).alias("mentions")).alias("after"),
        F.when(vague, F.col("earlier")).alias("earlier"),
    ).withColumn("asked", _asked())


def _asked() -> Column:
    """Every surface of a line that a rule may ask for."""
    of_units = F.flatten(F.transform("units", lambda u: F.concat(u["tries"], u["own"])))
    one = lambda c: F.coalesce(F.concat(F.col(f"{c}.tries"), F.col(f"{c}.own")), F.array().cast("array<string>"))
    turns = F.flatten(F.transform("next", lambda x: x["own"]))
    lists = [of_units, one("unit"), one("before.unit"), one("after.unit"), turns, "others", "before.mentions", "after.mentions", F.flatten(F.filter("earlier", lambda x: x.isNotNull()))]
    lists = [F.coalesce(x, F.array().cast("array<string>")) for x in lists]
    return F.array_distinct(F.filter(F.concat(*lists, F.array("before.who", "after.who")), lambda x: x != ""))


def _surfaces(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, surface) of what the lines ask for; takes whole rows, so that Spark works them out once for this and for the fold."""

    def run(batches):
        for batch in batches:
            docs = batch.column(doc)
            asked = batch.column("asked")
            yield pa.RecordBatch.from_arrays([docs.take(pc.list_parent_indices(asked)), pc.list_flatten(asked)], names=[doc, "surface"])

    return rows.mapInArrow(run, f"{doc} {rows.schema[doc].dataType.simpleString()}, surface string").distinct()


def identities(rows: DataFrame, characters: DataFrame, memory: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, surface, id, name, score, generic): whom a surface means, where one of characters stands out.

    memory (doc, surface, id, name) has what the chapters themselves explain; it goes before the catalogue.
    """
    asked = _surfaces(rows, doc)
    found = surface_identities(asked.select("surface"), characters, characters.select(F.col("name").alias("surface"), "id", "name").limit(0))
    two = found.groupBy("surface").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "name", "id")), asc=False), 1, 2).alias("t"))
    clear = (F.col("t")[0]["score"] >= LEAST_IDENTITY) & (F.coalesce(F.get("t", F.lit(1))["score"], F.lit(-1.0)) < F.col("t")[0]["score"] - LEAST_LEAD)
    named = two.where(clear).select("surface", F.col("t")[0]["id"].alias("id"), F.col("t")[0]["name"].alias("name"), F.col("t")[0]["score"].alias("score"))
    told = memory.groupBy(doc, role_label(F.col("surface")).alias("surface")).agg(F.max(F.struct("ord", "id", "name")).alias("m"))
    both = asked.join(told, [doc, "surface"], "left").join(named, "surface", "left")
    known = lambda c: F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c)
    generic = generic_surface(F.col("surface"))
    return both.select(doc, "surface", known("id"), known("name"), F.when(F.col("m").isNotNull(), 0.99).otherwise(F.col("score")).alias("score"), generic.alias("generic"))


def scene_aliases(chapters: DataFrame, characters: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ord, surface, id, name): roles that a chapter sets beside a name, as "Name, the role" or "the role, Name".

    A surface that is set beside several is the last one's in the order of characters (ord, id, name, aliases); ord tells which.
    """
    role = r"([A-Za-z][A-Za-z'’\-]*(?:\s+[A-Za-z][A-Za-z'’\-]*){0,4})"
    every = characters.select("ord", "id", "name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "raw")).where("trim(raw) <> ''")
    # a chapter meets only the names whose first word it holds
    words = chapters.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    keyed = every.withColumn("word", F.regexp_extract(F.lower("raw"), r"[\p{L}\p{N}]+", 0))
    met = words.join(keyed, "word").drop("word").join(chapters.select(doc, F.col(text).alias("_t")), doc)
    name = cues._quoted(F.col("raw"))
    after = F.regexp_extract_all("_t", F.concat(F.lit(r"(?iU)\b"), name, F.lit(rf"\b\s*,\s*the\s+{role}")), F.lit(1))
    ahead = F.regexp_extract_all("_t", F.concat(F.lit(rf"(?iU)the\s+{role}\s*,\s*\b"), name, F.lit(r"\b")), F.lit(1))
    found = met.select(doc, "ord", "n", "id", "name", F.posexplode(F.concat(after, ahead)).alias("k", "s"))
    surface = F.regexp_replace(role_label(F.col("s")), r"^(?:(?:the|an|a) )+(?=\S)", "")
    return found.select(doc, F.struct("ord", "n", "k").alias("ord"), surface.alias("surface"), "id", "name").where("surface <> ''")


def _nobody(id: str | None) -> bool:
    low = (id or "").strip().lower()
    return low in NOBODY or low.startswith("unknown-")


def _first(found):
    return next((x for x in found if x), None)


def _suggested(line: dict, look) -> tuple | None:
    """(id, name, confidence, reasons) by the first rule that applies; look: surface -> (id, name, score) or None."""
    unit, units, k, past = line["unit"], line["units"], line["k"], line["past"]
    ahead, before, certain = line["after"], line["before"], line["certain"]
    by = lambda u: _first(map(look, u["tries"])) if u else None
    somebody = lambda surfaces: (x for x in map(look, surfaces if surfaces is not None else ()) if x and not _nobody(x[0]))
    rule = "deterministic_override"
    open_ = unit is not None and not unit["cue"]

    if x := by(unit):
        return *x[:2], max(x[2], 0.9), ["explicit_cue_resolution", rule, *([f"cue_verb_{unit['verb'].replace(' ', '_')}"] if unit["verb"] else [])]
    if unit and (x := _first(map(look, unit["own"]))):
        return *x[:2], max(x[2], 0.95), ["self_identification", rule]
    if unit and unit["generic"] and (x := _first(_first(map(look, turn["own"])) for turn in line["next"])):
        return *x[:2], max(x[2], 0.94), ["future_self_identification", rule]
    if k < len(units) and not units[k]["cue"]:
        if x := _first(by(units[n]) for n in (k - 1, k + 1) if 0 <= n < len(units) and units[n]["cue"]):
            return *x[:2], max(x[2], 0.95), ["shared_paragraph_cue", rule]
    if unit and unit["generic"] and (x := _first(somebody(line["others"]))):
        return *x[:2], max(x[2], 0.93), ["generic_surface_anchor", rule]
    if unit and unit["pronoun"] and not unit["verb"]:
        near = [*somebody(before["mentions"])][-1:] or [*somebody(ahead["mentions"])][:1]
        if x := _first([*near, *(_first(somebody(p)) for p in (line["earlier"] if line["earlier"] is not None else ()))]):
            return *x[:2], max(x[2], 0.93), ["narrative_anchor_resolution", rule]
    last, replies = line["last"], by(ahead["unit"])
    other = lambda *not_: next(((t["speaker"], t["name"] or t["speaker"]) for t in past if t["speaker"] and t["speaker"] not in not_), None)
    if last and last["asks"] and last["speaker"] and replies and open_ and (x := other(last["speaker"])) and x[0] != replies[0]:
        return *x, 0.93, ["question_reply_turn_taking", rule]
    if open_ and certain and ahead["plain"] and ahead["verb"] and (x := look(ahead["who"])):
        return *x[:2], max(x[2], 0.92), ["next_narration_speaker", rule]
    beside = any(by(u) for n, u in enumerate(units) if n != k and u["cue"])
    if open_ and certain and not beside and not (last and not last["continues"]) and (x := look(before["who"])) and not (replies and replies[0] == x[0]):
        return *x[:2], max(x[2], 0.95), ["previous_narrator_carryover", rule]
    if before["unit"] and before["unit"]["continues"] and not (unit and unit["cue"]) and not beside and not line["asks"] and (x := by(before["unit"])):
        return *x[:2], 0.95, ["adjacent_same_speaker_continuation", "previous_explicit_cue", "continuation_punctuation"]
    if line["continues"] and not ahead["n"] and (x := look(ahead["who"])):
        return *x[:2], 0.95, ["adjacent_same_speaker_continuation", "next_narration_attribution", "continuation_punctuation"]
    if replies and line["asks"] and (x := other(replies[0], "narrator")):
        return *x, 0.93, ["question_precedes_explicit_reply", "recent_turn_alternation", rule]
    return None


def _result(line: dict, found: tuple | None, threshold: float) -> tuple:
    """(suggested, name, action, disposition, confidence, reasons) of a rule's suggestion, or of none."""
    if not found:
        return line["speaker"], None, "needs_review", "review", 0.0, ["step_limit_reached"]
    id, name, confidence, reasons = found
    action = "keep_existing" if id == line["speaker"] else "reassign_existing"
    confidence = min(1.0, max(0.0, confidence))
    if not line["certain"]:
        confidence, reasons = min(confidence, HELD), [*reasons, "alignment_uncertain"]
    if action == "reassign_existing" and _nobody(id):
        if not _nobody(line["speaker"]):
            id, name, action = None, "Unknown", "needs_review"
        confidence, reasons = min(confidence, HELD), [*reasons, "generic_character_guard", "ambiguous_unknown"]
    return id, name, action, "auto_apply" if confidence >= threshold else "review", confidence, reasons


def assisted(rows: DataFrame, known: DataFrame, doc: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """evidence() and identities() -> (doc, i, speaker, suggested, name, action, disposition, confidence, reasons), a row per line.

    Lines are taken in order; a result of LEAST_LEARNED or more explains its surface to the lines of the chapter that follow. A
    chapter is one group of names and flags. A line that no rule decides is left for review with its own speaker.
    """

    columns = [c for c in rows.columns if c != doc]  # all of them, as identities() takes them too

    def fold(chapter: object, lines: list[tuple]) -> list[tuple]:
        static = {r["surface"]: r for r in lines[0][-1] or ()}
        told: dict[str, tuple] = {}
        out = []

        def look(surface):
            r = static.get(surface) if surface and surface not in PRONOUNS else None
            if r is None:
                return None
            x = (*told[surface], 0.99) if surface in told else (r["id"], r["name"], r["score"])
            return x if x[0] and not (_nobody(x[0]) and r["generic"]) else None

        for cells in lines:
            line = dict(zip(columns, cells))
            result = _result(line, _suggested(line, look), threshold)
            out.append((chapter, line["i"], line["speaker"], *result))
            if result[2] != "needs_review" and result[4] >= LEAST_LEARNED and result[0] and line["unit"] and line["unit"]["key"]:
                told[line["unit"]["key"]] = result[:2]
        return out

    kind = rows.schema[doc].dataType.simpleString()
    schema = StructType.fromDDL(f"{doc} {kind}, i int, speaker string, suggested string, name string, action string, disposition string, confidence double, reasons array<string>")
    named = known.select(F.col(doc).alias("_doc"), F.struct("surface", "id", "name", "score", "generic").alias("n")).groupBy("_doc").agg(F.collect_list("n").alias("_named"))  # a name of its own, as both come from the same rows
    first = F.row_number().over(Window.partitionBy(doc).orderBy("i")) == 1
    both = rows.join(named.hint("merge"), F.col(doc) == F.col("_doc"), "left")
    return folded(both.select(doc, *columns, F.when(first, F.col("_named")).alias("_named")), doc, ["i"], fold, schema)


def assist(lines: DataFrame, paragraphs: DataFrame, characters: DataFrame, memory: DataFrame, doc: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """assisted() from lines (doc, i, text, speaker, paragraph, certain), paragraphs (doc, idx, text) and characters (ord, id, name, aliases).

    The catalogue's names, one row, are put beside every paragraph; it is one book's cast.
    """
    cast = characters.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("_names"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("all")))), lambda x: x["all"]))).alias("_surfaces"),
    )
    placed = paragraphs.join(F.broadcast(cast))  # one row
    named = lines.join(characters.groupBy(F.col("id").alias("speaker")).agg(F.min_by("name", "ord").alias("name")), "speaker", "left")
    rows = evidence(named, placed, F.col("_names"), F.col("_surfaces"), doc).repartition(doc)
    return assisted(rows, identities(rows, characters, memory, doc), doc, threshold)


def assist_summary(results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per chapter: scanned lines, how many of each disposition, and how many each rule decided."""
    of = lambda name: F.count_if(F.col("disposition") == name).alias(name)
    return results.groupBy(doc).agg(
        F.count("*").alias("scanned"), of("auto_apply"), of("review"), F.count_if(F.col("action") == "reassign_existing").alias("reassigned"),
        F.count_if(F.array_contains("reasons", "step_limit_reached")).alias("undecided"), F.round(F.avg(clamped(F.col("confidence"))), 6).alias("mean_confidence"),
    )
