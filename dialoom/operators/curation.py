"""Curated speakers: reports, counts, suggestions by character, and identities of surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.functions.scalars import let, ratio

NARRATOR = "Narrator"
NOISY = ("their", "those grooves", "the voice")  # fixed values: surfaces that are no names
RUN = 6  # fixed value: words of a name on which it meets lines
# Words that say nothing of a role, and titles that may lead one.
STOPWORDS = ("a", "an", "and", "of", "the", "to", "with")
TITLES = ("arch", "chief", "grand", "head", "high", "holy", "king", "lady", "lord", "queen", "sir")


def _spoken(speaker: Column) -> Column:
    return F.coalesce((speaker != "") & (speaker != NARRATOR), F.lit(False))


def curation_report(lines: DataFrame) -> DataFrame:
    """lines (chapter, speaker, conflict) -> per chapter, and over all where `whole`: lines, dialogue, conflicts."""
    conflict = F.coalesce("conflict", F.lit(False))
    return lines.rollup("chapter").agg(
        (F.grouping("chapter") == 1).alias("whole"), F.count("*").alias("lines"), F.count_if(_spoken(F.col("speaker"))).alias("dialogue"), F.count_if(conflict).alias("conflicts"),
    )


def stage_summary(evaluations: DataFrame) -> DataFrame:
    """evaluations (chapter, stage, total, correct) -> per stage and chapter, and per stage where `whole`: total, correct, accuracy."""
    keys = [F.col("stage"), F.col("chapter")]
    sums = evaluations.groupingSets([keys, keys[:1]], *keys).agg((F.grouping("chapter") == 1).alias("whole"), F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return sums.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def speaker_frequency(lines: DataFrame) -> DataFrame:
    return lines.where(_spoken(F.col("speaker"))).groupBy("speaker").agg(F.count("*").alias("n"))


def conflict_patterns(lines: DataFrame) -> DataFrame:
    """(pattern, n): the first two candidates' names of lines in conflict, in their order; a null name is empty."""
    name = lambda i: F.coalesce(F.element_at("candidates", i), F.lit(""))
    held = lines.where(F.col("conflict") & (F.size("candidates") >= 2))
    return held.groupBy(F.concat(name(1), F.lit(" vs "), name(2)).alias("pattern")).agg(F.count("*").alias("n"))


def manifest_summary(wanted: DataFrame, books: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """wanted (key) -> key, origin, entries. Manifests give (key, entry), one row with a null entry where they are empty.

    A book's manifest goes before those of chapters, even if it is empty; no entries at all are 0, for the caller to refuse.
    """
    part = lambda rows, origin: rows.groupBy(key).agg(F.count("entry").alias("entries")).withColumn("origin", F.lit(origin))
    whole = part(books, "book")
    found = whole.unionByName(part(chapters, "chapters").join(whole, key, "left_anti"))
    return wanted.select(key).distinct().join(found, key, "left").select(key, "origin", F.coalesce("entries", F.lit(0)).alias("entries"))


def ingested(lines: DataFrame, known: DataFrame, noisy: tuple[str, ...] = NOISY) -> DataFrame:
    """(name, count_dialogue, count_mentions, first_seen) from lines (place, chapter, speaker, text) in the order of place.

    known (name, place, chapter) are names of a catalogue, place null for those that were there before all lines. A name
    counts as mentioned, once a line, in lines from the place on where it is first known. Lines and names meet on the name's words,
    its first RUN where it has more, and a line's text meets all its names at once; names without letters or digits are never
    mentioned.
    """
    said = lines.where(_spoken(F.col("speaker"))).select(F.col("speaker").alias("name"), "place", "chapter", F.lit(1).alias("said"))
    listed = known.select("name", F.coalesce("place", F.lit(-1)).alias("place"), "chapter", F.lit(0).alias("said"))
    rows = listed.unionByName(said).where((F.col("name") != "") & (F.col("name") != NARRATOR) & ~F.col("name").isin(*noisy))
    first = F.min(F.when(F.col("chapter").isNotNull(), F.struct("place", "chapter")))["chapter"]
    names = rows.groupBy("name").agg(F.sum("said").alias("count_dialogue"), first.alias("first_seen"), F.min("place").alias("since"))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    run = lambda of, at, n: F.xxhash64(F.slice(of, at, n))
    runs = lambda of, n: F.when(F.size(of) >= n, F.transform(F.sequence(F.lit(1), F.size(of) - n + 1), lambda at: run(of, at, n))).otherwise(F.array().cast("array<bigint>"))
    sought = names.select("name", "since", words(F.col("name")).alias("w")).where(F.size("w") > 0).select("name", "since", F.least(F.size("w"), F.lit(RUN)).alias("n"), run(F.col("w"), F.lit(1), F.lit(RUN)).alias("run"))
    sizes = sought.agg(F.collect_set("n").alias("sizes"))
    every = let(words(F.col("text")), lambda of: F.array_distinct(F.flatten(F.transform("sizes", lambda n: runs(of, n)))))
    held = lines.join(F.broadcast(sizes)).select("place", F.explode(every).alias("run"))  # one row
    # what is exploded is far larger than Spark takes it for, and so never sent to all
    met = held.join(sought.drop("n").hint("merge"), "run").where(F.col("place") >= F.col("since")).groupBy("place").agg(F.collect_set("name").alias("names"))
    stands = lambda n: F.rlike(F.col("text"), F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b")))
    met = lines.select("place", "text").join(met.hint("merge"), "place").select(F.explode(F.filter("names", stands)).alias("name"))
    mentions = met.groupBy("name").agg(F.count("*").alias("count_mentions"))
    return names.join(mentions, "name", "left").select("name", "count_dialogue", F.coalesce("count_mentions", F.lit(0)).alias("count_mentions"), "first_seen")


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def scoped_lookup(book: DataFrame, chapter: DataFrame, key=text.character_name) -> DataFrame:
    """(surface, scope, id): ids, names and aliases of both catalogues (ord, id, name, aliases); the chapter's, then the last, win."""
    rows = book.withColumn("scope", F.lit(0)).unionByName(chapter.withColumn("scope", F.lit(1)))
    names = F.array_compact(F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    keyed = rows.select("scope", "ord", "id", F.explode(names).alias("s")).select(key(F.col("s")).alias("surface"), F.struct("scope", "ord", "id").alias("r")).where("surface <> ''")
    return keyed.groupBy("surface").agg(F.max("r").alias("r")).select("surface", "r.scope", "r.id")


def line_counts(lines: DataFrame, characters: DataFrame) -> DataFrame:
    """(chapter, name, lines) from lines (chapter, identity) and characters (ord, id, name, aliases).

    An identity is an id, else an alias, else a name, else stands for itself; the last character that has it wins. An alias has
    its character's count, whatever else bears that name; counts of zero are left out.
    """
    keys = lambda value, rank: characters.select(_key(value).alias("k"), F.struct(F.lit(rank).alias("rank"), "ord").alias("o"), "name")
    spelled = characters.select("ord", "name", F.explode("aliases").alias("alias")).where(_key(F.col("alias")) != "")
    aliases = spelled.select(_key(F.col("alias")).alias("k"), F.struct(F.lit(1).alias("rank"), "ord").alias("o"), "name")
    lookup = keys(F.col("id"), 2).unionByName(aliases).unionByName(keys(F.col("name"), 0)).where("k <> ''").groupBy("k").agg(F.max_by("name", "o").alias("canonical"))
    held = lines.where("identity <> ''").groupBy("chapter", "identity").agg(F.count("*").alias("n")).withColumn("k", _key(F.col("identity")))
    counts = held.join(lookup, "k", "left").groupBy("chapter", F.coalesce("canonical", "identity").alias("name")).agg(F.sum("n").alias("lines"))
    owners = spelled.groupBy("alias").agg(F.max_by("name", "ord").alias("name"))
    copied = counts.join(owners, "name").select("chapter", F.col("alias").alias("name"), "lines")
    return counts.join(owners.select(F.col("alias").alias("name")), "name", "left_anti").select("chapter", "name", "lines").unionByName(copied)


def suggested_lines(results: DataFrame) -> DataFrame:
    """results (line, outcome, name) -> name, line, lines and first_line of the name: the assignments to make, by character."""
    held = results.select("line", "outcome", F.trim("name").alias("name")).where("outcome = 'suggestion' AND name <> ''").drop("outcome")
    groups = held.groupBy("name").agg(F.count("*").alias("lines"), F.min("line").alias("first_line"))
    return held.join(groups, "name")


def descriptor_plan(targets: DataFrame, characters: DataFrame, descriptor: str) -> DataFrame:
    """targets (line, target) -> line, character, name, add_descriptor; character is null where the target is not known.

    characters (ord, id, name, aliases, descriptors): the first with an id, without regard to case, is the target.
    """
    wanted = _key(F.lit(descriptor))
    none = F.array().cast("array<string>")
    names = F.concat(F.array("name"), F.coalesce("aliases", none), F.coalesce("descriptors", none))
    had = F.coalesce(F.exists(F.array_compact(names), lambda x: _key(x) == wanted), F.lit(False))
    first = characters.groupBy(_key(F.col("id")).alias("k")).agg(F.min_by(F.struct("id", "name", (~had).alias("new")), "ord").alias("c"))
    asked = targets.where(_key(F.col("target")) != "").withColumn("k", _key(F.col("target")))
    return asked.join(first, "k", "left").select("line", F.col("c.id").alias("character"), "c.name", F.col("c.new").alias("add_descriptor"))


def prequential(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Per chapter of lines (chapter, place, surface, gold): total, matched, correct, learned.

    Each chapter is scored before it teaches: a surface is matched if it is in known (surface, id), or an earlier chapter had
    it; its speaker is then that of known, else the one of its first line.
    """
    taught = lines.where("gold IS NOT NULL AND surface IS NOT NULL").groupBy("surface").agg(F.min(F.struct("chapter", "place", "gold")).alias("t"))
    base = known.groupBy("surface").agg(F.min("id").alias("id"))
    found = lines.join(taught, "surface", "left").join(base, "surface", "left")
    guess = F.coalesce("id", F.when(F.col("t.chapter") < F.col("chapter"), F.col("t.gold")))
    new = F.col("id").isNull() & (F.col("t.chapter") == F.col("chapter")) & (F.col("t.place") == F.col("place"))
    return found.groupBy("chapter").agg(F.count("*").alias("total"), F.count(guess).alias("matched"), F.count_if(guess == F.col("gold")).alias("correct"), F.count_if(new).alias("learned"))


def role_label(value: Column) -> Column:
    low = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "_-", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9' ]+", " "), r"\s+", " "))


def without_title(label: Column) -> Column:
    titles = f"(?:(?:{'|'.join(TITLES)}) )*"
    return F.regexp_replace(label, rf"^{titles}((?:(?:the|an|a) )?){titles}(?=\S)", "$1")


def without_article(label: Column) -> Column:
    return F.regexp_replace(label, r"^(?:(?:the|an|a) )+(?=\S)", "")


def _role_words(label: Column) -> Column:
    return F.filter(F.split(label, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))


def surface_identities(surfaces: DataFrame, characters: DataFrame, memory: DataFrame, k: int = 5) -> DataFrame:
    """(surface, id, name, score): for each surface the k likeliest of characters (ord, id, name, aliases), by score, then name, falling.

    A label that equals the surface gives 0.98, one that equals it without article and title 0.94, shared words 0.45 and up to
    0.35 by their share; placeholders have 0.7 of it. A surface in memory (surface, id, name) of the scene is that character, 0.99.
    """
    one = characters.groupBy("id").agg(F.min_by(F.struct("name", "aliases"), "ord").alias("c")).select("id", "c.*")
    raw = F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    labels = F.flatten(F.transform(raw, lambda v: F.array(role_label(v), without_title(role_label(v)), without_article(role_label(v)), without_article(without_title(role_label(v))))))
    generic = role_label(F.col("id")).startswith("unknown") | role_label(F.col("name")).startswith("unknown")
    one = one.select("id", "name", generic.alias("generic"), F.array_distinct(F.filter(labels, lambda x: x != "")).alias("labels"))
    tagged = lambda labels, words: F.explode(F.concat(F.transform(labels, lambda x: F.struct(F.lit(True).alias("label"), x.alias("key"))), F.transform(words, lambda x: F.struct(F.lit(False).alias("label"), x.alias("key"))))).alias("e")
    theirs = one.select("id", "name", "generic", tagged(F.col("labels"), F.array_distinct(F.flatten(F.transform("labels", _role_words))))).select("id", "name", "generic", "e.*")

    asked = surfaces.select(role_label(F.col("surface")).alias("surface")).where("surface <> ''").distinct()
    told = memory.select(role_label(F.col("surface")).alias("surface"), "id", "name").groupBy("surface").agg(F.min(F.struct("id", "name")).alias("m"))
    sure = asked.join(told, "surface").select("surface", "m.id", "m.name", F.lit(0.99).alias("score"))
    open_ = asked.join(told, "surface", "left_anti").withColumn("bare", without_article(without_title(F.col("surface"))))
    open_ = open_.withColumn("words", F.array_distinct(_role_words(F.col("bare"))))
    ours = open_.select("surface", "bare", F.size("words").alias("n"), tagged(F.array_distinct(F.array("surface", "bare")), F.col("words"))).select("surface", "bare", "n", "e.*")
    shared = F.count_if(~F.col("label"))
    score = F.when(F.max(F.col("label") & (F.col("key") == F.col("surface"))), 0.98).when(F.max(F.col("label")), 0.94).otherwise(0.45 + 0.35 * (shared / F.first("n")))
    met = ours.join(theirs, ["label", "key"]).groupBy("surface", "id", "name", "generic").agg(score.alias("score"))
    met = met.select("surface", "id", "name", F.round(F.when(F.col("generic"), F.col("score") * 0.7).otherwise(F.col("score")), 4).alias("score"))
    best = Window.partitionBy("surface").orderBy(F.desc("score"), F.desc("name"), "id")
    return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r").unionByName(sure)
