"""Short tags of narration ("she whispered,") put back into the texts of the lines that they stand at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.cues import SPEECH
from dialoom.functions.scalars import let

# The longest tag and gap, what may stand in a gap, and the quotation marks at an edge.
MOST_WORDS, MOST_GAP, NARRATOR = 12, 30, "narrator"
GAP, EDGE = r"(?U)^[\s\"'“”‘’`.,;:!?…—–-]*$", r"[\s\"'“”‘’`]+"


def short_tag(text: Column) -> Column:
    """Whether a text has a verb of speech and twelve words at most."""
    words = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))
    return F.coalesce((words <= MOST_WORDS) & F.lower(text).rlike(rf"\b(?:{'|'.join(SPEECH)})\b"), F.lit(False))


def narration_tags(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, text, start, end): the narrator's lines (doc, i, text, speaker, start, end) that are short tags and have a span."""
    spanned = (F.col("end") >= F.col("start")) & (F.col("start") >= 0)
    return lines.where((F.col("speaker") == NARRATOR) & spanned & short_tag(F.col("text"))).select(doc, "text", "start", "end")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)^{EDGE}|{EDGE}$", "")


def _spoken(tag: Column) -> Column:
    return F.trim(F.regexp_replace(_bare(tag), "[.,;:!?…]+$", ""))


def _followed(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def _clean(body: Column, start: Column, end: Column) -> Column:
    gap = F.substring(body, start + 1, F.greatest(end - start, F.lit(0)))
    return body.isNull() | ((end >= start) & (end - start <= MOST_GAP) & gap.rlike(GAP))


def _rebuilt(line: Column, body: Column) -> Column:
    """A line (text, start, end, before, after, inside) of a chapter's text with its tags."""
    cut = lambda a, b: _bare(F.substring(body, a + 1, F.greatest(b - a, F.lit(0))))
    inside = line["inside"]
    piece = lambda text, tag: F.struct(text.alias("text"), F.lit(tag).alias("tag"))
    begin = lambda k: F.when(k == 0, line["start"]).otherwise(F.get(inside, k - 1)["end"])
    parts = F.flatten(F.transform(inside, lambda t, k: F.array(piece(cut(begin(k), t["start"]), False), piece(_spoken(t["text"]), True))))
    parts = F.concat(parts, F.array(piece(cut(F.try_element_at(inside, F.lit(-1))["end"], line["end"]), False)))
    whole = lambda p: F.array_join(F.transform(p, lambda x, k: F.when(x["tag"] & (k < F.size(p) - 1), _followed(x["text"])).otherwise(x["text"])), " ")
    woven = F.when((F.size(inside) > 0) & body.isNotNull(), F.nullif(F.trim(let(F.filter(parts, lambda x: x["text"] != ""), whole)), F.lit("")))
    before = F.when(line["before"].isNotNull() & _clean(body, line["before"]["end"], line["start"]), _followed(_spoken(line["before"]["text"])))
    after = F.when(line["after"].isNotNull() & _clean(body, line["end"], line["after"]["start"]), _spoken(line["after"]["text"]))
    around = F.concat(F.array(before, line["text"], after), F.transform(inside, lambda t: _spoken(t["text"])))
    joined = F.trim(F.array_join(F.filter(around, lambda x: F.trim(x) != ""), " "))
    spanned = F.coalesce((line["end"] >= line["start"]) & (line["start"] >= 0), F.lit(False))
    return F.when(spanned, F.coalesce(woven, F.nullif(joined, F.lit("")), line["text"])).otherwise(line["text"])


def tagged_texts(lines: DataFrame, chapters: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, i, text) of the lines that are not the narrator's, with the tags that stand right before, right after or inside each.

    lines (doc, i, text, speaker, start, end) do not overlap but for tags inside one; chapters are (doc, text). A tag stands at a line if only blanks
    and marks, 30 at most, lie between; without the chapter's text the nearest one does. A line with tags inside is
    put together from the chapter's text. A line without a span, or without tags, keeps its text, and a null text is empty.
    """
    said = lines.where(F.coalesce(F.col("speaker") != NARRATOR, F.lit(True))).select(doc, "i", F.coalesce("text", F.lit("")).alias("text"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    tags = narration_tags(lines, doc).select(doc, F.struct("text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("tag"))
    mine = said.select(doc, "i", F.struct("start", "end").alias("line"))
    none = {"tag": F.lit(None).cast(tags.schema["tag"].dataType), "i": F.lit(None).cast(said.schema["i"].dataType), "line": F.lit(None).cast(mine.schema["line"].dataType)}

    def events(tag_at: str, line_at: str, tag_first: int) -> DataFrame:
        theirs = tags.select(doc, none["i"].alias("i"), none["line"].alias("line"), "tag", F.col(f"tag.{tag_at}").alias("pos"), F.lit(tag_first).alias("kind"))
        return theirs.unionByName(mine.where("line.start IS NOT NULL").select(doc, "i", "line", none["tag"].alias("tag"), F.col(f"line.{line_at}").alias("pos"), F.lit(1 - tag_first).alias("kind")))

    up, down = (Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (["pos", "kind", "tag.start"], [F.desc("pos"), F.desc("kind"), F.desc("tag.end")]))
    before = events("end", "start", 0).withColumn("before", F.last("tag", ignorenulls=True).over(up)).where("i IS NOT NULL").select(doc, "i", "before")
    after = events("start", "end", 1).withColumn("after", F.last("tag", ignorenulls=True).over(down)).where("i IS NOT NULL").select(doc, "i", "after")
    held = events("start", "start", 1).withColumn("_l", F.last(F.when(F.col("i").isNotNull(), F.struct("i", "line")), ignorenulls=True).over(up)).where("tag IS NOT NULL AND _l IS NOT NULL")
    within = (F.col("tag.end") <= F.col("_l.line.end")) & ((F.col("tag.start") > F.col("_l.line.start")) | (F.col("tag.end") < F.col("_l.line.end")))
    inside = held.where(within).groupBy(doc, F.col("_l.i").alias("i")).agg(F.sort_array(F.collect_list(F.struct("tag.start", "tag.end", "tag.text"))).alias("inside"))
    rows = said.join(before, [doc, "i"], "left").join(after, [doc, "i"], "left").join(inside, [doc, "i"], "left")
    rows = rows.withColumn("inside", F.coalesce("inside", F.array().cast("array<struct<start:int,end:int,text:string>>")))
    # a chapter's text meets its lines once, as one row
    whole = rows.groupBy(doc).agg(F.collect_list(F.struct("i", "text", "start", "end", "before", "after", "inside")).alias("lines")).join(chapters.select(doc, F.col("text").alias("_body")), doc, "left")
    return whole.select(doc, F.explode(F.transform("lines", lambda x: F.struct(x["i"].alias("i"), _rebuilt(x, F.col("_body")).alias("text")))).alias("l")).select(doc, "l.*")
