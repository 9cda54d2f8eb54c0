"""Readers of chapters, dialogue, characters and model outputs, and writers of rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.text import chapter_number


def folder_of(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


#: The control characters that bytes 0x80 to 0x9F are in Latin-1, and what they are in Windows-1252; undefined ones are replaced.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, text): whole files by name, wherever they lie below root; bytes that are not UTF-8 as Windows-1252."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.translate(F.decode("content", "ISO-8859-1"), CONTROLS, WINDOWS))
    return files.select("path", text.alias("text"))


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """(chapter, path, text): every chapter.txt below root, whole and with its own line ends."""
    files = _files(spark, root, "chapter.txt")
    return files.select(folder_of(F.col("path")).alias("chapter"), "path", "text").where(~F.col("chapter").startswith("."))


LINES = "struct<formatVersion:string,reviewed:boolean,lines:array<struct<id:int,characterId:string,chosenSpeaker:string,text:string,span:struct<start:int,end:int>,isConflict:boolean>>>"


def read_dialogue(spark: SparkSession, root: str, name: str = "dialogue.json") -> DataFrame:
    """(chapter, reviewed, at, line_id, character, text, start, end, is_conflict), v1 names where there is no id; unreadable files give one row without lines."""
    files = _files(spark, root, name)
    rows = files.select(folder_of(F.col("path")).alias("chapter"), F.from_json("text", LINES, {"mode": "PERMISSIVE"}).alias("d"))
    rows = rows.select("chapter", "d.reviewed", F.posexplode_outer("d.lines").alias("at", "l"))
    character = F.coalesce(F.nullif(F.trim("l.characterId"), F.lit("")), F.nullif(F.trim("l.chosenSpeaker"), F.lit("")))
    return rows.select("chapter", "reviewed", "at", F.col("l.id").alias("line_id"), character.alias("character"), F.coalesce("l.text", F.lit("")).alias("text"), "l.span.start", "l.span.end", F.coalesce("l.isConflict", F.lit(False)).alias("is_conflict"))


def chapter_list(chapters: DataFrame, dialogue: DataFrame) -> DataFrame:
    """(chapter, parsed, reviewed), every chapter once."""
    seen = dialogue.groupBy("chapter").agg(F.coalesce(F.bool_or("reviewed"), F.lit(False)).alias("reviewed"))
    found = chapters.select("chapter").distinct().join(seen, "chapter", "left")
    return found.select("chapter", F.col("reviewed").isNotNull().alias("parsed"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))


CHARACTER = "struct<guid:string,id:string,title:string,name:string,gender:string,aliases:array<string>,descriptors:array<string>>"


def read_characters(spark: SparkSession, root: str) -> DataFrame:
    """(guid, title, gender, aliases, descriptors, path): one JSON file each; files without a title or guid are left out."""
    files = _files(spark, root, "*.json")
    rows = files.select(F.from_json("text", CHARACTER).alias("c"), "path")
    rows = rows.select(F.coalesce("c.guid", "c.id").alias("guid"), F.coalesce("c.title", "c.name").alias("title"), "c.gender", F.coalesce("c.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("c.descriptors", F.array().cast("array<string>")).alias("descriptors"), "path")
    return rows.where("guid <> '' AND title <> ''")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header, a byte-order mark allowed, fields of any length."""
    return spark.read.option("maxCharsPerColumn", "-1").csv(path, sep="\t", header=True, quote="")


def quote_spans(quotes: DataFrame, tokens: DataFrame, doc: str = "doc") -> DataFrame:
    """quotes (doc, q, quote_start, quote_end exclusive) and tokens (doc, token_id, onset, offset) -> start, end in characters.

    Two equality joins, on the first and the last token.
    """
    t = tokens.select(doc, "token_id", "onset", "offset")
    a = t.select(doc, F.col("token_id").alias("quote_start"), F.col("onset").alias("start"))
    b = t.select(doc, (F.col("token_id") + 1).alias("quote_end"), F.col("offset").alias("end"))
    return quotes.join(a, [doc, "quote_start"], "left").join(b, [doc, "quote_end"], "left")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, sep: str = ",", digits: int = 6) -> None:
    """CSV or TSV with a header and fractions of fixed length."""
    shown = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").csv(path, header=True, sep=sep)


def chapters_in_range(chapters: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """chapters whose folder begins with a number from first to last, with that number; sort by (number, lower(chapter))."""
    numbered = chapters.withColumn("number", chapter_number(F.col("chapter"))).where(F.col("number") >= first)
    return numbered if last is None else numbered.where(F.col("number") <= last)


MANIFEST = "struct<formatVersion:string,character:string,metadata:struct<character:string,provider:string,voice:string>,clips:array<struct<line_id:int,file:string,text:string>>>"


def read_voice_manifests(spark: SparkSession, root: str, schema: str = MANIFEST, version: str = "2.0") -> DataFrame:
    """(path, manifest): every manifest.json below root of that format; files that cannot be read are left out."""
    rows = _files(spark, root, "manifest.json").select("path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("manifest"))
    return rows.where(F.col("manifest.formatVersion") == version)


def stripped_lines(lines: DataFrame) -> DataFrame:
    """Exactly line_id, character and span; a missing column is an error."""
    return lines.select("line_id", "character", F.struct("start", "end").alias("span"))
