"""Curated lines held against parsed ones, and clips to be renamed without overwriting one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from dialoom.functions.cues import _quoted, normal
from dialoom.operators.folding import folded

PREFIX, REACH = 20, 300
# Names of narration, and of a voice that tells of itself.
NARRATION, PROTAGONIST = ("narrator", "narration"), "protagonist"


def audited_lines(curated: DataFrame, parsed: DataFrame, key, doc: str = "doc_id", chapters: DataFrame | None = None) -> DataFrame:
    """curated (doc, i, text, name) and parsed (doc, i, text, selected, pool[, start, end]) -> doc, i, at, positional, verdict[, in_window].

    Lines are numbered from 0. A chapter with as many parsed lines as curated ones whose first lines begin alike is matched line by
    line, another one by the text's key, key(column): the first parsed line of that key, or else its first line. A line without a
    name, or in a chapter without parsed lines, is unlabeled. chapters (doc, text) tells whether the name of a blind spot
    stands near the parsed line.
    """
    begin = lambda df: df.groupBy(doc).agg(F.count("*").alias("n"), F.min_by(F.substring(key(F.col("text")), 1, PREFIX), "i").alias("first"))
    ours, theirs = begin(curated), begin(parsed).withColumnsRenamed({"n": "_n", "first": "_first"})
    alike = (F.col("n") == F.col("_n")) & ((F.coalesce("first", F.lit("")) == "") | (F.coalesce("_first", F.lit("")) == "") | (F.col("first") == F.col("_first")))
    mode = ours.join(theirs, doc, "left").select(doc, F.coalesce(alike, F.lit(False)).alias("positional"))
    by_key = parsed.groupBy(doc, key(F.col("text")).alias("_key")).agg(F.min("i").alias("_at"))
    rows = curated.withColumn("_key", key(F.col("text"))).join(mode, doc).join(by_key, [doc, "_key"], "left")
    rows = rows.withColumn("at", F.when(F.col("positional"), F.col("i")).otherwise(F.coalesce("_at", F.lit(0))))
    spans = [F.col(c).alias(f"_{c}") for c in ("start", "end") if c in parsed.columns]
    found = rows.join(parsed.select(doc, F.col("i").alias("at"), "selected", "pool", F.lit(True).alias("_found"), *spans), [doc, "at"], "left")
    name, pool = normal(F.col("name")), F.transform(F.coalesce("pool", F.array().cast("array<string>")), normal)
    verdict = (
        F.when(F.col("_found").isNull() | (F.coalesce("name", F.lit("")) == ""), "unlabeled").when(name.isin(*NARRATION), "narration").when(normal(F.col("selected")) == name, "correct")
        .when(F.array_contains(pool, name), "scoring_gap").when(F.array_contains(pool, PROTAGONIST), "correct").otherwise("blind_spot")
    )
    found = found.withColumn("verdict", verdict).withColumn("at", F.when(F.col("_found"), F.col("at")))
    columns = [doc, "i", "at", "positional", "verdict"]
    if chapters is None:
        return found.select(*columns)
    start, end = F.greatest(F.lit(0), F.coalesce("_start", F.lit(0)) - REACH), F.coalesce("_end", F.lit(0)) + REACH
    # windows are cut where the chapter is, so that no line carries its text
    asked = found.where("verdict = 'blind_spot'").groupBy(doc).agg(F.collect_list(F.struct("i", start.alias("a"), end.alias("b"), "name")).alias("asked"))
    near = lambda x: F.regexp_like(F.substring(F.col("_text"), x["a"] + 1, x["b"] - x["a"]), F.concat(F.lit(r"(?iU)\b"), _quoted(x["name"]), F.lit(r"\b")))
    seen = asked.join(chapters.select(doc, F.col("text").alias("_text")), doc).select(doc, F.explode(F.transform("asked", lambda x: F.struct(x["i"].alias("i"), near(x).alias("in_window")))).alias("s")).select(doc, "s.*")
    return found.select(*columns).join(seen, [doc, "i"], "left")


def rename_plans(clips: DataFrame, existing: DataFrame | Column, folder: str, least_score: float = 0.0, mismatches: bool = False) -> DataFrame:
    """clips (folder, i, source, destination, status, expected, best, score) and existing (folder, name) -> folder, i, source, destination, outcome, safe.

    In order of i, a flagged clip is planned to move where its best line's clip belongs, unless it is there already (in_place), scores
    too low, has no file, or shares its source or destination with an earlier planned one. A planned move onto a file that is not
    itself to be moved is taken. safe tells whether a planned move stays possible when those that are taken stay where they
    are: chains of moves that end at such a file are not, cycles are. A folder is one group of names. Where the clips' sources are all
    the files there are, existing is the condition on clips whose source is there.
    """
    flagged = F.col("status").isin("likely_wrong_line", *(["mismatch"] if mismatches else []))
    score = F.nanvl(F.col("score").cast("double"), F.lit(None))
    known = F.col("source").isNotNull() & F.col("destination").isNotNull() & F.col("expected").isNotNull() & F.col("best").isNotNull() & score.isNotNull()
    refused = F.when(~known, "invalid").when(score < least_score, "low_score")
    here = existing if isinstance(existing, Column) else F.lit(False)
    rows = clips.select(
        folder, F.col("i").cast("long").alias("i"), "source", "destination", F.coalesce(flagged, F.lit(False)).alias("flagged"), refused.alias("refused"), (F.col("expected") == F.col("best")).alias("in_place"), (here & F.col(folder).isNotNull() & F.col("source").isNotNull()).alias("here")
    ).where("flagged OR here")
    if not isinstance(existing, Column):
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        files = existing.where(F.col(folder).isNotNull() & F.col("name").isNotNull())
        rows = rows.unionByName(files.select(folder, none("long", "i"), F.col("name").alias("source"), none("string", "destination"), F.lit(False).alias("flagged"), none("string", "refused"), none("boolean", "in_place"), F.lit(True).alias("here")))
    schema = StructType([rows.schema[folder], *(StructField(*f) for f in (("i", LongType()), ("source", StringType()), ("destination", StringType()), ("outcome", StringType()), ("safe", BooleanType())))])
    return folded(rows, folder, ["i"], _planned, schema)


def _planned(folder: object, rows: list[tuple]) -> list[tuple]:
    """Of one folder's clips and files, (folder, i, source, destination, outcome, safe) of each clip that is flagged."""
    held = {r[1] for r in rows if r[6]}
    moves: dict[str, str] = {}
    into: dict[str, str] = {}
    out = []
    for i, source, destination, flagged, refused, in_place, _ in rows:
        if not flagged:
            continue
        if refused is None:
            refused = "missing_source" if source not in held else "in_place" if in_place else "duplicate_source" if source in moves else "duplicate_destination" if destination in into else None
        if refused is None:
            moves[source] = destination
            into[destination] = source
        out.append((folder, i, source, destination, refused or "planned", refused is None))
    blocked = {s for s, d in moves.items() if d in held and d != s and d not in moves}
    if not blocked:
        return out
    stuck = set(blocked)
    for s in blocked:  # whatever would follow into a place that is not left
        while (s := into.get(s)) is not None and s not in stuck:
            stuck.add(s)
    return [(*r[:4], "taken" if r[5] and r[2] in blocked else r[4], r[5] and r[2] not in stuck) for r in out]
