"""Lines of dialogue files of several versions, read from JSON as one shape.

A line is a JSON text. Newer files name a speaker by the id of a character, and candidates likewise; older ones have names. A value of
another type than it should have counts as absent, as does a text that is not JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.scalars import clamped

UNKNOWN, NARRATOR = "Unknown", "narrator"


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def number_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def text_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def flag_at(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def texts_at(v: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, lambda x: text_at(x, "$")), lambda x: x.isNotNull())


def decision_trace(v: Column) -> Column:
    """(selected, pool, reasons, rule) of a line's attribution."""
    base = "$.attribution.decisionTrace"
    return F.struct(
        text_at(v, f"{base}.selectedCandidate").alias("selected"), texts_at(v, f"{base}.rawCandidatePool").alias("pool"), texts_at(v, f"{base}.selectedReasons").alias("reasons"), text_at(v, "$.attribution.legacyRule").alias("rule"),
    )


def hard_line(trace: Column, hard: tuple[str, ...]) -> Column:
    """Whether a decision stands on one of the hard reasons or rules."""
    return F.arrays_overlap(trace["reasons"], F.array(*map(F.lit, hard))) | F.coalesce(trace["rule"].isin(*hard), F.lit(False))


def canonical_names(characters: DataFrame) -> DataFrame:
    """(key, canonical): lower-case aliases, names and slugs of characters (ord, id, name, aliases); aliases go before names, names before slugs.

    Of several characters with one alias or name the last one has it, of several with one slug the first.
    """
    named = characters.where("name <> ''")
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-"), "^-+|-+$", "")
    entry = lambda rank, key, order: F.struct(F.lit(rank).alias("rank"), key.alias("key"), order.alias("order"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: entry(0, F.lower(F.trim(a)), -F.col("ord")))
    keys = F.concat(aliases, F.array(entry(1, F.lower("name"), -F.col("ord")), entry(2, slug, F.col("ord"))))
    rows = named.select("name", F.explode(keys).alias("e")).where("e.key <> ''")
    return rows.groupBy("e.key").agg(F.min_by("name", F.struct("e.rank", "e.order")).alias("canonical"))


def normalized_lines(lines: DataFrame, characters: DataFrame, keys: list[str], body: str = "body", threshold: float = 0.5, unknown: str = UNKNOWN) -> DataFrame:
    """keys, name, candidates (name, confidence), confidence, top, margin, risk, status, conflict, non_speaker, returning, start, end, changed.

    keys tell lines apart. Ids stand for the characters' names, unknown ids for themselves; then names are canonical_names(). A span of
    0 to 0 is none. A line is unknown without a speaker or with a best candidate below the threshold, unless a user has confirmed it;
    an unknown line has the unknown label and is in conflict. changed tells whether canonical names differ from the file's.
    """
    v = F.try_parse_json(F.col(body))
    rows = lines.select(*keys, v.alias("_v")).withColumn("_new", _kind(F.col("_v"), "$.characterId").isNotNull())
    v, new = F.col("_v"), F.col("_new")
    attribution = lambda of, path: F.coalesce(of(v, f"$.attribution.{path}"), F.when(new & _kind(v, "$.attribution").rlike("^(?!OBJECT)|^$") | new & _kind(v, "$.attribution").isNull(), of(v, f"$.metadata.customTags.attribution.{path}")))
    listed = F.coalesce(F.try_variant_get(v, "$.candidates", "array<variant>"), F.array().cast("array<variant>"))
    candidate = lambda c: F.struct(F.when(new, text_at(c, "$.characterId")).otherwise(text_at(c, "$.name")).alias("said"), clamped(F.try_variant_get(c, "$.confidence", "double")).alias("confidence"))
    rows = rows.select(
        *keys, "_new", F.when(new, text_at(v, "$.characterId")).otherwise(text_at(v, "$.chosenSpeaker")).alias("_said"), F.coalesce(flag_at(v, "$.isNonSpeaker"), F.lit(False)).alias("non_speaker"),
        F.transform(listed, candidate).alias("_listed"), F.coalesce(flag_at(v, "$.isConflict"), F.lit(False)).alias("_conflict"), F.coalesce(flag_at(v, "$.isReturning"), F.lit(False)).alias("returning"),
        number_at(v, "$.span.start").cast("long").alias("_start"), number_at(v, "$.span.end").cast("long").alias("_end"),
        attribution(number_at, "confidence").alias("_sure"), attribution(number_at, "misattributionRisk").alias("_risk"), attribution(text_at, "resolutionStatus").alias("_status"),
    )

    # the speaker first, then the candidates: each meets the catalogue once
    asked = rows.select(*keys, "_new", F.posexplode(F.concat(F.array(F.struct(F.col("_said").alias("said"), F.lit(0.0).alias("confidence"))), F.col("_listed"))).alias("_k", "_c")).select(*keys, "_new", "_k", F.nullif("_c.said", F.lit("")).alias("said"), F.col("_c.confidence").alias("confidence"))
    ids = characters.where("id IS NOT NULL").groupBy(F.lower("id").alias("_id")).agg(F.max_by("name", "ord").alias("_name"))
    asked = asked.join(ids, F.col("_new") & (F.lower("said") == F.col("_id")), "left").withColumn("shown", F.coalesce("_name", "said")).drop("_id", "_name")
    names = canonical_names(characters)
    asked = asked.join(names, F.lower(F.trim("shown")) == F.col("key"), "left")
    label = F.lit(unknown)
    canonical = F.when(F.lower(F.trim("shown")) == unknown.lower(), label).otherwise(F.coalesce("canonical", "shown"))
    met = asked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "shown", canonical.alias("canonical"), "confidence"))).alias("_met"))
    rows = rows.join(met, keys)

    own = F.col("_met")[0]
    shown = F.when(~(F.col("non_speaker") & F.col("_new")), own["shown"])
    offered = F.transform(F.slice("_met", 2, F.greatest(F.size("_met") - 1, F.lit(0))), lambda c: F.struct(F.coalesce(c["canonical"], label).alias("name"), c["confidence"].alias("confidence"), F.coalesce(c["shown"], label).alias("shown")))
    best = F.sort_array(F.transform("_offered", lambda c: c["confidence"]), asc=False)
    rows = rows.withColumns({"_shown": shown, "_offered": offered}).withColumn("_best", best)
    assigned = F.col("_shown").isNotNull() & (F.lower(F.trim("_shown")) != unknown.lower())
    n = F.size("_offered")
    top = F.when(n > 0, F.get("_best", F.lit(0))).otherwise(F.when(assigned, 1.0).otherwise(0.0))
    rows = rows.withColumn("top", top).withColumn("margin", F.greatest(F.lit(0.0), F.col("top") - F.coalesce(F.get("_best", F.lit(1)), F.lit(0.0))))
    lone = (F.lower(F.trim("_shown")) == NARRATOR) & (n == 0)
    status = (
        F.when(F.col("_status") == "user_confirmed", "user_confirmed").when(~F.coalesce(assigned, F.lit(False)), "unknown").when(lone, "auto").when((n > 0) & (F.col("top") < threshold), "unknown").otherwise("auto")
    )
    rows = rows.withColumn("status", status)
    unknown_line = (F.col("status") == "unknown") & ~F.col("non_speaker")
    before = F.when(unknown_line, label).when(~F.col("non_speaker"), F.col("_shown"))
    name = F.when(unknown_line, label).when(~F.col("non_speaker"), own["canonical"])
    changed = F.coalesce(name != before, F.lit(False)) | F.exists("_offered", lambda c: c["name"] != c["shown"])
    none = (F.col("_start") == 0) & (F.col("_end") == 0)
    return rows.select(
        *keys, name.alias("name"), F.transform("_offered", lambda c: F.struct(c["name"].alias("name"), c["confidence"].alias("confidence"))).alias("candidates"), clamped(F.coalesce("_sure", "top")).alias("confidence"), "top", "margin",
        clamped(F.coalesce("_risk", (1 - F.col("top")) * 0.7 + (1 - F.col("margin")) * 0.3)).alias("risk"), "status", (~F.col("non_speaker") & (F.col("_conflict") | (F.col("status") == "unknown"))).alias("conflict"),
        "non_speaker", "returning", F.when(~none, F.col("_start")).alias("start"), F.when(~none, F.col("_end")).alias("end"), changed.alias("changed"),
    )
