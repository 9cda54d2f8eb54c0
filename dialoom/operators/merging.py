"""Catalogues and references carried over to curated characters: records merged by id, ids rewritten, and what is left stale.

Ids meet their replacements by joins, so a catalogue, a map and the lines may be of any size; what is folded are the few names of one
character that may take another's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.scalars import let


def _clean(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def name_quality(name: Column) -> Column:
    """(casing, length): 3 for words that all begin with their only capital, 2 for mixed case, 1 for capitals only, 0 for none."""
    upper, lower = name.rlike(r"[\p{Lu}\p{Lt}]"), name.rlike(r"\p{Ll}")
    titled = upper & ~name.rlike(r"\p{L}\p{Lu}|(?<!\p{L})\p{Ll}")
    casing = F.when(name.isNull(), 0).when(titled, 3).when(upper & lower, 2).when(upper, 1).otherwise(0)
    return F.struct(casing.alias("casing"), F.coalesce(F.length(name), F.lit(0)).alias("length"))


def gender_quality(gender: Column) -> Column:
    return F.when(gender.isNull(), 0).when(F.lower(gender) == "unknown", 1).otherwise(2)


def combined_characters(records: DataFrame) -> DataFrame:
    """records (ord, id, name, gender, aliases) -> id, place, name, gender, aliases, rows: one character per id, in the order of records.

    A name of better casing, or as good and longer, takes the place of the one before it, which becomes an alias; other names are
    aliases, as are the records' own, each by its first spelling and none equal to the name. The latest of the best known genders
    stays. What is folded per id are only the names that may take another's place: once a name was there, the one that stays is as
    good as the least of its spellings at least. A record without an id raises nothing and is left out.
    """
    rows = records.select("ord", _clean(F.col("id")).alias("id"), _clean(F.col("name")).alias("name"), _clean(F.col("gender")).alias("gender"), "aliases").where("id IS NOT NULL")
    whole = rows.groupBy("id").agg(F.min("ord").alias("place"), F.count("*").alias("rows"), F.max_by("gender", F.struct(gender_quality(F.col("gender")), "ord")).alias("gender"))
    named = rows.where("name IS NOT NULL").select("id", "ord", "name", F.lower("name").alias("low"), name_quality(F.col("name")).alias("q"))
    least = named.groupBy("id", "low").agg(F.min("ord").alias("ord"), F.min("q").alias("q")).groupBy("id", "q").agg(F.min("ord").alias("ord"))
    least = least.groupBy("id").agg(F.collect_list(F.struct("ord", "q")).alias("least"))
    held = named.join(least, "id").where(~F.exists("least", lambda x: (x["ord"] < F.col("ord")) & (x["q"] >= F.col("q"))))
    held = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "low", "q"))).alias("held"))
    first = F.struct(F.lit(None).cast("string").alias("low"), name_quality(F.lit(None).cast("string")).alias("q"), F.array().cast(f"array<struct<ord:{rows.schema['ord'].dataType.simpleString()},name:string>>").alias("made"))

    def step(s: Column, e: Column) -> Column:
        better = (e["q"] > s["q"]) & ~F.coalesce(e["low"] == s["low"], F.lit(False))
        return F.when(better, F.struct(e["low"].alias("low"), e["q"].alias("q"), F.concat(s["made"], F.array(F.struct(e["ord"].alias("ord"), e["name"].alias("name")))).alias("made"))).otherwise(s)

    #: made: the names of an id that took another's place, in order, from where on each was there
    made = held.select("id", F.aggregate("held", first, step, lambda s: s["made"]).alias("made"))
    last = F.try_element_at("made", F.lit(-1))["name"]
    before = F.try_element_at(F.filter("made", lambda x: x < F.struct("ord", "name")), F.lit(-1))["name"]
    took = F.exists("made", lambda x: x == F.struct("ord", "name"))
    own = let(before, lambda old: F.when(took, old).when(~F.coalesce(F.lower("name") == F.lower(old), F.lit(False)), F.col("name")))
    none = F.array().cast("array<string>")
    told = rows.join(made, "id", "left").select("id", "ord", F.lower(last).alias("last"), F.posexplode(F.concat(F.array(own), F.transform(F.coalesce("aliases", none), _clean))).alias("k", "text"))
    told = told.where("text IS NOT NULL AND (last IS NULL OR lower(text) <> last)").groupBy("id", F.lower("text").alias("low")).agg(F.min(F.struct("ord", "k", "text")).alias("a"))
    told = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["text"]).alias("aliases"))
    return whole.join(made, "id", "left").join(told, "id", "left").select("id", "place", last.alias("name"), "gender", F.coalesce("aliases", none).alias("aliases"), "rows")


def minting_order(clusters: DataFrame, group: list[str]) -> DataFrame:
    """clusters (first, name) with place: by first appearance, those without one last, then by name without case."""
    order = [F.col("first").isNull(), F.coalesce("first", F.lit("")), F.lower(F.coalesce("name", F.lit(""))), F.col("name")]
    return clusters.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def _targets(rows: DataFrame, mapping: DataFrame, id: str) -> DataFrame:
    """rows with target: what mapping (old, new) makes of the id, else the id itself."""
    one = mapping.groupBy(_clean(F.col("old")).alias("_old")).agg(F.max(_clean(F.col("new"))).alias("_new"))
    cleaned = rows.withColumn("_id", _clean(F.col(id)))
    return cleaned.join(one, F.col("_id") == F.col("_old"), "left").withColumn("target", F.coalesce("_new", "_id")).drop("_old", "_new", "_id")


def curated_catalog(records: DataFrame, master: DataFrame, mapping: DataFrame, book: str, extended: list[str]) -> tuple[DataFrame, DataFrame]:
    """(characters, stats) of books' records (book, ord, id, name, gender, *extended): ids mapped, curated fields from master (id, name, gender).

    Records of characters that master lacks are removed. Records that fall together are one, at the first one's place; the first
    record that had the id all along comes first, then the others in order, and an extended field is the first that is not
    null. stats counts per book: updated, removed, deduplicated.
    """
    joined = _targets(records, mapping, "id").join(master.select(F.col("id").alias("target"), F.col("name").alias("_name"), F.col("gender").alias("_gender"), F.lit(True).alias("_known")), "target", "left")
    known = F.coalesce("_known", F.lit(False))
    same = F.col("id").eqNullSafe(F.col("target")) & F.col("name").eqNullSafe(F.col("_name")) & F.col("gender").eqNullSafe(F.col("_gender"))
    kept = joined.where(known)
    direct = F.col("id") == F.col("target")
    first = F.min(F.when(direct, F.col("ord"))).over(Window.partitionBy(book, "target"))
    kept = kept.withColumn("_order", F.struct(F.coalesce(F.col("ord") != first, F.lit(True)), "ord"))
    fields = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in extended]
    characters = kept.groupBy(book, F.col("target").alias("id")).agg(F.min("ord").alias("place"), F.first("_name").alias("name"), F.first("_gender").alias("gender"), *fields)
    stats = joined.groupBy(book).agg(
        F.count_if(known & ~same).alias("updated"), F.count_if(~known).alias("removed"), (F.count_if(known) - F.count_distinct(F.when(known, F.col("target")))).alias("deduplicated")
    )
    return characters, stats


def rewritten_references(lines: DataFrame, master: DataFrame, mapping: DataFrame, keys: list[str], id: str, nested: str) -> DataFrame:
    """lines with mapped ids and, per nested candidate (id, name, confidence), mapped ids and master's names; unknown ones are pruned.

    Adds line_ids, nested_ids, nested_names, nested_pruned (how many were changed) and missing (the line's id is not in master).
    keys tell lines apart.
    """
    names = master.groupBy(F.col("id").alias("target")).agg(F.max("name").alias("_name"))
    own = _targets(lines.select(*keys, id), mapping, id).join(names, "target", "left")
    own = own.select(*keys, F.col("target").alias("_target"), F.coalesce(F.trim(id) != F.col("target"), F.lit(False)).cast("int").alias("line_ids"), (F.col("target").isNotNull() & F.col("_name").isNull()).alias("missing"))
    each = lines.select(*keys, F.posexplode(nested).alias("_k", "_c")).select(*keys, "_k", F.col("_c.id").alias("_cid"), F.col("_c.name").alias("_cname"), F.col("_c.confidence").alias("_conf"))
    each = _targets(each, mapping, "_cid").join(names, "target", "left")
    held = F.col("_name").isNotNull()
    candidate = F.struct("_k", F.struct(F.col("target").alias("id"), F.when(F.col("_cname").isNotNull(), F.col("_name")).alias("name"), F.col("_conf").alias("confidence")).alias("c"))
    counted = each.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when(held, candidate))), lambda x: x["c"]).alias("_nested"), F.count_if(held & (F.trim("_cid") != F.col("target"))).alias("nested_ids"),
        F.count_if(held & (F.col("_cname") != F.col("_name"))).alias("nested_names"), F.count_if(~held).alias("nested_pruned"),
    )
    out = lines.join(own, keys, "left").join(counted, keys, "left")
    # a line without candidates keeps what it has
    return out.withColumns({id: F.col("_target"), nested: F.coalesce("_nested", nested), **{c: F.coalesce(c, F.lit(0)) for c in ("nested_ids", "nested_names", "nested_pruned")}}).drop("_target", "_nested")


def stale_references(lines: DataFrame, master: DataFrame, mapping: DataFrame, id: str, nested: str) -> DataFrame:
    """(site, stale, missing): references that a rewrite has left, by site; both are 0 after rewritten_references()."""
    sites = lines.select(F.lit("line").alias("site"), F.col(id).alias("_ref")).unionAll(lines.select(F.lit("nested").alias("site"), F.explode(F.transform(nested, lambda c: c["id"])).alias("_ref")))
    found = _targets(sites.where("_ref IS NOT NULL"), mapping, "_ref").join(master.select(F.col("id").alias("target")).distinct().withColumn("_known", F.lit(True)), "target", "left")
    return found.groupBy("site").agg(F.count_if(F.trim("_ref") != F.col("target")).alias("stale"), F.count_if(F.col("_known").isNull()).alias("missing"))
