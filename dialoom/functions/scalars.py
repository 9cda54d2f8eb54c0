"""Numbers and arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null and NaN as low."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(low)), F.lit(low)), F.lit(low)), F.lit(high))


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))


def ordered_distinct(items: Column, fold_case: bool = False) -> Column:
    """Distinct items in the order in which they first appear, nulls left out."""
    items = F.filter(items, lambda x: x.isNotNull())
    if not fold_case:
        return F.array_distinct(items)
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def top_distinct(items: Column, k: int) -> Column:
    return F.slice(ordered_distinct(items), 1, k)


def joined(items: Column) -> Column:
    """An array as text, for results that are compared across engines."""
    return F.array_join(items.cast("array<string>"), ",")


def summed_map(keys: Column, mapping: Column, remap: Column) -> Column:
    """A map of counts under remapped keys: counts of keys that fall together are added; unmapped keys stay."""
    new = F.transform(keys, lambda k: F.coalesce(remap[k], k))
    total = lambda target: F.aggregate(F.filter(keys, lambda k: F.coalesce(remap[k], k) == target), F.lit(0).cast("long"), lambda a, k: a + mapping[k])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(new)), lambda t: F.struct(t, total(t))))


def prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Per element the sum of those before it: within blocks, then over the blocks' sums, so that time stays near the array's length."""
    none = F.array().cast("array<bigint>")
    step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
    begin = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out"))

    def blocks(x: Column) -> Column:
        count = F.ceil(F.size(x) / block).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda b: F.aggregate(F.slice(x, b * block + 1, F.lit(block)), begin, step))

    offsets = lambda made: F.aggregate(F.transform(made, lambda b: b["sum"]), begin, step, lambda s: s["out"])
    joined = lambda made: F.flatten(F.zip_with(made, offsets(made), lambda b, at: F.transform(b["out"], lambda x: x + at)))
    return let(lengths, lambda x: let(blocks(x), joined))


def greedy_starts(lengths: Column, most: int, least: int | None = None) -> Column:
    """Places, from 0, at which the groups of consecutive items begin, for items joined by one blank.

    A group ends before an item that would take it past `most`, and where it has reached `least`, if that is given. With `least`
    a last group short of it goes to the one before, if both fit within `most`. An item longer than `most` is a group of its own.
    Only a new group copies the places, so time grows with the items and the square of the groups.
    """
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("before"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, n: Column) -> Column:
        n = F.coalesce(n.cast("long"), F.lit(0).cast("long"))
        full = s["size"] + 1 + n > most
        new = (s["i"] == 0) | (full if least is None else full | (s["size"] >= least))
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(new, n).otherwise(s["size"] + 1 + n).alias("size"), F.when(new, s["size"]).otherwise(s["before"]).alias("before"),
            F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
        )

    def end(s: Column) -> Column:
        if least is None:
            return s["starts"]
        short = (F.size(s["starts"]) > 1) & (s["size"] < least) & (s["before"] + 1 + s["size"] <= most)
        return F.when(short, F.slice(s["starts"], 1, F.size(s["starts"]) - 1)).otherwise(s["starts"])

    return F.aggregate(lengths, begin, step, end)


def stretches(starts: Column, n: Column, body) -> Column:
    """body(k, first, size) of each of the stretches of n items that begin at the places."""
    return F.transform(starts, lambda at, k: body(k, at, F.coalesce(F.get(starts, k + 1), n) - at))


def let(value: Column, body) -> Column:
    """body of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]
