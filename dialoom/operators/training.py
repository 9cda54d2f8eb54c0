"""Training rows: a line in its context, with the speaker as the answer, and why other lines give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators import sequence

NARRATOR, NOBODY = "narrator", "None"


def kept_share(key: Column, share: float) -> Column:
    """Whether a row stays in a sample of `share`: by the first 32 bits of its key's sha256, so that reruns agree."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(2.0**32) <= share


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def training_rows(lines: DataFrame, chapters: DataFrame, group: list[str], order: str, system: str, narrators: float, reach: int = 600, reference: str | None = None) -> DataFrame:
    """Every row of lines (group, order, character, start, end, text) with its outcome, held against chapters (group, raw).

    outcome: unlabeled, excluded (a narrator's line out of the sample), invalid_span or kept; clipped: the span ends after
    the chapter; mismatch: the line's text is not the chapter's; messages: null unless kept. Neighbours are taken from all lines.
    """
    who = F.when(~F.col("character").isin("", NARRATOR, NOBODY), F.col("character"))
    roster = F.array_join(sequence.roster(who, group, [order]), ", ")
    near = lines.withColumns({
        "_roster": F.when(roster == "", NOBODY).otherwise(roster), "_last": F.coalesce(sequence.last_known(who, group, [order]), F.lit(NOBODY)),
    })
    rows = near.join(chapters, group, "left").withColumns({"_n": F.length(F.coalesce("raw", F.lit(""))), "_raw": F.coalesce("raw", F.lit(""))})
    sampled = kept_share(F.concat_ws(":", *(F.col(c).cast("string") for c in (*group, order))), narrators)
    wrong = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("start") >= F.col("_n"))
    outcome = (
        F.when(F.coalesce(stripped(F.col("character")) == "", F.lit(True)), "unlabeled").when((F.col("character") == NARRATOR) & ~sampled, "excluded")
        .when(wrong, "invalid_span").otherwise("kept")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("_end", F.least("end", "_n"))
    kept, cut = F.col("outcome") == "kept", lambda a, b: F.substr("_raw", (a + 1).cast("int"), (b - a).cast("int"))
    start, end, least = F.col("start"), F.col("_end"), F.greatest(F.lit(0), F.col("start") - reach)
    target = cut(start, end)
    context = stripped(F.concat(cut(least, start), F.lit("<quote>"), target, F.lit("</quote>"), cut(end, F.least(F.col("_n"), end + reach))))
    head = F.lit("" if reference is None else f"Character Reference (JSON):\n{reference}\n\n")
    user = F.concat(head, F.lit("Scene Characters: "), "_roster", F.lit("\nLast Speaker: "), "_last", F.lit("\n\nContext:\n"), context)
    answer = F.when(F.col("character") == NARRATOR, NOBODY).otherwise(F.col("character"))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(
        *group, order, "outcome", (kept & (F.col("end") > F.col("_n"))).alias("clipped"), (kept & F.coalesce(F.col("text") != target, F.lit(False))).alias("mismatch"),
        F.when(kept, F.array(said("system", F.lit(system)), said("user", user), said("assistant", answer))).alias("messages"),
    )
