"""Follow-ups, gated episodes and training rows on small fixtures."""

import pytest

from pyspark.sql import functions as F

from dialoom.operators import sequence, training


def test_same_speaker_followup(spark):
    said = ["ann", "n", "bob", "ann", None, "n", "bob", "ann", "", "n", ""]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "c int, i int, s string")
    found = {}
    for window in (2, None):
        out = sequence.same_speaker_followup(F.col("i"), F.col("s"), F.col("s") == "n", ["c"], ["i"], window)
        found[window] = {r.i: r.x for r in rows.select("i", out.alias("x")).collect() if r.x is not None}
    assert found[2] == {0: 3} and found[None] == {2: 6}
    turns = spark.createDataFrame([(1, i, s) for i, s in enumerate(["ann", "n", "n", "n", "ann"])], "c int, i int, s string")
    out = sequence.same_speaker_followup(F.col("i"), F.col("s"), F.col("s") == "n", ["c"], ["i"])
    assert [r.x for r in turns.select("i", out.alias("x")).orderBy("i").collect()] == [4, None, None, None, None]


JAKE = [("Jake", 0.98)]
BOTH = [("Jake", 0.55), ("Viper", 0.52)]


@pytest.mark.parametrize(
    "lines, want",
    [
        ([(1, "Jake", JAKE, True, False), (2, "Jake", BOTH, False, True), (3, "Jake", JAKE, True, False)], ["Jake", "Viper", "Jake"]),
        ([(1, "Jake", JAKE, True, False), (2, "Jake", BOTH, True, False), (3, "Jake", JAKE, True, False)], ["Jake"] * 3),
        ([(1, "Jake", JAKE, True, False), (2, "Jake", BOTH, False, False), (3, "Jake", JAKE, True, False)], ["Jake"] * 3),
        ([(1, "Jake", JAKE, True, False), (2, "Jake", BOTH, False, True), (3, "Jake", JAKE, False, False)], ["Jake"] * 3),  # one anchor
        ([(1, "Jake", JAKE, True, False), (2, "Jake", [*BOTH, ("Ann", 0.1)], False, True), (3, "Jake", JAKE, True, False)], ["Jake"] * 3),  # three participants
        ([(1, "Jake", JAKE, True, False), (2, "Jake", BOTH, False, True), (4, "Jake", JAKE, True, False)], ["Jake"] * 3),  # the episode ends before
    ],
)
def test_decoded_episodes(spark, lines, want):
    kind = "c int, i int, paragraph int, speaker string, candidates array<struct<name:string,confidence:double>>, hard boolean, suggestion boolean"
    rows = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], kind)
    found = sequence.decoded_episodes(rows, ["c"], "i").orderBy("i").collect()
    assert [r.decoded for r in found] == want
    assert [r.overridden for r in found] == [a != x[1] for a, x in zip(want, lines)]


def test_training_rows(spark):
    raw = "  Hi, said Ann. Bye."
    lines = [
        (1, 0, "ann", 2, 5, "Hi,"), (1, 1, None, 0, 1, "x"), (1, 2, " ", 0, 1, "x"), (1, 3, "bob", -1, 2, "x"), (1, 4, "bob", 5, 4, "x"),
        (1, 5, "bob", 20, 21, "x"), (1, 6, "bob", None, 4, "x"), (1, 7, "bob", 16, 99, "Bye!"), (1, 8, "narrator", 5, 15, " said Ann."),
    ]
    lines = spark.createDataFrame(lines, "c int, i int, character string, start int, end int, text string")
    chapters = spark.createDataFrame([(1, raw)], "c int, raw string")
    found = training.training_rows(lines, chapters, ["c"], "i", "S", 1.0, reach=4).orderBy("i").collect()
    assert [r.outcome for r in found] == ["kept", "unlabeled", "unlabeled", *["invalid_span"] * 4, "kept", "kept"]
    assert [r.i for r in found if r.clipped] == [7] and [r.i for r in found if r.mismatch] == [7]
    assert [m.content for m in found[0].messages] == ["S", "Scene Characters:  , ann, bob\nLast Speaker: None\n\nContext:\n<quote>Hi,</quote> sai", "ann"]
    assert found[7].messages[1].content.endswith("Context:\nnn. <quote>Bye.</quote>") and found[8].messages[2].content == "None"
    none = training.training_rows(lines, chapters, ["c"], "i", "S", 0.0).where("i = 8").first()
    assert none.outcome == "excluded" and none.messages is None
