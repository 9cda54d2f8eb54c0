"""Tags of narration before, after and inside lines."""

from pyspark.sql import functions as F

from dialoom.operators import narration

BODY = "“Go,” she said. “Now!” He whispered: “Stay.” Long ago it was. “Yes,” “maybe.”"
LINES = "doc_id string, i int, text string, speaker string, start int, end int"


def line(i, text, speaker, whole=None):
    part = whole or text
    at = BODY.index(part)
    return ("c", i, text, speaker, at, at + len(part))


def test_tags_before_after_and_inside(spark):
    cells = [line(0, "Go,", "ann"), line(1, "she said.", "narrator"), line(2, "Now!", "ann"), line(3, "He whispered:", "narrator"), line(4, "Stay.", "bo"), line(5, "Long ago it was.", "narrator"), line(6, "Yes, maybe.", "bo", "Yes,” “maybe.")]
    cells += [("d", 0, "No span", "bo", None, None), ("d", 1, None, "bo", 5, 9), ("e", 0, "Go, Now!", "ann", 1, 21), ("e", 1, " she said. ", "narrator", 6, 15), ("f", 0, "x", None, 0, 3), ("f", 1, "he asked", "narrator", 4, 9)]
    lines = spark.createDataFrame(cells, LINES)
    chapters = spark.createDataFrame([("c", BODY), ("d", BODY), ("e", BODY)], "doc_id string, text string")
    found = {(r.doc_id, r.i): r.text for r in narration.tagged_texts(lines, chapters).collect()}
    assert found == {
        ("c", 0): "Go, she said", ("c", 2): "she said. Now! He whispered", ("c", 4): "He whispered. Stay.", ("c", 6): "Yes, maybe.", ("d", 0): "No span", ("d", 1): "",
        ("e", 0): "Go, she said. Now!", ("f", 0): "x he asked",
    }
    assert narration.tagged_texts(lines.limit(0), chapters).collect() == []


def test_short_tags(spark):
    cells = [("she said", True), ("aside", False), ("He said " + "a " * 10, True), ("He said " + "a " * 11, False), (None, False), ("", False)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in cells], "t string").select(narration.short_tag(F.col("t"))).collect()] == [w for _, w in cells]
