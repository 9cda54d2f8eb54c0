"""Stages of the pipeline on small fixtures with nulls, repeated rows, an empty table and a column named as an operator's own."""

import pytest

from dialoom.llm import stages

KIND = "doc_id long, text string, lang string, source string, n_chars long, spans string"
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "en", "a", len(LONG), "s"), (2, LONG, "en", "b", len(LONG), None), (3, None, "en", "a", None, "s"), (4, "", "en", "a", 0, "s"),
    (5, "the password is kqzvwxjtrbnmplh", "en", "b", 31, "s"), (5, "the password is kqzvwxjtrbnmplh", "en", "b", 31, "s"), (None, "no id", "en", "a", 5, "s"),
]


@pytest.mark.parametrize("stage, drop, change", [("keep_one_of_each", {2}, {}), ("mask_secrets", set(), {5: ("the password is [SECRET]", 24)})])
def test_stage(spark, stage, drop, change):
    made = getattr(stages, stage)
    found = made(spark, spark.createDataFrame(ROWS, KIND), "")
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans"]
    want = [r if r[0] not in change else (r[0], change[r[0]][0], *r[2:4], change[r[0]][1], r[5]) for r in ROWS if r[0] not in drop]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert made(spark, spark.createDataFrame([], KIND), "").count() == 0
