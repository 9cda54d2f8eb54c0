"""Lines of older and newer files as one shape."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.operators import versions

CAST = [(0, "ID1", "Ann Lee", ["Annie"]), (1, "ID2", "Bo", None), (2, "ID3", "Ann-Lee", ["bo"])]


def test_lines_of_all_versions(spark):
    bodies = [
        {"characterId": "id1", "candidates": [{"characterId": "ID1", "confidence": 0.9}, {"characterId": "zz", "confidence": 0.4}, {"confidence": 7}], "span": {"start": 0, "end": 0}, "isReturning": True},
        {"chosenSpeaker": "annie", "candidates": [{"name": "ann-lee", "confidence": 0.3}, {"name": "", "confidence": "x"}], "span": {"start": 3, "end": 9}},
        {"chosenSpeaker": "annie", "candidates": [], "isConflict": True, "attribution": {"confidence": 0.25, "misattributionRisk": "no", "resolutionStatus": "user_confirmed"}},
        {"characterId": None, "candidates": [], "metadata": {"customTags": {"attribution": {"resolutionStatus": "user_confirmed"}}}},
        {"characterId": "ID2", "isNonSpeaker": True, "isConflict": True},
        {"chosenSpeaker": "narrator"}, {"chosenSpeaker": "Unknown"},
    ]
    lines = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(7, "{broken"), (8, None)], "k int, body string")
    cast = spark.createDataFrame(CAST, "ord int, id string, name string, aliases array<string>")
    found = {r.k: r for r in versions.normalized_lines(lines, cast, ["k"]).collect()}
    assert len(found) == 9
    shown = {k: (r.name, [tuple(c) for c in r.candidates], r.status, r.conflict, r.changed) for k, r in found.items()}
    assert shown == {
        0: ("Ann Lee", [("Ann Lee", 0.9), ("zz", 0.4), ("Unknown", 1.0)], "auto", False, False), 1: ("Unknown", [("Ann-Lee", 0.3), ("Unknown", 0.0)], "unknown", True, True),
        2: ("Ann Lee", [], "user_confirmed", True, True), 3: (None, [], "user_confirmed", False, False), 4: (None, [], "unknown", False, False), 5: ("narrator", [], "auto", False, False),
        6: ("Unknown", [], "unknown", True, False), 7: ("Unknown", [], "unknown", True, False), 8: ("Unknown", [], "unknown", True, False),
    }
    assert (found[0].start, found[0].returning, found[1].start, found[1].end) == (None, True, 3, 9)
    assert (found[2].confidence, found[2].top, found[2].margin, found[2].risk) == (0.25, 1.0, 1.0, 0.0)
    assert found[1].risk == pytest.approx(0.7 * 0.7 + 0.7 * 0.3)
    names = {r.key: r.canonical for r in versions.canonical_names(cast).collect()}
    assert names == {"annie": "Ann Lee", "bo": "Ann-Lee", "ann lee": "Ann Lee", "ann-lee": "Ann-Lee"}


def test_decision_traces(spark):
    bodies = ['{"attribution": {"decisionTrace": {"selectedCandidate": "Ann", "rawCandidatePool": ["Ann", 3, null], "selectedReasons": ["x", "hard"]}, "legacyRule": 5}}', '{"attribution": {"legacyRule": "rule"}}', '{"attribution": []}', None]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(versions.decision_trace(F.try_parse_json("b")).alias("t"))
    found = rows.select("t.*", versions.hard_line(F.col("t"), ("hard", "rule")).alias("hard")).collect()
    assert [tuple(r) for r in found] == [("Ann", ["Ann"], ["x", "hard"], None, True), (None, [], [], "rule", True), (None, [], [], None, False), (None, [], [], None, False)]
