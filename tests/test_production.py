"""Plans, times and agreement on small tables with nulls, ties, repeated and empty inputs."""

import pytest
from pyspark.sql import functions as F

from dialoom.operators import agreement, planning, timing


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_times_never_run_back_and_fill_gaps(spark):
    lines = spark.createDataFrame([(1, i, 10.0) for i in range(5)] + [(2, 0, 3.0)], "g int, line int, duration double")
    matches = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 2, 0), (1, 3, 3)], "g int, line int, word int")
    words = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 1, None, None), (1, 2, 4.0, 5.0), (1, 3, 6.0, 99.0)], "g int, word int, start double, end double")
    found = rows(timing.line_times(lines, matches, words, "g", "duration"), "g", "line", "start", "end", "matched", "first_word", "last_word")
    assert found == [
        (1, 0, 4.0, 5.0, 2, 1, 2),  # word 1 has no start: the next one's
        (1, 1, 5.0, 5.0, 0, 2, 2),  # nothing matched: the word before
        (1, 2, 5.0, 5.0, 1, 0, 0),  # would run back
        (1, 3, 6.0, 10.0, 1, 3, 3),  # would pass the duration
        (1, 4, 10.0, 10.0, 0, 3, 3),
        (2, 0, 0.0, 3.0, 0, 0, 0),  # no words at all
    ]


def test_boundaries(spark):
    anchors = spark.createDataFrame([(1, 5.0), (2, 7.00001)], "k int, anchor double")
    runs = spark.createDataFrame([(1, 0, 4.0, 1.0), (1, 1, 6.0, 2.0), (1, 2, 6.0, 2.0), (1, 3, 9.0, 9.0), (1, 4, None, 1.0), (1, 5, 1.0, 1.0)], "k int, place int, center double, seconds double")
    assert rows(timing.nearest_boundary(runs, anchors, ["k"]), "k", "boundary") == [(1, 6.0), (2, 7.0)]
    assert rows(timing.boundary_candidates(runs, anchors, ["k"], 1), "k", "position") == [(1, 4.0), (1, 5.0), (1, 6.0), (2, 7.0)]
    assert rows(timing.boundary_candidates(runs.limit(0), anchors, ["k"], 1), "k", "position") == [(1, 5.0), (2, 7.0)]


def test_positional_lines(spark):
    gold = spark.createDataFrame([("a", 0, "ann"), ("a", 1, None), ("a", 2, "bob"), ("a", 3, "ann"), ("b", 0, "narrator")], "ch string, at int, who string")
    said = spark.createDataFrame([("a", 0, "ann"), ("a", 1, "bob"), ("a", 2, "cid"), ("a", 9, "ann"), ("b", 0, None)], "ch string, at int, who string")
    pairs = agreement.positional_pairs(gold, said, ["ch", "at"])
    assert rows(agreement.positional_report(pairs, "ch"), "*") == [("a", 4, 1, 3, 1), ("b", 1, 1, 0, 0)]
    # the narrator's line that bob was given is no fp: only dialogue counts
    assert rows(agreement.positional_characters(pairs), "*") == [("ann", 1, 0, 1), ("bob", 0, 0, 1), ("cid", 0, 1, 0)]


@pytest.mark.parametrize(("given", "want"), [
    (None, None), ("  ", None), (" Ann ", "Ann"), ("[Ann|ann| Bob ]", "[Ann|Bob]"), ("[narrator|Ann]", "Ann"), ("[|narrator]", None), ("[Ann", "[Ann"),
])
def test_suggestions(spark, given, want):
    one = spark.createDataFrame([(given,)], "s string")
    assert one.select(agreement.cleaned_suggestions(F.col("s"), ("narrator",))).first()[0] == want


def test_cluster_names_by_first_known_then_longest(spark):
    cells = [
        (1, 1, 0, 5, "the tall man", "the tall man", False), (1, 1, 1, 9, "Ann", "Ann", True), (1, 2, 0, 20, "I", "I", False), (1, 2, 1, 30, "old Bob", "old Bob", None),
        (1, 2, 2, 40, "new Bob", "new Bob", False), (1, 3, 0, 50, "he", "he", False), (1, 4, 0, 5, "Cid", "Cid", True),
    ]
    mentions = spark.createDataFrame(cells, "d int, cluster int, place int, start int, text string, name string, known boolean")
    assert rows(agreement.coref_names(mentions, "d", ("he",)), "*") == [(1, 20, "old Bob"), (1, 30, "old Bob"), (1, 40, "old Bob"), (1, 5, "Cid"), (1, 9, "Ann")]


def test_review_items_leave_known_ones_out(spark):
    lines = spark.createDataFrame([(1, "x", "The Cook"), (2, "ann", "Cook"), (3, None, "the cook"), (4, "y", "Ann"), (5, "narrator", "cook"), (6, None, " "), (7, "z", None)], "line int, who string, said string")
    known = spark.createDataFrame([("ann",), ("ann",), (None,)], "key string")
    found = planning.review_items(lines, known, "line", F.col("who"), F.col("said"), lambda c: F.lower(F.trim(c)))
    assert rows(found, "line", "item", "spelling", "first_line", "lines") == [(1, "the cook", "The Cook", 1, 2), (3, "the cook", "The Cook", 1, 2)]


def test_rosters_and_casts(spark):
    entries = spark.createDataFrame([(1, 0, "Ann"), (1, 1, "Annie"), (1, 2, "who"), (2, 0, "Annie")], "g int, place int, surface string")
    lookup = spark.createDataFrame([("Ann", "A1"), ("Annie", "a1")], "surface string, id string")
    assert rows(agreement.migrated_roster(entries, lookup, "g"), "*") == [(1, 0, "A1", "Ann"), (1, 2, None, "who"), (2, 0, "a1", "Annie")]
    assert rows(agreement.migrated_roster(entries, lookup, "g", drop=True), "*") == [(1, 0, "A1", "Ann"), (2, 0, "a1", "Annie")]
    lines = spark.createDataFrame([("c", "ann", 4), ("c", "ann", 2), ("c", "the_cook", 3), ("c", "narrator", 1), ("c", None, 5), ("c", "big-bob", 6)], "chapter string, character string, line int")
    records = spark.createDataFrame([("ann", "Ann A."), ("c7", "Cook")], "id string, name string")
    cast = agreement.chapter_characters(lines, records, spark.createDataFrame([("the cook", "c7")], "surface string, id string"), "line")
    assert rows(cast, "character", "id", "name", "place") == [("ann", "ann", "Ann A.", 2), ("big-bob", "big-bob", "Big Bob", 6), ("the_cook", "c7", "Cook", 3)]


def test_assignments_skip_manifests_without_a_voice(spark):
    manifests = spark.createDataFrame([(0, "Ann", "2.0", "gone"), (1, "Ann", "2.0", "v"), (2, "Ann", "2.0", "w"), (3, "Bob", "1.0", "v"), (4, "Cid", "2.0", "v"), (5, "Dee", "2.0", None)], "place int, name string, version string, provider_voice string")
    names = spark.createDataFrame([(n, n.lower()) for n in ("Ann", "Bob", "Cid", "Dee")], "name string, character string")
    voices = spark.createDataFrame([("v", "V2", 2), ("v", "V1", 1), ("w", "W", 3)], "provider_voice string, voice string, ord int")
    assert rows(planning.assignments(manifests, names, voices, spark.createDataFrame([("cid",)], "character string")), "*") == [("ann", "V1")]
