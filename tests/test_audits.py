"""Renamings in chains and cycles, verdicts per line, and records merged by id, on small tables."""

from pyspark.sql import functions as F

from dialoom.operators import auditing, merging

CLIP = "d string, i long, source string, destination string, status string, expected int, best int, score double"


def moves(spark, pairs, files, **options):
    clips = spark.createDataFrame([("d", n, s, t, "likely_wrong_line", n, n + 1, 0.9) if isinstance(s, str) else ("d", n, *s, *t) for n, (s, t) in enumerate(pairs)], CLIP)
    existing = spark.createDataFrame([("d", f) for f in files], "d string, name string")
    return [(r.source, r.outcome, r.safe) for r in auditing.rename_plans(clips, existing, "d", **options).orderBy("i").collect()]


def test_chains_cycles_and_blocked_chains(spark):
    assert moves(spark, [("a", "b"), ("b", "c")], "ab") == [("a", "planned", True), ("b", "planned", True)]
    assert moves(spark, [("a", "b"), ("b", "c"), ("c", "a")], "abc") == [("a", "planned", True), ("b", "planned", True), ("c", "planned", True)]
    assert moves(spark, [("a", "b"), ("b", "c"), ("x", "y")], "abcx") == [("a", "planned", False), ("b", "taken", False), ("x", "planned", True)]
    assert moves(spark, [("a", "c"), ("b", "c"), ("b", "d"), ("a", "e"), ("q", "r")], "ab") == [
        ("a", "planned", True), ("b", "duplicate_destination", False), ("b", "planned", True), ("a", "duplicate_source", False), ("q", "missing_source", False)
    ]
    odd = [(("a", "b"), ("ok", 1, 2, 0.9)), (("a", "b"), ("mismatch", 1, 2, 0.9)), (("a", "b"), ("likely_wrong_line", 1, 2, 0.1)), (("a", "b"), ("likely_wrong_line", 2, 2, 0.9)), ((None, "b"), ("likely_wrong_line", 1, 2, 0.9)), (("a", "b"), ("likely_wrong_line", None, 2, None))]
    assert moves(spark, odd, "a", least_score=0.5) == [("a", "low_score", False), ("a", "in_place", False), (None, "invalid", False), ("a", "invalid", False)]
    assert moves(spark, odd, "a", least_score=0.5, mismatches=True)[0] == ("a", "planned", True)
    assert moves(spark, [("a", "b")], "") == [("a", "missing_source", False)]


def test_lines_meet_by_place_or_by_text(spark):
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    curated = spark.createDataFrame([("p", 0, "One!", "Ann"), ("p", 1, "Changed", "Bo"), ("k", 0, "Two", "Ann"), ("k", 1, "None", "Cid"), ("e", 0, "x", "Ann"), ("p2", 0, "Aa", "narrator"), ("p2", 1, None, None)], "doc_id string, i int, text string, name string")
    parsed = spark.createDataFrame(
        [("p", 0, "one", "Ann", ["Ann"], 0, 3), ("p", 1, "two", "Ann", ["Ann", "bo "], 4, 7), ("k", 0, "zero", "Ann", ["Protagonist"], 0, 4), ("k", 1, "two", "Bo", None, 900, 903), ("k", 2, "two", "Ann", [], 0, 0), ("p2", 0, "zz", "Ann", [], 0, 1), ("p2", 1, "aa", "Ann", [], 0, 1)],
        "doc_id string, i int, text string, selected string, pool array<string>, start int, end int",
    )
    chapters = spark.createDataFrame([("k", "Ann's " + " " * 700 + " two " + " " * 400), ("p", "")], "doc_id string, text string")
    found = {(r.doc_id, r.i): tuple(r)[2:] for r in auditing.audited_lines(curated, parsed, key, chapters=chapters).collect()}
    assert found == {
        ("p", 0): (0, True, "correct", None), ("p", 1): (1, True, "scoring_gap", None), ("k", 0): (1, False, "blind_spot", False), ("k", 1): (0, False, "correct", None),
        ("e", 0): (None, False, "unlabeled", None), ("p2", 0): (1, False, "narration", None), ("p2", 1): (0, False, "unlabeled", None),
    }


def test_better_names_win_and_the_others_are_aliases(spark):
    cells = [(1, "a", "bob", "Unknown", ["Bobby"]), (2, "a", "BOB", None, None), (3, "a", "Robert Smith", "male", ["bobby", " "]), (4, "a", "rob", "female", ["Robert Smith"]), (5, "b", None, None, None), (6, None, "x", None, None), (7, "b", "Zed", "unknown", [None, "zed"])]
    rows = spark.createDataFrame(cells, "ord int, id string, name string, gender string, aliases array<string>")
    found = {r.id: (r.place, r.name, r.gender, r.aliases, r.rows) for r in merging.combined_characters(rows).collect()}
    assert found == {"a": (1, "Robert Smith", "female", ["Bobby", "bob", "rob"], 4), "b": (5, "Zed", "unknown", [], 2)}
    assert merging.combined_characters(rows.limit(0)).collect() == []


def test_catalogues_and_references_follow_the_map(spark):
    master = spark.createDataFrame([("a", "Ann", "female"), ("b", "Bo", "male")], "id string, name string, gender string")
    mapping = spark.createDataFrame([(" old ", "a"), ("gone", "nobody")], "old string, new string")
    records = spark.createDataFrame([("k", 1, "old", "Old", None, None, 1), ("k", 2, "a", "Ann", "female", "v2", None), ("k", 3, "gone", "G", None, "v", 2), ("k", 4, "b", "Bo", "male", "v4", 5), ("k", 5, "a", "Ann", "female", "v5", 7)], "book string, ord int, id string, name string, gender string, voice string, n int")
    made, stats = merging.curated_catalog(records, master, mapping, "book", ["voice", "n"])
    assert sorted(map(tuple, made.collect())) == [("k", "a", 1, "Ann", "female", "v2", 1), ("k", "b", 4, "Bo", "male", "v4", 5)]
    assert [tuple(r) for r in stats.collect()] == [("k", 1, 1, 2)]
    kind = "k int, id string, c array<struct<id:string,name:string,confidence:double>>"
    lines = spark.createDataFrame([(1, "old", [("old", "Old", 0.5), ("x", "X", 0.1), ("b", None, 0.2)]), (2, "zz", None), (3, None, []), (4, "b", [(None, "n", 0.1)])], kind)
    found = merging.rewritten_references(lines, master, mapping, ["k"], "id", "c")
    rows = {r.k: r for r in found.collect()}
    assert [tuple(c) for c in rows[1].c] == [("a", "Ann", 0.5), ("b", None, 0.2)] and rows[1].id == "a" and rows[4].c == [] and rows[2].c is None
    assert {k: (r.line_ids, r.missing, r.nested_ids, r.nested_names, r.nested_pruned) for k, r in rows.items()} == {1: (1, False, 1, 1, 1), 2: (0, True, 0, 0, 0), 3: (0, False, 0, 0, 0), 4: (0, False, 0, 0, 1)}
    left = {r.site: (r.stale, r.missing) for r in merging.stale_references(found.select("k", "id", "c"), master, mapping, "id", "c").collect()}
    assert left == {"line": (0, 1), "nested": (0, 0)}
    assert {r.site: r.stale for r in merging.stale_references(lines, master, mapping, "id", "c").collect()} == {"line": 1, "nested": 1}
