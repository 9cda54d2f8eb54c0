"""Curation, clips and identities on small tables with nulls, ties, repeated and empty inputs."""

import json
import re

from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import clips, curation, placing, sequence
from dialoom.sources import files


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


CAST = "ord int, id string, name string, aliases array<string>"


def test_surface_identities(spark):
    cast = spark.createDataFrame([(1, "ann", "Lady Ann", ["the Seer"]), (2, "bob", "Bob the Guard", None), (3, "unknown_guard", "Unknown Guard", []), (9, "ann", "Old", ["guard"])], CAST)
    asked = spark.createDataFrame([("the Lord Seer",), ("guard",), ("old guard",), ("Him",), (None,), (" ",), ("ann",), ("ann",)], "surface string")
    memory = spark.createDataFrame([("him", "bob", "Bob")], "surface string, id string, name string")
    assert rows(curation.surface_identities(asked, cast, memory), "*") == [
        ("ann", "ann", "Lady Ann", 0.98),
        ("guard", "bob", "Bob the Guard", 0.8),  # one shared word of one
        ("guard", "unknown_guard", "Unknown Guard", 0.56),
        ("him", "bob", "Bob", 0.99),
        ("old guard", "bob", "Bob the Guard", 0.625),
        ("old guard", "unknown_guard", "Unknown Guard", 0.4375),
        ("the lord seer", "ann", "Lady Ann", 0.94),
    ]
    assert curation.surface_identities(asked, cast.limit(0), memory.limit(0)).count() == 0


def test_titles_and_articles(spark):
    for given, want in [("lord", "lord"), ("the lord", "the lord"), ("the high lord ann", "the ann"), ("lord the king x", "the x"), ("lord the king", "the king"), ("", "")]:
        assert spark.range(1).select(curation.without_title(F.lit(given))).first()[0] == want
    assert spark.range(1).select(curation.without_article(F.lit("the a man"))).first()[0] == "man"


def test_ingested_mentions_begin_where_a_name_is_known(spark):
    cells = [(0, "c1", None, "Ann saw Bob."), (1, "c1", "Bob", "Bob, Bob and Bobby"), (2, "c2", "Ann", "a b-Ann c"), (3, "c2", "Narrator", "Ann"), (4, "c2", "their", "their D.E. Ann"), (5, None, "", None)]
    lines = spark.createDataFrame(cells, "place int, chapter string, speaker string, text string")
    known = spark.createDataFrame([("Ann", None, None), ("D.E", None, "c0"), ("--", None, None), ("Narrator", None, None)], "name string, place int, chapter string")
    assert rows(curation.ingested(lines, known), "*") == [("--", 0, 0, None), ("Ann", 1, 4, "c2"), ("Bob", 1, 1, "c1"), ("D.E", 0, 1, "c0")]
    assert curation.ingested(lines.limit(0), known.limit(0)).count() == 0


def test_counts_of_aliases(spark):
    cast = spark.createDataFrame([(1, "I1", "Ann", ["A", "Bob"]), (2, "I2", "Bob", None)], CAST)
    lines = spark.createDataFrame([("c", "i1"), ("c", " a "), ("c", "BOB"), ("c", "Zed"), ("c", None), ("c", ""), ("d", "I2")], "chapter string, identity string")
    # "bob" is first an alias of Ann; the alias Bob takes Ann's count, and hides the character Bob
    assert rows(curation.line_counts(lines, cast), "*") == [("c", "A", 3), ("c", "Ann", 3), ("c", "Bob", 3), ("c", "Zed", 1)]


def test_token_fit_and_reports(spark):
    words = spark.createDataFrame([(["a", "b", "c"], ["x", "b", "c", "y", "z"]), (["a"], ["b"]), ([], []), (None, ["a"])], "w array<string>, s array<string>")
    found = words.select(clips.token_fit("w", "s").alias("f")).select("f.matched", "f.matched_ratio", "f.focus_ratio", "f.missing_start", "f.missing_end", "f.extra_leading", "f.extra_trailing").collect()
    assert [tuple(r) for r in found] == [(2, 0.6667, 0.4, 1, 0, 1, 2), (0, 0.0, 0.0, 1, 1, 0, 0), (0, 1.0, 0.0, 0, 0, 0, 0), (0, 1.0, 0.0, 0, 0, 0, 0)]
    cells = [("c", 0, "the cat sat down", "the cat sat down"), ("c", 1, "and the dog ran away", "sat down and the dog ran away"), ("c", 2, "so it ends", ""), ("c", 3, None, None)]
    lines = spark.createDataFrame(cells, "ch string, at int, text string, transcript string")
    got = {r.at: r for r in clips.line_reports(lines, "ch", "at", 0.8, 0.05).collect()}
    assert [got[i].status for i in range(4)] == ["ok", "likely-boundary-drift", "empty-transcript", "empty-transcript"]
    assert (got[0].similarity, got[0].score, got[1].tail, got[1].fit.extra_leading) == (1.0, 1.05, 1.0, 2)
    assert got[2].score == round(0.0 - min(0.12, 6 * 0.015) - 0.25, 4)


def test_resolved_clips(spark):
    lines = spark.createDataFrame([(1, "ann", "Ann/1.wav"), (2, "ann", None), (3, "ann", ""), (4, None, None)], "line int, character string, output string")
    shape = "line int, id string, name string, folder string, source string, path string, exists boolean"
    cells = [
        (1, "ann", "Ann", "Ann", None, "b/Ann/1.wav", True), (1, "ann", "Ann", "Ann", None, "b/Ann/1.mp3", True), (2, "ann", None, "x", None, "p/x/2.wav", True), (2, "ann", None, "y", None, "p/y/2.wav", True),
        (3, "ann", "", "ann", None, "p/3.wav", False),
    ]
    found = rows(clips.resolved_clips(lines, spark.createDataFrame(cells, shape)), "line", "path", "candidates", "status")
    assert found == [(1, "b/Ann/1.wav", 2, "ok"), (2, "p/x/2.wav", 2, "ambiguous"), (3, None, 1, "missing"), (4, None, 0, "none")]


def test_clip_conflicts(spark):
    shape = "chapter string, clip int, line int, expected int, similarity double, best int, best_score double, said int, wanted int"
    cells = [("c", 0, 1, 1, 0.9, 1, 0.9, 0, 4), ("c", 1, 1, 1, 0.5, 1, 0.5, 0, 4), ("c", 2, 2, 2, 0.2, 1, 0.8, 0, 4), ("c", 3, 3, 3, 0.1, 2, 0.7, 0, 0), ("c", 4, None, None, None, None, None, None, None)]
    found = rows(clips.clip_conflicts(spark.createDataFrame(cells, shape)), "clip", "status", "regenerate", "suggested", "in_chain")
    assert found == [
        (0, None, False, None, False), (1, "duplicate_weaker_match", True, 1, False), (2, "adjacent_shift_lower_match", True, 1, True), (3, None, False, 2, True), (4, None, False, None, False),
    ]


def test_descriptor_plan(spark):
    cast = spark.createDataFrame([(1, "A", "Ann", ["seer"], None), (2, "B", "Bob", None, ["Tall One"]), (3, "a", "Dup", None, ["tall one"])], CAST + ", descriptors array<string>")
    targets = spark.createDataFrame([(2, "b"), (1, " a"), (3, ""), (4, None), (5, "zed")], "line int, target string")
    assert rows(curation.descriptor_plan(targets, cast, " tall one "), "*") == [(1, "A", "Ann", True), (2, "B", "Bob", False), (5, None, None, None)]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.spoken_text(F.lit("“Lvl. 5,” he said: [???] +3, plus x – y…  (ok) !"))) == "\"level. 5.\" he said: unknown plus 3 ... plus x ... y ... ok ...!"
    assert one(text.line_query(F.lit("aa bb cc"), F.lit(3), F.lit(5), F.lit("Ann"), 2)) == "[Last speaker: Ann]\na <quote>bb</quote> c"
    assert one(text.line_query(F.lit("aa"), F.lit(3), F.lit(5), F.lit(None).cast("string"), 2)) is None
    pieces = spark.createDataFrame([("short",), (None,), ("One two. Three four five six. Go.",), ("abcdefghijklmnop qr st",)], "t string").select(text.fitting_pieces(F.col("t"), 12)).collect()
    assert [r[0] for r in pieces] == [["short"], None, ["One two.", "Three four", "five six.", "Go."], ["abcdefghijklmnop", "qr st"]]


def test_voice_manifests(spark, tmp_path):
    for name, body in [("a", json.dumps({"formatVersion": "2.0", "clips": [{"line_id": 1, "file": "x.wav"}]})), ("b", "{broken"), ("c d", json.dumps({"formatVersion": "1.0"}))]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(body)
    assert [r.manifest.clips[0].file for r in files.read_voice_manifests(spark, str(tmp_path)).collect()] == ["x.wav"]


def test_lines_go_to_paragraphs_that_quote_them(spark):
    body = [(1, 0, 0, 20, "He said “no way” now"), (1, 1, 21, 40, "no way, she thought"), (1, 2, 41, 60, '"No way!" again ok'), (2, 0, 0, 5, "other")]
    places = spark.createDataFrame(body, "d int, idx int, start int, end int, text string")
    cells = [(1, 0, 41, 50, "No way."), (1, 1, 22, 30, "No way"), (1, 2, None, None, "she"), (1, 3, 45, 46, "absent"), (1, 4, None, None, None), (1, 5, 0, 4, "thought"), (3, 0, 0, 4, "no way")]
    lines = spark.createDataFrame(cells, "d int, l int, start int, end int, text string")
    assert rows(placing.resolved_lines(lines, places, "d"), "d", "l", "paragraph", "method", "confidence", "distance") == [
        (1, 0, 2, "quote_unit", 1.0, 0.0), (1, 1, 0, "quote_unit_span_corrected", 1.0, 6.0), (1, 2, 1, "quote_text", 0.92, 0.0), (1, 3, 2, "span_fallback", 0.45, 0.0),
        (1, 4, None, "unresolved", 0.0, None), (1, 5, 1, "quote_text_span_corrected", 1.0, 19.0), (3, 0, None, "unresolved", 0.0, None),
    ]
    assert placing.resolved_lines(lines.limit(0), places, "d").count() == 0


def test_heard_places(spark):
    words = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "x", "d"]), (["a", "b"], ["b"]), ([], ["a"]), (None, None)], "w array<string>, s array<string>")
    found = [tuple(r[0]) for r in words.select(placing.heard_places(F.col("w"), F.col("s"))).collect()]
    assert found == [([0, 1, 1, 2], 0.5714), ([None, 0], 0.6667), ([], 0.0), ([], 1.0)]


def test_pieces_and_chunks_pack_greedily(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 9) + rng.choice(["", "", ".", "!", "?  "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]

    def fill(items, most):
        out = []
        for x in items:
            if out and len(out[-1]) + 1 + len(x) <= most:
                out[-1] += " " + x
            else:
                out.append(x)
        return out

    def want(t, most):
        if len(t) <= most:
            return [t]
        parts = [p for s in re.split(r"(?<=[.!?])\s+", t) for p in ([s] if len(s) <= most else fill(s.split(), most))]
        return fill(parts, most)

    for most in (5, 12, 40):
        found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fitting_pieces(F.col("t"), most).alias("p")).collect()
        assert all(r["p"] == want(r["t"], most) for r in found)
    plan = lambda *n: spark.createDataFrame([(list(n),)], "n array<int>").select(sequence.packed_chunks(F.col("n"), 300, 900)).first()[0]
    assert plan(200, 200, 200, 50) == [0, 0, 0, 0] and plan(200, 99, 1) == [0, 0, 0] and plan(200, 100, 700) == [0, 0, 1] and plan(899, 50) == [0, 1] and plan() == []


def test_heard_places_lie_between_anchors(spark):
    import difflib
    import random

    rng = random.Random(4)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for _ in range(100)]
    found = spark.createDataFrame(pairs, "w array<string>, s array<string>").select("w", "s", placing.heard_places(F.col("w"), F.col("s")).alias("f")).collect()
    for r in found:
        blocks = difflib.SequenceMatcher(None, r["w"], r["s"], autojunk=False).get_matching_blocks()
        places = r["f"]["places"]
        assert len(places) == len(r["w"]) and all(places[b.a + i] == b.b + i for b in blocks for i in range(b.size))
        known = [p for p in places if p is not None]
        assert known == sorted(known) and all(0 <= p < len(r["s"]) for p in known)
        assert abs(r["f"]["ratio"] - (2 * sum(b.size for b in blocks) / (len(r["w"]) + len(r["s"])) if r["w"] or r["s"] else 1.0)) < 1e-4
