import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions import scalars, text
from dialoom.operators import aggregate, catalogue, ranking, sequence, spans, verify
from dialoom.sources import files
from dialoom.streaming.stats import StatsAccumulator, changed_stats


def one(spark, column, **values):
    rows = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


def test_text(spark):
    cases = {
        "Can ’t we - meet , now ?": "can't we-meet, now?", " “Hello”  there ": "hello” there".replace("”", '"'), "": "", None: "",
    }
    for raw, want in cases.items():
        assert one(spark, text.normalized(F.lit(raw).cast("string"))) == want
    assert one(spark, text.slug(F.lit("  The Cat & Mouse! "))) == "the_cat_mouse"
    assert one(spark, text.character_name(F.lit("Cat_and-Mouse!"))) == "cat and mouse"
    assert [tuple(p) for p in one(spark, text.paragraphs(F.lit("a\r\n\r\n  \nbc\rd")))] == [(0, 0, 1, "a"), (1, 8, 10, "bc"), (2, 11, 12, "d")]
    assert [tuple(s) for s in one(spark, text.segments(F.lit("Wait [pause short] here")))] == [("text", "Wait"), ("pause", "[pause short]"), ("text", "here")]
    assert one(spark, text.descriptor(F.lit(" “The  old Sailor,” "))) == "The old Sailor" and one(spark, text.descriptor(F.lit("the same man"))) is None
    assert one(spark, text.descriptor(F.lit("the man other"))) == "the man other" and one(spark, text.descriptor(F.lit("same old sailor"))) is None
    assert one(spark, text.model_answer(F.lit("```\nAnswer: \"Alex\"."))) in ("", "Alex")
    assert one(spark, text.inside_quote(F.lit('a "b c'), F.lit(4))) and not one(spark, text.inside_quote(F.lit('a "b" c'), F.lit(6)))
    assert one(spark, text.natural_key(F.lit("ch10"))) > one(spark, text.natural_key(F.lit("ch9")))
    made = one(spark, text.guid(F.lit("Book-9::v3::catherine")))
    assert one(spark, text.is_guid(F.lit(made))) and not one(spark, text.is_guid(F.lit("ILOU0000")))


def test_scalars(spark):
    assert one(spark, scalars.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, scalars.clamped(F.lit(float("nan")))) == 0.0 and one(spark, scalars.clamped(F.lit(2.0))) == 1.0
    items = F.array(*map(F.lit, ["Ann", "bob", "ANN", "Bob", "cy"]))
    assert one(spark, scalars.ordered_distinct(items, fold_case=True)) == ["Ann", "bob", "cy"]
    counts = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))
    remap = F.create_map(F.lit("a"), F.lit("z"), F.lit("b"), F.lit("z"))
    assert one(spark, scalars.summed_map(F.map_keys(counts), counts, remap)) == {"z": 5, "c": 4}


@pytest.mark.parametrize("ordered", [False, True])
def test_alignment(spark, ordered):
    left = spark.createDataFrame([("b", 1, 0, 10), ("b", 2, 10, 20), ("b", 3, 3000, 3010)], "doc_id string, l int, l_start int, l_end int")
    right = spark.createDataFrame([("b", 1, 5, 15), ("b", 2, 2999, 3009), ("b", 3, 50, 60)], "doc_id string, r int, r_start int, r_end int")
    pairs = spans.overlapping(left, right)
    assert sorted((r.l, r.r, r.shared) for r in pairs.collect()) == [(1, 1, 5), (2, 1, 5), (3, 2, 9)]
    found = sorted((r.l, r.r) for r in spans.aligned(pairs, ordered=ordered).collect())
    assert len(found) == 2 and (3, 2) in found and found[0][1] == 1
    crossing = spans.overlapping(
        spark.createDataFrame([("c", 1, 100, 200), ("c", 2, 0, 90)], left.schema), spark.createDataFrame([("c", 1, 0, 90), ("c", 2, 100, 200)], right.schema)
    )
    assert spans.aligned(crossing, ordered=ordered).count() == (1 if ordered else 2)


def test_interval_of(spark):
    points = spark.createDataFrame([("d", 0, "x"), ("d", 5, "y"), ("d", 9, "z"), ("e", 1, "w")], "doc_id string, at int, tag string")
    held = spark.createDataFrame([("d", 0, 0, 5), ("d", 1, 6, 12)], "doc_id string, idx int, start int, end int")
    assert {r.tag: r.idx for r in spans.interval_of(points, held).collect()} == {"x": 0, "y": -1, "z": 1, "w": -1}


def test_similarity(spark):
    rows = spark.createDataFrame([("right carmen", "right karmen"), ("", ""), ("abc", None)], "a string, b string")
    got = [r.x for r in rows.select(spans.similarity("a", "b").alias("x")).collect()]
    assert got[0] == pytest.approx(0.9167, abs=1e-4) and got[1] == 1.0 and got[2] == 0.0


def test_episode_path(spark):
    path = lambda scores: one(spark, sequence.two_speaker_path(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in scores))))
    assert path([(0.0, -9.0), (-0.6, -0.65), (0.0, -9.0)]) == [0, 1, 0]
    assert path([(0.0, -9.0), (0.0, -9.0), (0.0, -9.0)]) == [0, 0, 0]


def test_ranking(spark):
    assert one(spark, ranking.score_of(F.array(F.lit("same_paragraph_continuation"), F.lit("context_gender_conflict")))) == pytest.approx(0.44)
    assert one(spark, ranking.score_of(F.array(*map(F.lit, ["paragraph_sibling_confirmed", "post_quote_mention"])))) == 0.98
    assert one(spark, ranking.disposition(F.lit(0.9), F.lit(0.5), 0.8, F.lit(True))) == "review"


def test_verification(spark):
    questions = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b"), ("k3", "c")], "key string, line string")
    cache = spark.createDataFrame([("k1", "Ann", 0.9)], "key string, choice string, confidence double")
    got = verify.answered(questions, cache, lambda f: f.assign(choice=f["line"].str.upper(), confidence=0.7))
    assert sorted((r.key, r.choice) for r in got.collect()) == [("k1", "Ann"), ("k2", "B"), ("k2", "B"), ("k3", "C")]

    def broken(frame):
        raise OSError("no model")

    assert {r.key: r.choice for r in verify.answered(questions, cache, broken).collect()} == {"k1": "Ann", "k2": None, "k3": None}


def test_catalogue(spark):
    people = spark.createDataFrame([(1, "Ann", "A."), (2, "Bo", "A."), (3, None, "")], "id int, name string, alias string")
    found = catalogue.surfaces(people, "id", [F.col("name"), F.col("alias")], F.col("id"), text.character_name)
    assert sorted(map(tuple, catalogue.unique(found).collect())) == [("ann", 1), ("bo", 2)]
    assert dict(map(tuple, catalogue.last_wins(found).collect()))["a"] == 2


def test_sources(spark, tmp_path):
    for name, body in (("01 One é+", b"One \xe9 \x93x\x94 \x81\r\nline"), ("02", "Zwei “x”".encode())):
        (tmp_path / "book" / name).mkdir(parents=True)
        (tmp_path / "book" / name / "chapter.txt").write_bytes(body)
    lines = [{"id": 1, "characterId": "ann", "text": "Hi", "span": {"start": 0, "end": 2}}, {"id": 2, "chosenSpeaker": "Bo"}]
    (tmp_path / "book" / "01 One é+" / "dialogue.json").write_text(json.dumps({"reviewed": True, "lines": lines}, indent=1))
    chapters = files.read_chapters(spark, str(tmp_path / "book"))
    assert {r.chapter: r.text for r in chapters.collect()} == {"01 One é+": "One é “x” \ufffd\r\nline", "02": "Zwei “x”"}
    dialogue = files.read_dialogue(spark, str(tmp_path / "book"))
    assert sorted((r.line_id, r.character, r.text, r.end) for r in dialogue.collect()) == [(1, "ann", "Hi", 2), (2, "Bo", "", None)]
    assert {r.chapter: (r.parsed, r.reviewed) for r in files.chapter_list(chapters, dialogue).collect()} == {"01 One é+": (True, True), "02": (False, False)}
    assert [(r.chapter, r.number) for r in files.chapters_in_range(chapters, 2, 9).collect()] == [("02", 2)]
    (tmp_path / "t.tsv").write_text("﻿a\tb\n1\t" + "x" * 200_000 + "\n")
    assert len(files.read_tsv(spark, str(tmp_path / "t.tsv")).first().b) == 200_000
    tokens = spark.createDataFrame([("d", 10, 0, 1), ("d", 11, 1, 3), ("d", 12, 3, 4)], "doc string, token_id int, onset int, offset int")
    quotes = spark.createDataFrame([("d", 1, 10, 13)], "doc string, q int, quote_start int, quote_end int")
    assert files.quote_spans(quotes, tokens).select("start", "end").first() == (0, 4)
    files.write_report(spark.createDataFrame([(0.5, "x")], "r double, c string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first() == ("0.500000", "x")


def test_stats_by_stream_equal_batch(spark, tmp_path):
    """Each batch replaces its chapters, also one that has become empty; the last batch of a chapter counts."""
    schema = "character string, chapter string"
    batches = [[("ann", "1"), ("bo", "1"), ("ann", "2")], [("ann", "1"), ("ann", "1"), (" ", "1")], [(None, "2")], [("ann", "1"), ("cy", "3"), ("cy", None)]]
    acc, states = StatsAccumulator(spark, str(tmp_path / "stats")), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        acc.follow(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "mark")).awaitTermination()
        states.append(spark.createDataFrame(acc.stats().collect(), acc.stats().schema))
    assert [sorted(map(tuple, s.collect())) for s in states] == [[("ann", 2, 2), ("bo", 1, 1)], [("ann", 3, 2)], [("ann", 2, 1)], [("ann", 1, 1), ("cy", 1, 1)]]
    assert sorted(r.character for r in changed_stats(states[0], states[1]).collect()) == ["ann"]
    assert sorted(map(tuple, acc.compact(str(tmp_path / "small")).stats().collect())) == [("ann", 1, 1), ("cy", 1, 1)]


def test_votes(spark):
    votes = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 2), (2, "b", 1)], "k int, c string, w int")
    assert {r.k: r.winner for r in aggregate.strict_vote(votes, ["k"], "c", F.col("w")).collect()} == {1: None, 2: "a"}
