"""Cues, passes, checks and reports on small examples, and long inputs in time near their length."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from dialoom.functions import cues, scalars, text
from dialoom.operators import evaluation, passes, sequence, verify

NAMES = ["Alex", "Morgan", "", None, "Ann Lee"]


def each(spark, column, texts, **more):
    rows = spark.createDataFrame([(i, t, NAMES) for i, t in enumerate(texts)], "i int, t string, names array<string>")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_names_in_texts(spark):
    t, names = F.col("t"), F.col("names")
    assert each(spark, cues.explicit_mentions(t, names), ["morgan and ANN LEE", "Alexander", None]) == [["Morgan", "Ann Lee"], [], []]
    assert each(spark, cues.addressed(t, names), ["He turned to Morgan.", "facing  alex", "Morgan to him", None, "into Alex"]) == ["Morgan", "Alex", None, None, None]
    texts = ["Alex saw Morgan's hat; alex ran", "Morgan, then Alex", "nobody", None, "Alex. Alex’s"]
    assert each(spark, cues.first_mention(t, names), texts) == ["Alex", "Morgan", None, None, "Alex"]
    assert each(spark, cues.last_mention(t, names), texts) == ["Alex", "Alex", None, None, "Alex"]
    assert each(spark, cues.only_mention(t, names), texts) == [None, None, None, None, "Alex"]
    found = ["Morgan asked Alex.", "said Morgan", "Alex said. Morgan said.", "Ann Lee began.", "Ann Lee began to walk", "spat Alex", "", None, "whispered Alex; told Morgan"]
    assert each(spark, cues.attributed_speaker(t, names), found) == ["Morgan", "Morgan", None, "Ann Lee", None, None, None, None, "Alex"]


def test_other_cues(spark):
    t = F.col("t")
    got = each(spark, cues.pronoun_cue(t), ["He said so.", "pointed out she, quietly", "they greeted us", "the said man", None, "she and he murmured"])
    assert [x and tuple(x) for x in got] == [("male", "he said"), ("female", "pointed out she"), ("neutral", "they greeted"), None, None, ("male", "he murmured")]
    assert each(spark, cues.nearby_speech_verb(t), ["he said it", "unsaid", "Replied", None]) == [True, False, True, False]
    assert each(spark, cues.boundary_quality(t, F.lit("Are you all there?")), ['a "b"', "a", "", None]) == pytest.approx([0.95, 0.6, 0.35, 0.35])
    assert each(spark, cues.generic_label(t), ["The Man", " she ", "unknown voice", "Ann", None]) == [True, True, True, False, True]
    assert each(spark, cues.blocked_speaker(t), ["Unknown", "[a|b]", "", None, "Ann"]) == [True, True, True, True, False]
    owners = F.array(*(F.struct(F.lit(d).alias("descriptor"), F.lit(n).alias("name")) for d, n in (("old sailor", "Ann"), ("tall man", "Bo"), ("sailor", "Ann"))))
    assert each(spark, cues.unique_descriptor(t, owners), ["the old sailor spoke", "old sailor and tall man", "sailors"]) == ["Ann", None, None]
    stack = lambda *x: cues.suggestion(F.array(*map(F.lit, x)).cast("array<string>"), "Narrator")
    assert [each(spark, stack(*x), [""])[0] for x in ((), ("a",), ("a", "b"), ("Narrator",))] == [None, "[a|Narrator]", "[b|a]", "[Narrator|Unknown]"]


def test_words_and_numbers(spark):
    t = F.col("t")
    assert each(spark, text.numbers_in_words(t), ["7 men, 1,215 ships", "9999. 10000", "v2.0 1005 100 x3 20", None]) == [
        "seven men, one thousand two hundred and fifteen ships", "9999. 10000", "v2.0 one thousand and five one hundred x3 twenty", ""]
    assert each(spark, text.single_quoted(t), ['a "so called" b "Yes." "tail', '"x" ""', 'none "a  "']) == ["a 'so called' b \"Yes.\" \"tail", "'x' \"\"", "none 'a  '"]
    assert each(spark, text.id_candidates(t), ["The Cats!", "Bo", "", "s"]) == [["the-cats", "the-the-cats", "the-cat", "the-the-cat"], ["bo", "the-bo"], [], ["s", "the-s"]]
    assert each(spark, text.dash_only(t), [" — ", "----", "-", "", None]) == [True, False, True, False, False]
    assert each(spark, text.chapter_number(t), ["012 Name", "Name 3", "99999999999"]) == [12, None, None]


def test_long_texts_stay_linear(spark):
    lengths = [random.Random(1).randrange(9) for _ in range(3000)]
    rows = spark.createDataFrame([(lengths,), ([],), ([5],)], "a array<bigint>").select(scalars.prefix_sums(F.col("a")).alias("x")).collect()
    assert [r.x for r in rows] == [[sum(lengths[:i]) for i in range(3000)], [], [0]]
    body = "\n".join(f"line {i}" if i % 3 else " " for i in range(60_000))
    found = spark.createDataFrame([(body,)], "t string").select(F.explode(text.paragraphs(F.col("t"))).alias("p")).select("p.*")
    assert found.count() == 40_000
    row = found.where("idx = 39999").first()
    assert body[row.start : row.end] == row.text == "line 59999"


CHAPTER = '“First?” Ann asked. “Second,” he went on, “third.”\n“Fourth!” “Fifth.” Nobody moved. “Sixth.”\nBo replied: “Seventh.”\n“Eighth.” The captain shouted. “Ninth.”'


def test_passes(spark):
    rows = passes.chunks(spark.createDataFrame([("c", CHAPTER), ("d", None), ("e", 'an "open\nend')], "chapter string, text string"), "chapter", "text")
    mine = rows.where("chapter = 'c'").orderBy("i").collect()
    assert all(CHAPTER[r.start : r.end].strip('"“” ') == r.text for r in mine) and [r.text for r in mine if r.type == "dialogue"][:3] == ["First?", "Second,", "third."]
    assert [(r.chapter, r.type) for r in rows.where("chapter <> 'c'").collect()] == [("e", "narration")]
    lines = F.length(F.regexp_replace(F.substring(F.lit(CHAPTER), F.lit(1), F.col("start").cast("int")), r"[^\n]", "")).cast("int")
    blank = F.substring(F.lit(CHAPTER), F.col("start").cast("int") + 1, F.lit(1)) == "\n"  # a piece that begins between paragraphs is in none
    rows = rows.where("chapter = 'c'").withColumn("paragraph", F.when(blank, -1).otherwise(lines))
    aliases = spark.createDataFrame([("c", "Ann", "Ann"), ("c", "Bo", "Bo"), ("c", "the captain", "Bo")], "chapter string, alias string, name string")
    got = [(r.speaker, r.rule) for r in passes.attributed(rows, "chapter", aliases).orderBy("i").collect()]
    assert got == [
        ("Ann", "2_forward_explicit_tags"), ("Ann", "2b_backward_explicit_tags"), ("Ann", "4c_carry_across_short_narration"),
        ("[Ann|Narrator]", "5_suggest_alternatives"), ("[Ann|Narrator]", "5_suggest_alternatives"), ("[Ann|Narrator]", "4c_carry_across_short_narration"),
        ("[Ann|Bo]", "5_suggest_alternatives"), ("Bo", "2_forward_explicit_tags"), ("Bo", "2b_backward_explicit_tags"),  # narration has named Bo
    ]


def test_recency_and_wraps(spark):
    speakers = ["a", "b", "b", None, "Unknown", "[a|b]", "a", "c", "", "d", "e"]
    assert each(spark, sequence.recency_stack(F.array(*map(F.lit, speakers))), [""]) == [["e", "d", "c", "a", "b"]]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["One", "two", "", "three", "—four", "5 five", "Well-", "known"])], "d int, i int, t string")
    assert [r.t for r in sequence.merged_lines(lines, ["d"], "i", "t").orderBy("i").collect()] == ["One two", "", "three —four", "5 five", "Well-known"]


def test_checks(spark):
    names = F.create_map(F.lit("ann"), F.lit("Ann"), F.lit("captain"), F.lit("Bo"))
    made = verify.roster(F.array(*map(F.lit, ["ANN", "captain", "Unknown", "Cy"])), F.lit("bo"), F.lit("Dee"), names, 3)
    assert each(spark, made, [""]) == [["Ann", "Bo", "Dee"]]
    kind = "array<struct<name:string,confidence:double,reasons:array<string>>>"
    old = F.array(F.struct(F.lit("Ann"), F.lit(0.6), F.array(F.lit("x"))), F.struct(F.lit("Cy"), F.lit(0.3), F.array(F.lit("y")))).cast(kind)

    def after(action, choice, unsure=False):
        row = each(spark, verify.applied(F.lit(action), F.lit(choice).cast("string"), F.lit(0.812345), F.lit("Ann"), F.lit(unsure), F.array(F.lit("Cy")), old, names), [""])[0]
        return row.speaker, row.suggestion, row.suggestions, [(c.name, c.confidence, c.reasons) for c in row.candidates]

    was = [("Ann", 0.6, ["x"]), ("Cy", 0.3, ["y"])]
    assert after("downgrade", "captain") == ("Bo", True, ["Bo", "Cy"], [("Bo", 0.8123, ["jev_verification_disagreement"]), *was])
    assert after("downgrade", "None") == ("Ann", True, ["Ann", "Cy"], was)
    assert after("confirm", "Ann", True) == ("Ann", False, ["Cy"], [("Ann", 0.6, ["x", "jev_verification_confirmed"]), was[1]])
    assert after("note", "Cy") == ("Ann", False, ["Cy"], was)


def test_quote_report(spark):
    gold = spark.createDataFrame([("b", 1, 10, 20, "alice"), ("b", 2, 30, 40, "bob")], "doc_id string, l long, start int, end int, speaker string")
    said = spark.createDataFrame([("b", 1, 11, 19, "alice"), ("b", 2, 31, 39, "alice"), ("b", 3, 50, 60, None)], "doc_id string, r long, start int, end int, speaker string")
    r = evaluation.quote_report(gold, said).first()
    assert (r.gold, r.predicted, r.matched, r.correct, r.labelled, r.resolved) == (2, 3, 2, 1, 2, 2)
    assert (r.precision, r.recall, r.f1, r.accuracy_on_matched, r.end_to_end) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8), 0.5, 0.5)
    one = evaluation.quote_report(
        spark.createDataFrame([("b", 1, 0, 10, "a"), ("b", 2, 10, 20, "a")], gold.schema), spark.createDataFrame([("b", 1, 5, 15, "a")], said.schema)
    ).first()
    assert (one.matched, one.recall) == (1, 0.5)
    none = evaluation.quote_report(gold.limit(0), said.limit(0)).first()
    assert (none.gold, none.matched, none.precision, none.f1) == (0, 0, 0.0, 0.0)


def test_followed_quotes(spark):
    made = random.Random(2)
    gold = [("d", i, made.choice("abcdef")) for i in range(40)] + [("e", 0, "x")]
    quotes = [("d", j, made.choice("abcdef"), f"s{j}") for j in range(60)]
    offered, at, want = [q[2:] for q in quotes], 0, {}
    for _, i, t in gold[:40]:
        chosen = next((j for j in range(at, min(at + 8, 60)) if offered[j][0] == t), at if at < 60 else None)
        want["d", i], at = (offered[chosen][1], chosen + 1) if chosen is not None else (None, at)
    found = evaluation.followed_quotes(spark.createDataFrame(gold, "d string, i long, text string"), spark.createDataFrame(quotes, "d string, j long, text string, speaker string"), "d")
    assert {(r.d, r.i): r.speaker for r in found.collect()} == want | {("e", 0): None}


def test_paragraph_of_span(spark):
    made = random.Random(3)
    paragraphs, at = [], 0
    for k in range(30):
        at += made.randrange(1, 6)
        paragraphs.append(("d", k, at, at := at + made.randrange(1, 9)))
    lines = [("d", i, (s := made.randrange(at + 20)), s + made.randrange(0, 12)) for i in range(200)] + [("e", 0, 1, 2)]
    want = {}
    for d, i, s, e in lines:
        of = [p for p in paragraphs if p[0] == d]
        meets = [p[1] for p in of if s < p[3] and e > p[2]]
        centre = (s + e) / 2
        away = [(p[2] - centre if centre < p[2] else centre - p[3] if centre > p[3] else 0.0, p[1]) for p in of]
        want[d, i] = meets[0] if meets else min(away)[1] if of else None
    found = evaluation.paragraph_of_span(spark.createDataFrame(lines, "doc_id string, l int, start int, end int"), spark.createDataFrame(paragraphs, "doc_id string, idx int, start int, end int"))
    assert {(r.doc_id, r.l): r.paragraph for r in found.collect()} == want


def test_similarity_is_of_longest_blocks(spark):
    from dialoom.operators import spans

    pairs = [("abcabba", "cbabac"), ("a b c", "a c b"), ("x", "y")]
    rows = spark.createDataFrame([(a, b, a.split(), b.split()) for a, b in pairs], "a string, b string, x array<string>, y array<string>")
    got = rows.select(spans.similarity("a", "b").alias("s"), spans.token_similarity("x", "y").alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, a.split(), b.split()).ratio()) for a, b in pairs]


def test_passes_of_pronouns(spark):
    body = 'Then she said, "Three." \n"One," I said. \n"Two," I said, and Bo said no. \n"Four," he said. \n"Five," we said.'
    rows = passes.chunks(spark.createDataFrame([("c", body)], "chapter string, text string"), "chapter", "text")
    assert all(body[r.at :].startswith(r.text) for r in rows.collect())
    lines = F.length(F.regexp_replace(F.substring(F.lit(body), F.lit(1), F.col("at").cast("int")), r"[^\n]", "")).cast("int")
    rows = rows.withColumn("paragraph", lines)
    aliases = spark.createDataFrame([("c", "Bo", "Bo")], "chapter string, alias string, name string")
    coref = spark.createDataFrame([("c", body.index("she"), "Ann"), ("c", body.index("he said. "), "Cid"), ("d", 0, "Dan"), ("c", None, "Eve")], "chapter string, at int, name string")
    got = [(r.speaker, r.rule[:2]) for r in passes.attributed(rows, "chapter", aliases, protagonist="Zed", persona="Me", coref=coref).orderBy("i").collect()]
    assert got == [("Ann", "1b"), ("Zed", "0p"), ("Zed", "0a"), ("Cid", "1_"), ("Zed", "0a")]  # the persona falls back to the protagonist
    assert passes.attributed(rows.limit(0), "chapter", aliases, coref=coref).count() == 0


def attribution(spark, chapter, aliases=("Ann", "Bo", "Cid"), **options):
    rows = passes.chunks(spark.createDataFrame([("c", chapter)], "chapter string, text string"), "chapter", "text")
    lines = F.length(F.regexp_replace(F.substring(F.lit(chapter), F.lit(1), F.col("start").cast("int")), r"[^\n]", "")).cast("int")
    blank = F.substring(F.lit(chapter), F.col("start").cast("int") + 1, F.lit(1)) == "\n"
    rows = rows.withColumn("paragraph", F.when(blank, -1).otherwise(lines))
    known = spark.createDataFrame([("c", a, a) for a in aliases] + [("x", "Zoe", "Zoe")], "chapter string, alias string, name string")
    return [(r.speaker, r.rule) for r in passes.attributed(rows, "chapter", known, **options).orderBy("i").collect()]


def test_narration_feeds_the_latest_names_and_breaks_forget_them(spark):
    assert attribution(spark, "Ann said. Bo was there, and Cid stood by.\n“Yes.”") == [("[Bo|Cid]", "5_suggest_alternatives")]
    assert attribution(spark, "Ann and Bo came.\n\n“Yes.”") == [("[Ann|Bo]", "5_suggest_alternatives")]  # the break comes before its own names
    assert attribution(spark, "Ann came. “Yes,” Bo said.\n\nNobody spoke.\n“No.”") == [("Bo", "2_forward_explicit_tags"), ("[Bo|Narrator]", "5_suggest_alternatives")]
    assert attribution(spark, "Ann came. “Yes,” Bo said.\n“And.”\n\nNobody spoke.\n“No.”")[2] == ("Unknown", "none")
    assert attribution(spark, "Bo said. “One.”\n***\n“Two.”")[1] == ("Unknown", "none")
    assert attribution(spark, "“Hm.”") == [("Unknown", "none")]


def test_new_subjects_are_known_from_where_they_first_stand(spark):
    got = attribution(spark, "Dee walked.\n“One.”\nDee Vale said. Then dee vale left.\n“Two,” dee vale said.\n“Three.”")
    assert got == [("Unknown", "none"), ("Dee Vale", "2_forward_explicit_tags"), ("[Dee Vale|Narrator]", "5_suggest_alternatives")]
    assert attribution(spark, "“Yes,” Zoe said.") == [("Zoe", "2_forward_explicit_tags")]
    assert attribution(spark, "“Yes,” Someone said.", blocked=("someone",)) == [("Unknown", "2_forward_explicit_tags")]
    assert attribution(spark, "Zoe Q.E (x said. “Yes,” Ann said.", aliases=("Ann", "a\\Eb(")) == [("Ann", "2_forward_explicit_tags")]


def test_first_person_guard_and_fallback(spark):
    assert attribution(spark, "“I am here.”", protagonist="Me", persona="Teller") == [("Me", "first_person_override")]
    assert attribution(spark, "“You are here,” we said.", protagonist="Me", persona="Teller") == [("Me", "0a_narrator_identity")]
    assert attribution(spark, "“Go.”", protagonist="Me") == [("Me", "none")]
    same = "“So,” Ann said. “Bo, run,” Bo said."
    assert attribution(spark, same)[1][0] == "Bo"  # nobody else stands right before
    close = "“Now.” “Bo, run.” Bo said."
    assert attribution(spark, "“So.” Ann said.\n" + close)[-1][0] == "Bo"
    assert attribution(spark, "Ann said: “Now.” “Ann, run,” Ann said.", guard=False)[1][0] == "Ann"


def test_long_chapters_stay_linear(spark):
    import time

    took = []
    for n in (4_000, 16_000, 64_000):
        body = "".join(f"Ann went on {i}. “Word {i}.” " for i in range(n // 2))
        df = spark.createDataFrame([("c", body)], "chapter string, text string")
        passes.chunks(df.limit(0), "chapter", "text").count()
        began = time.perf_counter()
        assert passes.chunks(df, "chapter", "text").agg(F.max("end")).first()[0] <= len(body)
        took.append(time.perf_counter() - began)
    assert took[2] < 12 * max(took[1], 0.5)
