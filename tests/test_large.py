"""What keeps queries whole and quick on large tables: plans without large broadcasts, and results where groups are large."""

import random
import re

from pyspark.sql import functions as F

from dialoom import plans
from dialoom.functions import cues
from dialoom.operators import auditing, curation, merging, placing

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    """The plan's parts, as lists of lines, that are sent to every worker."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((m for m in range(n + 1, len(lines)) if depth(lines[m]) <= depth(line)), len(lines))
            found.append(lines[n:below])
    return found


def test_ingest_counts_broadcasts_nothing_but_sizes(spark):
    for part in broadcasts(plans.QUERIES["ingest_counts"](spark, SF)):
        assert not any("Generate" in line for line in part) and any("collect_set(n" in line for line in part)


def test_mentions_of_names_that_begin_alike(spark):
    cells = [(i, "c", f"old {i} man", f"{'x ' * (i % 3)}old {i} man, old {i + 1} man of the very old house by the sea (old {i})") for i in range(300)]
    lines = spark.createDataFrame(cells, "place int, chapter string, speaker string, text string")
    names = [("old 7 man of", 0), ("old 8 man of the very old house by the sea", None), ("old 8 man of the very old house by the river", 3), ("old 9-man", 0), ("old 5 man", 5), ("old 5 man", 9), ("(old 9)", None), ("sea (old 9", None), ("old", 290)]
    known = spark.createDataFrame([(n, p, None) for n, p in names], "name string, place int, chapter string")
    found = {r.name: (r.count_dialogue, r.count_mentions) for r in curation.ingested(lines, known).collect()}
    wanted = {n: (0, 1) for n, _ in names} | {"old 9-man": (0, 0), "old 8 man of the very old house by the river": (0, 0), "(old 9)": (0, 0), "old": (0, 10)}
    # a line names its own speaker and the next line's, who is not yet known
    assert found == {f"old {i} man": (1, 1) for i in range(300)} | wanted | {"old 5 man": (1, 1)}


def test_a_spelling_held_back_takes_the_name_later(spark):
    # "Ann" may not replace "ann", but replaces "bobby" when it comes again
    cells = [(1, "a", "ann"), (2, "a", "Ann"), (3, "a", "bobby"), (4, "a", "Ann"), (5, "a", "BOBBY"), (6, "a", "ANN")]
    rows = spark.createDataFrame([(*c, None, None) for c in cells], "ord int, id string, name string, gender string, aliases array<string>")
    assert [(r.name, r.aliases, r.rows) for r in merging.combined_characters(rows).collect()] == [("Ann", ["bobby"], 6)]


def test_records_of_one_id_like_a_plain_fold(spark):
    rng = random.Random(5)
    names = ["ann", "Ann", "ANN", "aNN", "bobby", "Bobby", "BOBBY", "Cy", "cy", "Dee Smith", "dee smith", "Dee SMITH", "x-ray", None, " "]
    cells = [(n, f"id{n % 7}", rng.choice(names[: 3 + n % 7 * 2]), None, [rng.choice(names), f"Other {n % 9}"]) for n in range(400)]
    rows = spark.createDataFrame(cells, "ord int, id string, name string, gender string, aliases array<string>")

    def casing(x):
        title, upper, lower = x is not None and any(map(str.isupper, x)) and not re.search("[A-Za-z][A-Z]|(?<![A-Za-z])[a-z]", x), re.search("[A-Z]", x or ""), re.search("[a-z]", x or "")
        return (3 if title else 2 if upper and lower else 1 if upper else 0, len(x or ""))

    wanted = {}
    for _, id, name, _, more in cells:
        now, aliases = wanted.get(id, (None, []))
        said = []
        if (name or "").strip():
            same = now is not None and now.lower() == name.lower()
            better = not same and casing(name) > casing(now)
            said = [now] if better else [] if same else [name]
            now = name if better else now
        for x in [*said, *(a for a in more if (a or "").strip())]:
            if x and x.lower() not in [a.lower() for a in aliases]:
                aliases = [*aliases, x]
        wanted[id] = (now, aliases)
    assert {r.id: (r.name, r.aliases) for r in merging.combined_characters(rows).collect()} == {i: (n, [a for a in al if a.lower() != n.lower()]) for i, (n, al) in wanted.items()}


def test_lines_meet_paragraphs_like_plain_loops(spark):
    rng = random.Random(3)
    places, lines = [], []
    for doc in range(12):
        at = 0
        for idx in range(doc * 6):
            body = rng.choice(["same words here", "“a b” c", "a b c", "c a b", "b", f"only {idx} here", "“c” and “a b”"])
            places.append((doc, idx, at, at + len(body), body))
            at += len(body) + rng.choice([0, 1, 5])
        for n in range(doc * 5 + 3):
            start = rng.randrange(at + 9)
            lines.append((doc, n, *((start, start + rng.randrange(9)) if n % 5 else (None, None)), rng.choice(["Same words", "a b", "c", "b", f"only {n}", "none", "words, here!"])))
    key = lambda x: " ".join(re.sub("[“”]", "", x.lower()).replace(",", " ").replace("!", " ").split())
    made = placing.resolved_lines(spark.createDataFrame(lines, "d int, l int, start int, end int, text string"), spark.createDataFrame(places, "d int, idx int, start int, end int, text string"), "d").collect()
    assert len(made) == len(lines)
    for r, (_, _, start, end, text) in zip(sorted(made, key=lambda r: (r.d, r.l)), lines):
        said, spot = key(text), r.span_paragraph
        near = lambda p: 0.0 if start is None or p[2] <= (start + end) / 2 <= p[3] else min(abs((start + end) / 2 - p[2]), abs((start + end) / 2 - p[3]))
        held = [(said not in map(key, re.findall("“(.+?)”", p[4])), near(p), abs(p[1] - spot) if (spot or 0) > 0 else 0, p[1]) for p in places if p[0] == r.d and f" {said} " in f" {key(p[4])} "]
        if held:
            plain, distance, _, idx = min(held)
            assert (r.paragraph, r.distance, r.method.split("_span")[0]) == (idx, distance, "quote_text" if plain else "quote_unit")
        else:
            assert r.paragraph == spot and r.method in ("span_fallback", "unresolved")


def test_line_paragraphs_writes_no_paragraph_once_per_word(spark):
    text = " ".join(f"w{k}" for k in range(3000))
    places = spark.createDataFrame([(1, 0, 0, len(text), text)], "doc_id int, idx int, start int, end int, text string")
    lines = spark.createDataFrame([(1, 0, 0, 5, "w7 w8")], "doc_id int, l int, start int, end int, text string")
    found = placing.resolved_lines(lines, places)
    assert [(r.paragraph, r.method) for r in found.collect()] == [(0, "quote_text")]
    # no plan may hold a paragraph's text beside each of its words
    assert not re.search(r"Generate explode\(.*split\(", found._jdf.queryExecution().executedPlan().toString())


def test_small_folders_cost_no_call_of_their_own(spark):
    clip = "d int, i long, source string, destination string, status string, expected int, best int, score double"
    clips = spark.createDataFrame([(d, n, s, t, "likely_wrong_line", 1, 2, 0.9) for d in range(500) for n, (s, t) in enumerate([("a", "b"), ("b", "c"), ("c", "x"), ("e", "b")])] + [(None, 0, "a", "b", "likely_wrong_line", 1, 2, 0.9)], clip)
    existing = spark.createDataFrame([(d, f) for d in range(500) for f in ("a", "b", "c", "e", "x")[: 4 + d % 2]] + [(None, "a")], "d int, name string")
    found = auditing.rename_plans(clips, existing, "d")
    by = {}
    for r in found.orderBy("d", "i").collect():
        by.setdefault(r.d, []).append((r.outcome, r.safe))
    moved = [("planned", True)] * 3 + [("duplicate_destination", False)]
    stopped = [("planned", False)] * 2 + [("taken", False), ("duplicate_destination", False)]
    assert by == {d: stopped if d % 2 else moved for d in range(500)} | {None: [("missing_source", False)]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_assist_works_its_evidence_out_once_and_folds_without_a_call_per_chapter(spark):
    df = plans.QUERIES["assisted_lines"](spark, SF)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "FlatMapCoGroups" not in plan and plan.count("MapInArrow") >= 2
    # the lines are dealt by chapter once; what asks for surfaces reads the same exchange again
    assert len([x for x in plan.split("\n") if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]) == 1


def test_speakers_among_names_that_a_text_may_hold(spark):
    names = ["Ann", "Bo", "Ann Lee", "D'Arc", " ", None, "Mc-Coy", "ann", "Zoë", "No.1"]
    texts = ["Ann said.", "said bo", "Ann Lee began, and said Bo", "D'ARC replied to Bo", "Mc Coy asked", "Bo and Ann", "“Hm.” Zoë finished.", "No 1 whispered", "ANN  started!", "Annsaid", "", None, "asked Ann said Bo", "Bo said; Ann said", "Bo started it"]
    want = [None, "Bo", "Ann Lee", "D'Arc", "Mc-Coy", None, None, "No.1", None, None, None, None, None, None, None]
    rows = spark.createDataFrame([(n, t, names) for n, t in enumerate(texts)], "n int, t string, names array<string>")
    found = [r.who for r in rows.select("n", cues.attributed_speaker(F.col("t"), F.col("names")).alias("who")).orderBy("n").collect()]
    assert found == want
