from dialoom.llm import quotes

ROWS = [
    (1, 0, "user", "Where is the harbour master today?\n\nAlso, bring the long rope."),
    (1, 1, "assistant", "> Where is the harbour master today?\nAt the pier."),
    (1, 2, "user", "On Monday, Ann wrote:\n> > Where is the HARBOUR master, today?\n> At the pier.\nThanks, I go there."),
    (1, 3, "user", "A new question"),
    (1, 4, "user", "> something nobody said\n\nWhat?"),
    (2, 0, "user", "> also, bring the long rope.\nFound it in another conversation"),
    (2, 1, "user", "> Found it in another conversation\n>\n> never said\n\nYes"),
    (2, 1, "user", "> Found it in another conversation\n>\n> never said\n\nYes"),
    (3, 0, None, None),
    (3, 1, "user", ""),
    (None, 0, "user", "> Where is the harbour master today?\nlost"),
    (4, None, "user", "no turn"),
    (5, 7, "user", "> " * 300 + "deep"),
]


def test_threads(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, node string, level int")
    found = quotes.link_quotations(rows)
    assert found.columns == ["conv_id", "turn", "role", "body", "quote_depth", "n_quoted", "n_linked", "reply_conv", "reply_turn", "thread_turn"]
    got = {}
    for r in found.collect():
        got.setdefault((r.conv_id, r.turn), []).append(tuple(r)[3:])
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1, 0] == [("Where is the harbour master today?\n\nAlso, bring the long rope.", 0, 0, 0, None, None, 0)]
    assert got[1, 1] == [("At the pier.", 1, 1, 1, 1, 0, 0)]
    assert got[1, 2] == [("Thanks, I go there.", 2, 2, 2, 1, 1, 0)]  # answers the least nested quotation
    assert got[1, 3] == [("A new question", 0, 0, 0, None, None, 3)]
    assert got[1, 4] == [("What?", 1, 1, 0, None, None, 4)]
    assert got[2, 0] == [("Found it in another conversation", 1, 1, 1, 1, 0, 0)]
    assert got[2, 1] == [("Yes", 1, 2, 1, 2, 0, 0)] * 2
    assert got[3, 0] == [("", 0, 0, 0, None, None, 0)] and got[3, 1] == [("", 0, 0, 0, None, None, 1)]
    assert got[None, 0][0][:4] == ("lost", 1, 1, 1) and got[4, None] == [("no turn", 0, 0, 0, None, None, None)]
    assert got[5, 7] == [("", 300, 1, 0, None, None, 7)]


def test_hot_passage(spark):
    """Very many messages that quote one line cost one link each, to the latest earlier turn that has it."""
    hot = [(9, 0, "user", "one common line of five words")] + [(9, i, "user", f"> one common line of five words\nnumber {i}") for i in range(1, 3000)]
    found = quotes.link_quotations(spark.createDataFrame(hot, "conv_id long, turn long, role string, text string"))
    assert found.where("n_linked = 1 AND reply_turn = 0 AND thread_turn = 0").count() == 2999


def test_empty(spark):
    assert quotes.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
