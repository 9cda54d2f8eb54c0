"""Rows that repeat a doc_id with different texts."""

import random

from dialoom.llm import jaccard


def test_every_text_of_an_id_links(spark):
    made = random.Random(5)
    a, b, c = (" ".join(f"w{made.randrange(10_000)}" for _ in range(200)) for _ in range(3))
    texts = [(1, a), (5, f"{a} end"), (5, b), (5, b), (5, f"{c} end"), (7, f"{b} end"), (9, c), (9, ""), (9, None), (11, "alone in the world"), (None, a)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=repr)
    size = lambda t: max(1, len(t.split()) - 4) if t else 0
    assert found == sorted(((i, size(t), None if i is None else 11 if i == 11 else 1) for i, t in texts), key=repr)
