"""Token alignment against loops over the two libraries' own tokens."""

import hashlib
from collections import Counter

from dialoom.llm import alignment, registry

ODD = ["", None, " ", "\n\n\t x", "<|endoftext|> and <s> </s> <unk>", "a ▁ b", "naïve 日本語 😀 é", "x" * 5000, "\x00\x01", "ﬁ² ½", "a", "it's they'll 12345 !!! ...", "    code    here", "word " * 4000, " lead and trail ", "tab\t x\n  y \n z\r\n ", "nb\u00a0sp \u2003 em\u3000 x", "a\x1c b\x85 c", "it 's 'tis  'S", "x ▁y z"]


def encoded(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a_side, b_side = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_side.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel

    stands = {}
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    for b in range(256):
        stands[chr(b) if b in plain else chr(next(others))] = b
    assert set(stands) == set(ByteLevel.alphabet())
    for text in texts:
        if not text:
            yield [], []
            continue
        e = a_side.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(stands[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = []
        for i in b_side.encode(text):
            piece = b_side.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        yield (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def ranges(side):
    out, at = [], 0
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts):
    rows = []
    for a, b in map(lambda s: (ranges(s[0]), ranges(s[1])), encoded(texts)):
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        common = sorted({x[2] for x in a} & {x[2] for x in b})
        low, made = 0, []
        for high in common:
            made.append("|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in (a, b)) if len(a) < 3000 else None)
            low = high
        rows.append((len(a), len(b), made, links))
    count = Counter(p for r in rows for p in set(r[3]))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for n_a, n_b, made, links in rows:
        digest = hashlib.sha256(";".join(made).encode()).hexdigest() if made and None not in made else ""
        out.append((n_a, n_b, len(made), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), digest if None not in made else None))
    return out


def test_alignment_equals_brute_force(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in rows] + ODD + [ODD[11]]
    docs = spark.createDataFrame([(i % (len(texts) - 1), t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()
    want = [(i % (len(texts) - 1), *r) for i, r in enumerate(brute(texts))]
    loose = {r[0] for r in want if r[-1] is None}
    got = sorted(tuple(r) if r[0] not in loose else (*r[:-1], "") for r in found)
    assert got == sorted(r if r[0] not in loose else (*r[:-1], "") for r in want)
    assert sum(r[1] > 0 for r in want) > len(texts) - 8 and any(r[1] == 0 and texts[r[0]] for r in want)


def test_frequent_and_rare_pairs_agree(spark):
    docs = spark.createDataFrame([(i, f"the cat number {i % 7} sat {'down ' * (i % 3)}", "c") for i in range(200)], "doc_id long, text string, links string")
    results = []
    for hot in (1, 16, 1 << 16):
        tokens, scores = alignment.alignment(docs, hot=hot)
        results.append(sorted(map(tuple, tokens.select("row", "doc_id").join(scores, "row").select("doc_id", "n_best", "count_sum").collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 200
    empty = docs.limit(0)
    tokens, scores = alignment.alignment(empty)
    assert tokens.count() == 0 and scores.count() == 0
    assert {"groups", "links", "a_ids", "b_ids", "marks"} <= set(tokens.columns)


def test_blocks_and_words_that_recur(spark, monkeypatch):
    """Words cut from texts have the tokens that whole texts have, with a memo that starts anew and blocks of a few texts."""
    made = [f"{a}{s}{b}" for a in ("x", "it's", "12,5", "é日本", "a▁b", "\tt") for s in (" ", "  ", "\n", "\n ", " \n", "  ", " 　") for b in ("y", "Z.", "", " ", "ﬁ")]
    sides = alignment._sides(*(open(p, mode).read() for p, mode in zip(alignment.default_paths(), ("r", "rb"))))
    monkeypatch.setattr(alignment, "MEMO_WORDS", 20)
    want = list(encoded(made))
    for k in range(0, len(made), 7):
        codes, words, a_ids, a_ends, b_ids, b_ends = sides.block(made[k : k + 7])
        words = [0, *words.to_pylist()]
        for text, (a, b) in zip(codes.to_pylist(), want[k : k + 7]):
            for ids, ends, side in ((a_ids, a_ends, a), (b_ids, b_ends, b)):
                held = list(zip(ids.to_pylist(), ends.to_pylist()))
                assert [i for w in text for i, e in held if words[w] < e <= words[w + 1]] == [i for i, _ in side]
    assert any(a for a, _ in want) and any(not a for a, _ in want)
