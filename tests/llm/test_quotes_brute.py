"""Quotation linking against a plain linker on generated threads."""

import random
import re

import pytest

from dialoom.llm import quotes

WROTE = re.compile(r"^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|-+\s*original message\s*-+)\s*:?\s*$", re.I)


def norm(text):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def taken_apart(text):
    """([(at, level, passage)], own lines without introductions)"""
    found, own, open_ = [], [], None
    for at, raw in enumerate((text or "").split("\n")):
        marks = re.match(r"[ \t]*(?:>[ \t]*)+", raw)
        level, line = (marks[0].count(">"), raw[marks.end() :]) if marks else (0, raw)
        if level == 0 and not WROTE.match(line):
            own.append(line)
        if WROTE.match(line) or not line.strip():
            open_ = None
        elif open_ and open_[1] == level:
            open_[2].append(line)
        else:
            found.append(open_ := (at, level, [line]))
    return [(at, level, norm("\n".join(x))) for at, level, x in found if norm("\n".join(x))], "\n".join(own)


def linked(rows, min_words=1):
    """Per row: (body, depth, quoted, linked, reply_conv, reply_turn, thread_turn)."""
    parts = [taken_apart(text) for _, _, text in rows]
    offers = set()
    for (conv, turn, _), (passages, own) in zip(rows, parts):
        offers |= {(conv, turn, p) for _, level, p in passages if level == 0} | {(conv, turn, norm(own))}
    replies, out, up = [], [], {}
    for (conv, turn, _), (passages, own) in zip(rows, parts):
        quoted, links = [x for x in passages if x[1]], []
        for at, level, p in quoted:
            near = [t for c, t, q in offers if c == conv and t < turn and q == p]
            far = [(c, t) for c, t, q in offers if c != conv and q == p] if len(p.split()) >= min_words else []
            if near:
                links.append((False, level, at, conv, max(near)))
            elif far:
                links.append((True, level, at, *min(far)))
        replies.append(min(links)[3:] if links else (None, None))
        if links and not min(links)[0]:
            a, b = (conv, turn), (conv, min(links)[4])
            up.setdefault(a, set()).add(b)
            up.setdefault(b, set()).add(a)
        out.append((re.sub(r"\n{3,}", "\n\n", own.strip()), max((x[1] for x in quoted), default=0), len(quoted), len(links)))
    threads = {}
    for start in sorted(up):
        todo = [start]
        while todo:
            at = todo.pop()
            if at not in threads:
                threads[at] = start[1]
                todo += up[at]
    return [(*o, *r, threads.get((c, t), t)) for o, r, (c, t, _) in zip(out, replies, rows)]


def generated(seed):
    made, rows, words = random.Random(seed), [], [f"word{i}" for i in range(40)]
    for conv in range(12):
        said = []
        for turn in range(made.randint(1, 9)):
            lines = []
            for _ in range(made.randint(0, 3)):
                source = made.choice(said) if said and made.random() < 0.7 else made.choice(rows)[2] if rows and made.random() < 0.7 else "never said this"
                if made.random() < 0.4:
                    lines.append(made.choice(["On Monday, Ann wrote:", "On " + "x" * 400 + " wrote:", "-- Original Message --", "Am Montag schrieb Ann:"]))
                piece = made.choice((source or "gone").split("\n\n"))
                lines += [f"{made.choice(['> ', '>', ' > '])}{x.upper() if made.random() < 0.3 else x}" for x in piece.split("\n")]
                if made.random() < 0.5:
                    lines.append("")
            for _ in range(made.randint(0, 2)):
                lines += [" ".join(made.choices(words, k=made.randint(1, 6))), *([""] if made.random() < 0.5 else [])]
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, text))
    return rows


@pytest.mark.parametrize("seed, min_words", [(1, 1)])
def test_links_equal_a_plain_linker(spark, seed, min_words):
    rows = generated(seed)
    docs = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): tuple(r)[3:] for r in quotes.link_quotations(docs, min_words).collect()}
    want = {(c, t): x for (c, t, _), x in zip(rows, linked(rows, min_words))}
    assert found == want
    assert sum(x[3] for x in want.values()) > 40 and any(x[4] is not None and x[4] != c for (c, _), x in want.items())


def test_long_text(spark):
    """One message of very many lines is one row, cut in linear time."""
    text = "\n".join(f"> line {i}\n\nanswer {i}" for i in range(20_000))
    rows = [(1, 0, "a", "\n\n".join(f"line {i}" for i in range(20_000))), (1, 1, "b", text)]
    row = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 1").first()
    assert (row.n_quoted, row.n_linked, row.reply_turn) == (20_000, 20_000, 0)
