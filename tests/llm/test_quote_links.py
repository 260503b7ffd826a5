import random
import re
from collections import Counter

from leafweave.llm.quote_links import conversations, linked

MESSAGES = [
    (1, 0, "user", "How do I bake bread?\nI have flour."),
    (1, 1, "assistant", "Mix it with water.\n\nThen wait an hour."),
    (1, 2, "user", "On Monday the assistant wrote:\n> Mix it   with\n> WATER.\n\nHow much?"),
    (1, 3, "user", "> Then wait an hour.\nWhy so long?"),
    (1, 4, "assistant", ">> Mix it with water.\n> How much?\n\nTwo cups."),
    (1, 5, "assistant", "> never said\nStill an answer."),
    (1, 6, "user", "> Mix it with water.\n>\n> Then wait an hour.\nBoth done."),
    (1, 7, "user", "> Two cups.\n> > How much?\n> > > Mix it with water.\nThanks."),
    (2, 0, "user", "> Two cups.\nAnother conversation."),
    (2, 3, "user", "A gap before me."),
    (3, 0, "user", None), (3, 1, "user", ""), (3, 1, "user", "again"), (3, 2, None, "a > b"),
    (None, 0, "user", "> x\ny"), (4, None, "user", "z"),
]


def test_links_threads_and_content(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("own", __import__("pyspark").sql.functions.lit(1))
    got = sorted((tuple(r) for r in linked(df).collect()), key=repr)
    by = {(c, t): (content, quotes, parent, link, thread, depth) for c, t, _, content, quotes, parent, link, thread, depth in got if (c, t) != (3, 1)}
    assert len(got) == len(MESSAGES)
    assert by[1, 0] == ("How do I bake bread?\nI have flour.", 0, None, False, 0, 0)
    assert by[1, 1][2:] == (0, False, 0, 1)
    assert by[1, 2] == ("How much?", 1, 1, True, 0, 2)
    assert by[1, 3] == ("Why so long?", 1, 1, True, 0, 2)
    assert by[1, 4] == ("Two cups.", 2, 2, True, 0, 3)
    assert by[1, 5] == ("Still an answer.", 1, 4, False, 0, 4)
    assert by[1, 6][0] == "Both done." and by[1, 6][2:4] == (1, True)
    assert by[1, 7][0] == "Thanks." and by[1, 7][1:] == (3, 4, True, 0, 4)
    assert by[2, 0][2:] == (None, False, 0, 0) and by[2, 3][2:] == (0, False, 0, 1)
    assert by[3, 0][0] == "" and by[3, 2][0] == "a > b" and by[3, 2][2:] == (1, False, 0, 2)
    assert by[None, 0] == ("y", 1, None, False, 0, 0) and by[4, None][0] == "z"


def test_long_chain_and_empty(spark):
    df = spark.createDataFrame([(9, i, "user", f"> message {i - 1}\nmessage {i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    got = linked(df).collect()
    assert sorted((r.turn, r.depth, r.thread_turn) for r in got) == [(i, i, 0) for i in range(300)]
    assert linked(df.where("turn < 0")).collect() == []


def test_quotes_of_lines(spark):
    long = "First line here.\nSecond line here.\nThird line here.\nFourth line here."
    rows = [
        (0, "How do I bake bread?\nI have flour."), (1, long), (2, "Third line here."), (3, "Something else."),
        (4, "> I have flour.\nHow much?"),
        (5, "> second  LINE here.\n> Third line here.\nTwo lines of it."),
        (6, "> Third line here.\nA whole text goes first."),
        (7, "> Something else.\n> never said\nOne line of two."),
        (8, ">> First line here.\n> never said\nOnly the deeper one."),
        (9, "> First line here. Second line here. Third line here. Fourth line here.\nSet anew."),
    ]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.linked, r.quotes) for r in linked(df).collect()}
    assert got[4] == (0, True, 1) and got[5] == (1, True, 1) and got[6] == (2, True, 1)
    assert got[7] == (3, True, 1) and got[8] == (1, True, 2) and got[9] == (1, True, 1)


def brute(rows):
    """(conv, turn) -> (content, parent, linked, thread, depth) of messages (conv, turn, text) without repeats."""
    tidy = lambda x: re.sub(r"\s+", " ", x).strip().lower()
    said, asked, content = {}, {}, {}
    for c, t, text in sorted(rows):
        lines = []
        for x in (text or "").split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]?)+)", x)
            lines.append((m[0].count(">") if m else 0, x[m.end() :] if m else x))
        lines = [(k, x) for i, (k, x) in enumerate(lines) if not (k == 0 and re.search(r"(?i)\bwrote\s*:?\s*$", x) and i + 1 < len(lines) and lines[i + 1][0])]
        runs, before = [], None
        for k, x in lines:
            if before is None or before[0] != k or not x.strip() or not before[1].strip():
                runs.append((k, []))
            if x.strip():
                runs[-1][1].append(tidy(x))
            before = k, x
        runs = [(k, b) for k, b in runs if b]
        own = [b for k, b in runs if k == 0]
        content[c, t] = re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in lines if k == 0).strip())
        for b in [*own, [y for b in own for y in b]]:
            said.setdefault((c, " ".join(b), True), t) if b else None
        for b in own:
            for y in b:
                said.setdefault((c, y, False), t)
            said.setdefault((c, " ".join(b), False), t)
        if own:
            said.setdefault((c, " ".join(y for b in own for y in b), False), t)
        levels = {k for k, _ in runs if k}
        asked[c, t] = [(k, b) for k, b in runs if k] + [(v, [" ".join(y for k, b in runs if k == v for y in b)]) for v in levels if sum(k == v for k, _ in runs) > 1]
    out = {}
    for c, t in sorted(content):
        best = {}
        for k, b in asked[c, t]:
            at = said.get((c, " ".join(b), True))
            if at is None or at >= t:
                at = max((x for y in [" ".join(b), *(b if len(b) > 1 else [])] if (x := said.get((c, y, False))) is not None and x < t), default=None)
            if at is not None:
                best[k] = max(best.get(k, at), at)
        earlier = [x for d, x in content if d == c and x < t]
        parent = best[min(best)] if best else max(earlier, default=None)
        _, _, _, thread, depth = out[c, parent] if parent is not None else (0, 0, 0, t, -1)
        out[c, t] = content[c, t], parent, bool(best), thread, depth + 1
    return out


def test_against_brute_force(spark):
    r = random.Random(11)
    phrases = [" ".join(r.choices(["flour", "Water", "how", "much", "oven", "an hour"], k=r.randrange(1, 4))) for _ in range(30)]
    rows = []
    for c in range(12):
        for t in sorted(r.sample(range(40), 14)):
            lines = []
            for _ in range(r.randrange(1, 7)):
                lines.append(r.choice(["", "", "> ", "> ", ">> ", "> > > "]) + r.choice([*phrases, "", "Ann  wrote:"]))
            rows.append((c, t, "\n".join(lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(x.conv_id, x.turn): (x.content, x.parent_turn, x.linked, x.thread_turn, x.depth) for x in linked(df).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[2] for v in want.values()) > 40


def test_conversations_are_in_reply_order(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    got = conversations(linked(df)).collect()
    assert len(got) == len(MESSAGES)
    sizes = Counter(x.thread for x in got)
    assert sorted(sizes) == list(range(len(sizes)))
    place = {}
    for x in got:
        place.setdefault(x.thread, []).append((x.place, x.conv_id, x.turn, x.parent_turn))
    for rows in place.values():
        assert [p for p, *_ in sorted(rows)] == list(range(len(rows)))
        seen = set()
        for _, c, t, parent in sorted(rows):
            assert parent is None or parent in seen or (c, t) == (3, 1)
            seen.add(t)


def test_very_long_text(spark):
    text = "\n".join(f"> line {i}\nanswer {i}" for i in range(3000))
    df = spark.createDataFrame([(1, 0, "user", "line 2999"), (1, 5, "user", text), (1, 9, "user", "> answer 7")], "conv_id long, turn long, role string, text string")
    got = {x.turn: x for x in linked(df).collect()}
    assert got[5].parent_turn == 0 and got[5].linked and got[9].parent_turn == 5 and got[9].depth == 2
