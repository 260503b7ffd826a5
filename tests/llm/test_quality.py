import math
import random
import re
from collections import Counter

from leafweave.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    again = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again)


def test_counts_against_brute_force(documents, awkward):
    r = random.Random(1)
    rows = list(awkward)
    for i in range(200):
        n = r.randrange(0, 120)
        rows.append((100 + i, "".join(r.choice("abc") + r.choice(["", "#", "é", "<|"]) + r.choice([" ", " ", "\n", "\t\x0b", "\xa0"]) for _ in range(n)) * r.choice([1, 1, 3])))
    edges = ["f", "a f", "f a", "half of fluff", "\x0cab cd\x0c", "\x0b x y\x0b", "\r\nx\r\n", "\tx y\t", " x ", "fff", "\x0cf\x0c", "\\f x", "\xa0x y\xa0", "u000B x"]
    rows += [(1000 + i, t) for i, t in enumerate(edges)]
    got = Q.measured(documents(rows)).select("id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()
    want = [(i, *brute(t)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_thresholds_follow_the_group(documents):
    r = random.Random(2)
    text = lambda mark, k: " ".join("".join(r.choices("abcdefgh", k=5)) + mark * (r.random() < k) for _ in range(60))
    rows = [(i, text("#", 0.0), "plain") for i in range(300)] + [(1000 + i, text("#", 0.5), "code") for i in range(300)]
    rows += [(2000, text("#", 0.7), "plain"), (2001, text("#", 0.7), "code"), (2002, "short text", "plain"), (2003, "one two three four five six seven eight " * 9, "plain"), (2004, text("#", 0.0), None)]
    got = {x.doc_id: x for x in Q.judged(documents(rows)).collect()}
    assert len(got) == len(rows)
    assert not got[2000].kept and not got[2000].base_failed and got[2001].kept and got[2004].kept
    assert got[2002].base_failed and got[2003].base_failed and not got[2002].kept
    assert sum(got[i].kept for i in range(300)) >= 299 and sum(got[1000 + i].kept for i in range(300)) >= 299


def test_rare_measures_act_below_the_base_rule(documents):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    clean = lambda: " ".join(word() for _ in range(60))
    again = lambda: (lambda w: " ".join(w + [word() for _ in range(64)] + w))([word() for _ in range(8)])  # noqa: E731  # 16 of 80 words
    doubled = lambda: "\n".join((x := [" ".join(word() for _ in range(5)) for _ in range(6)]) + x[3::-1])  # noqa: E731  # 4 of 10 lines
    rows = [(i, clean(), "clean") for i in range(400)] + [(1000, again(), "clean"), (1001, doubled(), "clean")]
    rows += [(2000 + i, again() if i % 20 == 0 else doubled() if i % 20 == 1 else clean(), "list") for i in range(400)]
    got = {x.doc_id: x for x in Q.judged(documents(rows)).collect()}
    assert got[1000].n_repeat_words == 16 and got[1001].n_dup_lines == 4 and not any(x.base_failed for x in got.values())
    assert not got[1000].kept and not got[1001].kept
    assert all(x.kept for i, x in got.items() if i not in (1000, 1001))


def test_awkward_and_empty_tables(documents, awkward):
    got = Q.judged(documents(awkward)).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in awkward) and all(x.base_failed for x in got if x.n_words < 20)
    assert Q.judged(documents(awkward).where("doc_id < 0")).collect() == []


def quantile(values, p):
    """The least value whose rank, from 1, is p times their number or more, as in sketches of fewer values than they hold."""
    values = sorted(values)
    return values[max(0, math.ceil(p * len(values)) - 1)] if values else None


def verdicts(rows, least=20):
    """kept by exact quantiles: rows are (id, text, source)."""
    facts, own, every = {}, {}, []
    for i, t, s in rows:
        n, chars, symbols, lines, dup, again = brute(t)
        failed = n < 20 or 100 * again > 30 * n
        facts[i] = failed, (symbols / chars, dup / lines, again / n, chars / n) if n else None
        if n:
            own.setdefault(s, []).append(facts[i])
            every.append(facts[i])
    out = {}
    for i, _, s in rows:
        failed, x = facts[i]
        group = own[s] if x and len(own[s]) >= least else every
        ok = not failed and x is not None
        for k, margin in ((0, 0.05), (3, 2.0)) if ok else ():
            low, high = (quantile([g[k] for _, g in group], p) for p in (0.25, 0.75))
            room = max(4 * (high - low), margin)
            ok = ok and x[k] <= high + room and (k == 0 or x[k] >= low - room)
        for k, floor in ((1, 0.20), (2, 0.10)) if ok else ():
            ok = ok and x[k] <= max(quantile([g[k] for f, g in group if not f], 0.99), floor)
        out[i] = ok
    return out


def test_verdicts_against_exact_quantiles(documents):
    r = random.Random(8)
    word = lambda k: "".join(r.choices("abcdefgh", k=r.randrange(2, k))) + "#" * (r.random() < 0.04)
    rows = []
    for i in range(240):
        source, words = r.choice(["a", "a", "b", None, f"rare{i % 4}"]), [word(r.choice([5, 9, 9, 9, 40])) for _ in range(r.randrange(5, 60))]
        if r.random() < 0.3:
            words += words[: r.randrange(8, 16)]
        if r.random() < 0.1:
            words = [w + "##" for w in words]
        lines = [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
        rows.append((i, "\n".join(lines + lines[: r.choice([0, 0, 0, 3])]), source))
    got = {x.doc_id: x.kept for x in Q.judged(documents(rows), least_rows=20).collect()}
    assert got == verdicts(rows)
    assert 20 < sum(got.values()) < 220
