import hashlib
import math
import random
from collections import Counter

import pytest

from leafweave.llm import mixing as M
from leafweave.llm import queries


def brute(rows, weights=(5, 2, 1), most=3):
    """Sorted (id, size, source size, target, copies) of (id, text, source) rows, by the iterative rule."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    total = Counter()
    for (*_, s), n in zip(rows, size, strict=True):
        total[s] += n
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * total[s]}
        target |= {s: most * total[s] if over else level * weight[s] for s in over or open_}
        left -= sum(most * total[s] for s in over)
        open_ -= over or open_
    seen, out = Counter(), []
    for (i, t, s), n in zip(rows, size, strict=True):
        mark = hashlib.md5((t or "").encode()).hexdigest()
        rate = min(most, target[s] / total[s]) if total[s] else 0.0
        draw = int(hashlib.md5(f"mix|{'null' if i is None else i}|{mark}|{seen[i, mark]}".encode()).hexdigest()[:13], 16) / 16**13
        seen[i, mark] += 1
        out.append((i, n, total[s], target[s], math.floor(rate) + (draw < rate - math.floor(rate))))
    return sorted(out, key=repr)


def told(docs, **how):
    return sorted(((x.id, x["size"], x.source_size, x.target, x.copies) for x in M.copies(docs, **how).collect()), key=repr)


def assert_near(got, want):
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_against_the_iterative_rule(documents, awkward):
    r = random.Random(3)
    for names in (["a", "b", "c", None], [f"s{k:02}" for k in range(30)], ["one"]):
        rows = [(i, t, r.choice(names)) for i, t in awkward] + [(100 + i, "w " * r.randrange(30), r.choice([names[0], *names])) for i in range(300)]
        assert_near(told(documents(rows)), brute(rows))


def test_repeated_and_null_ids_draw_each_for_itself(documents):
    rows = [(None, "same words here", f"s{k % 3}") for k in range(600)] + [(7, "w " * (k % 9), f"s{k % 3}") for k in range(600)] + [(8, "one row again", "s1")] * 200
    got = told(documents(rows, parts=7))
    # Which of the rows that repeat id and text gets which number is open where their sources differ.
    assert Counter(g[:4] for g in got) == Counter(w[:4] for w in brute(rows))
    for s in {g[3] for g in got}:
        of = [g for g in got if g[3] == s]
        assert abs(sum(g[1] * g[4] for g in of) - s) < 0.1 * s
    assert told(documents(rows, parts=2)) == told(documents(rows, parts=2))


def test_order_and_partitions_of_repeated_rows_change_nothing(documents):
    rows = [(None, "same words here", f"s{k % 3}") for k in range(120)] + [(7, "w w", (None, "a", "b")[k % 3]) for k in range(120)]
    mixed = lambda docs: Counter((x.doc_id, x.text, x.source) for x in M.mix(docs).collect())
    for parts, other in ((1, rows[::-1]), (5, random.Random(1).sample(rows, len(rows)))):
        assert told(documents(rows, parts=1)) == told(documents(other, parts=parts))
        assert mixed(documents(rows, parts=1)) == mixed(documents(other, parts=parts))


def test_mix_repeats_rows_with_their_columns(documents, awkward):
    rows = [(i, t, "a") for i, t in awkward] + [(100 + i, "w " * (i % 7), "b") for i in range(100)]
    docs = documents(rows)
    for c in ("mix_size", "doc", "mark", "copies", "nth", "size", "of", "col", "rate"):
        docs = docs.withColumn(c, docs.doc_id)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter()
    for i, _, _, _, k in told(docs):
        times[i] += k
    assert Counter(x.doc_id for x in mixed.collect()) == +times
    assert all(x.doc == x.doc_id and x["size"] == x.doc_id for x in mixed.collect())


def test_empty_and_wordless_tables(documents):
    docs = documents([(1, "x", "a")]).where("doc_id < 0")
    assert M.copies(docs).collect() == [] and M.mix(docs).collect() == []
    assert [(x["size"], x.target, x.copies) for x in M.copies(documents([(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0.0, 0)] * 2


def test_query(documents, awkward, spark, tmp_path):
    rows = [(i, t, f"s{k % 4}") for k, (i, t) in enumerate(awkward)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((x.doc_id, x["size"], x.source_size, x.taken) for x in queries.op4_mixing(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, s, n * k) for i, n, s, _, k in brute(rows)), key=repr)
