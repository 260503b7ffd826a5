import os
import random
from collections import Counter

import numpy as np
import pytest

from leafweave.llm import near_dedup as N


def bag(text):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """doc_id -> least doc_id of its component."""
    bags, label = [(i, bag(t)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}
    links = [(i, j) for k, (i, a) in enumerate(bags) for j, b in bags[:k] if a and b and similarity(a, b) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = r.choice("uvwxyz") + str(r.randrange(999))
    return words


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    texts = [[word() for _ in range(r.choice([3, 6, 40, 200]))] for _ in range(40)]
    base = [word() for _ in range(300)]
    texts += [edited(r, base, r.randrange(0, 14)) for _ in range(60)]  # some far from each other but near the base
    for _ in range(60):
        t = r.choice(texts[:40])
        texts.append(edited(r, t, r.randrange(0, 4)) if len(t) > 5 else t)
    phrase = [word() for _ in range(12)]
    texts += [phrase * 10, phrase * 12, phrase * 20, phrase * 9 + [word()]]
    passage = [word() for _ in range(60)]
    texts += [passage + [word() for _ in range(80)] for _ in range(10)]
    r.shuffle(texts)
    return [(i * 7, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(documents, seed):
    rows = corpus(seed)
    got = {x.doc_id: x for x in N.near_duplicates(documents(rows), block=8).collect()}
    want = brute(rows)
    assert {i: x.class_id for i, x in got.items()} == want
    assert {i for i, x in got.items() if x.kept} == set(want.values())


def test_signatures_agree_with_weighted_jaccard():
    r = np.random.default_rng(3)
    n, length = 300, 4096
    wa, wb = r.integers(0, 9, n) * r.integers(0, 2, n), r.integers(0, 9, n)
    e = r.integers(0, 1 << 62, n).astype(np.uint64)
    a, b = np.flatnonzero(wa), np.flatnonzero(wb)
    sig = N.signatures(np.concatenate([a * 0, b * 0 + 1]), np.concatenate([e[a], e[b]]), np.concatenate([wa[a], wb[b]]), 2, length)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03
    single = N.signatures(np.array([0, 1]), e[[0, 0]], np.array([3, 4]), 2, length)
    assert abs((single[0] == single[1]).mean() - 0.75) < 0.03


def test_awkward_rows(documents, awkward):
    rows = [*awkward, (20, "a b c d e f g"), (20, "h i j k l m n"), (21, "h i j k l m n"), (22, "one"), (23, "One  two three"), (24, "one two\nthree")]
    got = N.near_duplicates(documents(rows)).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    of = {}
    for x in got:
        of.setdefault(x.doc_id, []).append(x)
    assert all(x.kept and x.class_id is None for x in of[None]) and all(of[i][0].kept for i in (1, 2, 3))
    assert {x.class_id for i in (4, 5, 22) for x in of[i]} == {4} and [sum(x.kept for x in of[i]) for i in (4, 5, 22)] == [1, 0, 0]
    assert of[7][0].class_id == 6 and of[24][0].class_id == 23 and of[21][0].class_id == 20 and sum(x.kept for x in of[20] + of[21]) == 2
    assert N.near_duplicates(documents(rows).where("doc_id < 0")).collect() == []


def test_ids_of_several_texts_take_part(documents):
    r = random.Random(5)
    base = [f"w{r.randrange(999)}" for _ in range(60)]
    t, more = " ".join(base), " ".join([*base, "more"])
    got = N.near_duplicates(documents([(1, t), (1, "other words altogether"), (2, more), (2, "other  WORDS altogether"), (5, more)])).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == [(1, 1), (1, 1), (2, 1), (2, 1), (5, 1)]
    assert sorted(x.doc_id for x in got if x.kept) == [1, 1]


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_recall_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {x.doc_id: x.class_id for x in N.near_duplicates(docs).collect()}
    want = brute([(x.doc_id, x.text) for x in docs.collect()])
    classes = lambda of: {i for i, c in of.items() if c != i}
    assert got == want and len(classes(want)) > 0
