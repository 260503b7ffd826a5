import hashlib
import random

import numpy as np
import pytest

from leafweave.llm import exact_dedup as X


def brute(rows):
    """Sorted (id, keep id, group size, sha) of (id, text) rows, and how many rows stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr), len(groups)


def check(got, rows):
    want, stay = brute(rows)
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=repr) == want
    assert sum(x.kept for x in got) == stay == len({x.text_sha256 for x in got if x.kept}) and all(x.doc_id == x.keep_id for x in got if x.kept)


def corpus(seed):
    r = random.Random(seed)
    long = "".join(r.choices("abcdefgh \n", k=60_000))
    rows = [(i, long) for i in range(5)] + [(10, long + "x"), (11, "x" + long), (12, long[:-1]), (13, long[:30_000] + "!" + long[30_001:]), (14, long * 8), (15, long * 8)]
    rows += [(100 + i, r.choice(["", "a", "A", "a ", "aa", "é", "é"])) for i in range(60)]
    return rows


def test_against_groups_of_texts(documents, awkward):
    rows = awkward + corpus(1)
    check(X.exact_duplicates(documents(rows)).collect(), rows)


def test_texts_of_one_digest_stay_apart(documents):
    """With few bits many chunks of one length share a digest."""
    r = random.Random(2)
    rows = [(i, "".join(r.choices("ab", k=4))) for i in range(80)] + corpus(3)
    assert X.ambiguous(documents(rows), bits=1).count() > 0
    check(X.exact_duplicates(documents(rows), bits=1).collect(), rows)
    check(X.exact_duplicates(documents(rows), bits=4).collect(), rows)


def test_chunks_depend_on_their_text_alone():
    r = np.random.default_rng(4)
    texts = [r.integers(97, 105, n, dtype=np.uint8) for n in (0, 1, 511, 512, 513, 5000, 40_000, 3_000_000)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = [next(X.chunks(t, np.array([0, len(t)]))) for t in texts]
    together = list(X.chunks(np.concatenate(texts), starts))
    assert [[e - s for e in ends] for s, ends in zip(starts.tolist(), together, strict=False)] == alone
    for t, ends in zip(texts, alone, strict=True):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(t) and (sizes <= X.MOST).all() and (sizes[:-1] >= X.LEAST).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, ""), (1, "")], [(5, "t"), (5, "t"), (5, "u")]])
def test_small_tables(documents, rows):
    check(X.exact_duplicates(documents([*rows, (-1, "x")]).where("doc_id IS NULL OR doc_id >= 0")).collect(), rows)
