import random
import zlib

import numpy as np
import pytest

from leafweave.llm import queries
from leafweave.llm import toxicity as X


def made(n, seed):
    r = random.Random(0)
    plain = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(400)]
    r = random.Random(seed)
    rude = ["blatherskite", "nincompoop", "scoundrel"]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.choice([0, 8, 40, 400]) + 1)]
        toxic = int(r.random() < 0.3)
        for _ in range(toxic * r.randrange(1, 3)):
            words.insert(r.randrange(len(words) + 1), r.choice(rude))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_misspellings():
    train, rest = made(1200, 1), made(400, 2)
    model = X.train([t for _, t, _ in train], [y for *_, y in train])
    got = X.Scorer(model)([t for _, t, _ in rest]) >= X.THRESHOLD
    assert (got == np.array([y for *_, y in rest], bool)).mean() > 0.9
    scores = X.Scorer(model)(["abc def nincompooop ghi", "abc def ghi jkl", "blatherskites abc"])
    assert scores[0] > scores[1] and scores[2] > scores[1]


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_one_label_or_none(labels):
    model = X.train(["a b c", "d e"][: len(labels)], labels)
    scores = X.Scorer(model)(["a b", "", "z " * 9])
    assert ((0 <= scores) & (scores <= 1)).all() and scores[0] == scores[2] and scores[1] == 0


def test_scores_do_not_depend_on_neighbours():
    model = X.train([t for _, t, _ in made(100, 3)], [y for *_, y in made(100, 3)])
    texts = [t for _, t, _ in made(60, 4)] + ["", "a", "b " * 20000]
    assert np.allclose(X.Scorer(model)(texts), [X.Scorer(model)([t])[0] for t in texts])


def test_query(spark, documents, awkward, tmp_path):
    rows = [(100 + i, t) for i, t, _ in made(300, 5)]
    documents(awkward + rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, y) for i, _, y in made(300, 5)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op1_toxicity(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in awkward + rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def naive(model, text):
    """The score of a text by its definition: the highest mean over three words of their features' mean weights."""
    words = text.lower().split()
    if not words:
        return 0.0
    each = [float(np.mean(model.weights[X.features([w])[0]])) for w in words]
    best = max(sum(each[i : i + model.window]) / len(each[i : i + model.window]) for i in range(max(1, len(words) - model.window + 1)))
    return 1 / (1 + np.exp(-(best + model.bias)))


def test_scores_against_their_definition(awkward):
    model = X.train([t for _, t, _ in made(100, 3)], [y for *_, y in made(100, 3)])
    texts = [t for _, t, _ in made(80, 6)] + [t or "" for _, t in awkward] + ["one", "one two", "İ ſ é", "a" * 5000, '"quoted," (words)!']
    assert X.Scorer(model)(texts) == pytest.approx([naive(model, t) for t in texts], abs=1e-5)


def test_labelled_texts_of_any_length_train(spark, documents):
    """All texts with the word are longer than any bound on a single text would be."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows = [(i, " ".join([word() for _ in range(6000 if i % 2 else 30)] + ["nincompoop"] * (i % 2) * 3)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = X.fit(documents(rows), labels)
    assert np.any(model.weights)  # rows of both labels have trained it
    few = X.fit(documents(rows), labels, chars=2)  # the first text of either label in any case
    assert np.any(few.weights)


def test_columns_that_clash(documents):
    docs = documents([(1, "a b"), (2, None), (None, "")])
    for c in ("c0", "c1", "_text", "_score", "y"):
        docs = docs.withColumn(c, docs.doc_id)
    model = X.train([t for _, t, _ in made(100, 3)], [y for *_, y in made(100, 3)])
    out = X.clean(docs, model, threshold=2.0)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert X.clean(docs, model, threshold=-1.0).collect() == []
    assert X.scored(docs, model).columns == ["doc_id", "score"]
