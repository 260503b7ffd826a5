import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from leafweave.llm import toxicity
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_dedup import brute, corpus, edited


def test_run_against_brute_force(spark, documents, tmp_path):
    r = random.Random(7)
    rows = corpus(4) + [(5000 + k, t) for k, (_, t) in enumerate(corpus(4)[:30])] + [(6000, None), (6001, "")]
    rude = [(7000 + k, " ".join(r.choices(["plain", "words", "here", "and", "there"], k=20) + ["nincompoop"])) for k in range(40)]
    rows = [(i, t) for i, t in rows + rude]
    sources = {i: r.choice(["a", "b", "c", None]) for i, _ in rows}
    documents([(i, t, sources[i]) for i, t in rows]).select(corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 7000)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = toxicity.Scorer(model)([t or "" for _, t in rows])
    rows = [x for x, s in zip(rows, scores, strict=True) if s < 0.3]
    assert not any(i >= 7000 for i, _ in rows) and len(rows) > 150
    last = {t or "": i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    label = brute(rows)
    rows = [(i, t) for i, t in rows if label[i] == i]
    copies = {i: k for i, *_, k in mixed([(i, t, sources[i]) for i, t in rows])}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: copies[i] * (len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows if copies[i]}
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == want


def test_repeated_rows_and_columns(spark, documents, awkward, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(awkward).select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0
    kept = [x.doc_id for x in corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [2, 3, 5, 7, 8, 9, 10]))
    kept = [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, None, None, 6, 8, 9, 10]))


def test_rows_of_one_id_are_told_apart(spark, documents, tmp_path):
    docs = documents([(1, "A x"), (1, "B y"), (2, "A x")]).select(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == [(1, "B y"), (2, "A x")]
    r = random.Random(9)
    base = [f"w{r.randrange(999)}" for _ in range(80)]
    near = " ".join(edited(r, base, 1))
    docs = documents([(1, " ".join(base)), (1, "B y"), (2, near), (2, near), (3, "B  Y")]).select(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(1, " ".join(base)), (1, "B y")])


def test_columns_that_clash(spark, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents([(1, "a b c"), (2, "a b c"), (3, None), (None, "x")])
    for c in ("_id", "_mark", "mark", "doc", "stay", "rows", "copies", "col", "c0", "_text", "best", "nth"):
        docs = docs.withColumn(c, docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(x.doc == x.doc_id and x.c0 == x.doc_id for x in out.collect())
