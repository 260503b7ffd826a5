"""Toxicity: subword-bag embeddings, averaged over windows of words, into a linear softmax; trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.llm.common import blocks, bounded_batches, held, persisted, scratch

#: Rows whose crc32 of the id as text has this remainder by 4 are held out.
HELD_OUT = 2
#: Bound of the training sample: labelled rows of both labels, those with the least hashes of their ids, and of these as
#: many, in that order, as have so many characters in sum. Texts of any length take part, and whole.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 16_000_000
THRESHOLD = 0.3
WINDOW, DIMENSIONS, BUCKETS, GRAMS = 3, 8, 1 << 17, (3, 4, 5)
EPOCHS, WARM = 160, 30
#: Words a worker keeps the weights of; on reaching it, it starts anew.
MOST_WORDS = 200_000
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA1, 0xAB, 0xBB, 0xBF, 0x201C, 0x201D, 0x2018, 0x2019, 0x2026]))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features one after the other, and how many each word has: the word itself, and the 3 to
    5 byte strings of it between `<` and `>`."""
    coded = [b"<%s>" % w.strip(_EDGES).encode() for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(coded)), sizes)
    found = [(np.arange(len(coded)), np.fromiter((xxhash.xxh32_intdigest(w) for w in coded), np.uint32, len(coded)))]
    for n in GRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            fits = np.arange(len(h)) + n <= ends[: len(h)]
            found.append((owner[: len(h)][fits], h[fits] * np.uint32(0x9E3779B1)))
    owners = np.concatenate([o for o, _ in found])
    order = np.argsort(owners, kind="stable")
    buckets = (np.concatenate([h for _, h in found]) >> np.uint32(15))[order].astype(np.int32) % BUCKETS
    return buckets, np.bincount(owners, minlength=len(coded))


def _means(weights: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean weight of each word's features."""
    return np.add.reduceat(weights[buckets], np.cumsum(counts) - counts) / counts if len(counts) else np.zeros(0)


def _windows(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each window of texts (with a word or more) of so many words, and how many
    windows each text has: all runs of `window` words, or the whole of a shorter text."""
    per = np.maximum(1, sizes - window + 1)
    begin = np.cumsum(sizes) - sizes
    first = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin, per)
    return first, np.minimum(np.repeat(sizes, per), window), per


@dataclass
class Model:
    """weights: of each bucket, its embedding times the difference of the softmax's two rows. An average of products is
    the product of the average, so a window's logit is the bias plus the mean of its words' mean weights."""

    weights: np.ndarray
    bias: float
    window: int = WINDOW

    def word_weights(self, words: list[str]) -> np.ndarray:
        return _means(self.weights, *features(words))


def train(texts: list[str], labels: list[int], share: float | None = None, window: int = WINDOW, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Embeddings and softmax, trained jointly by Adam on whole batches. A text's logit is its highest window's, so that
    a few words count in a text of any length; in the first epochs it is that of all its words' average, from which the
    windows to look at emerge. share: of label 1 among all such texts, where the sample has another; texts then count
    by how much of theirs the sample has. Without texts of both labels the model gives every text the same score."""
    number: dict[str, int] = {}
    coded = [np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split()), np.int32) for t in texts]
    y = np.array([v for v, s in zip(labels, coded, strict=True) if len(s)], float)
    coded = [s for s in coded if len(s)]
    sampled = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    share = min(max(sampled if share is None else share, 1e-3), 1 - 1e-3)
    counting = np.where(y > 0, share / sampled, (1 - share) / (1 - sampled))
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), bias, window)
    words, sizes = np.concatenate(coded), np.fromiter(map(len, coded), np.int64, len(coded))
    known = list(number)
    made = [features(known[i : i + 20_000]) for i in range(0, len(known), 20_000)]  # its working memory is for a part
    buckets, counts = np.concatenate([b for b, _ in made]), np.concatenate([c for _, c in made])
    del number, known, coded, made
    begin = np.cumsum(counts) - counts
    first, width, per = (x.astype(np.int32) for x in _windows(sizes, window))
    starts, whole = np.cumsum(per) - per, np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 1, DIMENSIONS).astype(np.float32)
    moments = [[np.zeros_like(e), np.zeros_like(e)], [np.zeros_like(w), np.zeros_like(w)], [0.0, 0.0]]
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), per)
    for epoch in range(1, epochs + 1):
        s = _means(e @ w, buckets, counts)[words]
        if epoch <= WARM:
            z = np.add.reduceat(s, whole) / sizes + bias
            g = counting * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad_word = np.bincount(words, np.repeat(g / sizes, sizes), len(counts))
        else:
            c = np.concatenate([[0.0], np.cumsum(s, dtype=np.float64)])
            means = ((c[first + width] - c[first]) / width).astype(np.float32)
            best = np.maximum.reduceat(means, starts)
            top = np.flatnonzero(means == best[owner])
            top = top[np.unique(owner[top], return_index=True)[1]]
            g = counting * (1 / (1 + np.exp(-np.clip(best + bias, -30, 30))) - y)
            k = width[top]
            at = np.repeat(first[top], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            grad_word = np.bincount(words[at], np.repeat(g / k, k), len(counts))
        touched = np.flatnonzero(grad_word)
        k = counts[touched]
        at = np.repeat(begin[touched], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        grad = np.bincount(buckets[at], np.repeat(grad_word[touched] / k, k), BUCKETS).astype(np.float32)
        grads = [grad[:, None] * w, grad @ e, float(g.sum())]
        for i, (value, d) in enumerate(zip((e, w, bias), grads, strict=True)):
            m = moments[i]
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.99 * m[1] + 0.01 * d * d
            step = 0.1 * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.99**epoch)) + 1e-6)
            if i == 2:
                bias = float(value - step)
            else:
                value -= step
    return Model((e @ w).astype(np.float32), bias, window)


class Scorer:
    """Scores of whole texts by a model; keeps the weights of words it has met."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        needed = set().union(*split)
        missing = needed - self.words.keys()
        if len(self.words) + len(missing) > MOST_WORDS:
            self.words, missing = {}, needed
        missing = list(missing)
        self.words.update(zip(missing, self.model.word_weights(missing).tolist(), strict=True))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        s = np.fromiter((x for t in split for x in map(self.words.__getitem__, t)), float, sizes.sum())
        out, some = np.zeros(len(texts)), sizes > 0
        if some.any():
            first, width, per = _windows(sizes[some], self.model.window)
            c = np.concatenate([[0.0], np.cumsum(s)])
            best = np.maximum.reduceat((c[first + width] - c[first]) / width, np.cumsum(per) - per)
            out[some] = 1 / (1 + np.exp(-np.clip(best + self.model.bias, -700, 700)))
        return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled rows that aren't held out: of either label those rows / 2 with the least hashes of their
    ids, and of these the first, in that order, that have chars / 2 characters in sum (the first one in any case). Only
    this sample comes to the driver. Of an id with both labels 1 counts; labels other than 0 and 1 do not."""
    id_, order = F.col(f"`{id_col}`"), [F.xxhash64("id"), F.col("id")]
    with scratch():
        known = labels.select(id_.alias("id"), F.col(f"`{label_col}`").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").cast("int").alias("y"))
        share = known.agg(F.avg("y")).head()[0]
        some = lambda y: known.where(F.col("y") == y).orderBy(*order).limit(rows // 2)
        known = persisted(some(0).union(some(1)))
        texts = docs.select(id_.alias("id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
        texts = persisted(texts.join(F.broadcast(known), "id"))
        before = F.sum("chars").over(W.partitionBy("y").orderBy(*order, "row").rowsBetween(W.unboundedPreceding, -1))
        fits = texts.select("id", "y", "row", F.length("t").alias("chars")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars // 2)
        got = texts.join(F.broadcast(fits.select("row")), "row", "left_semi").select("id", "t", "y").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    return train(got["t"].to_pylist(), got["y"].to_pylist(), share)


def _scored(docs: DataFrame, model: Model, text_col: str, columns: list[str]) -> DataFrame:
    """The columns named, as c0, c1 and so on, and score, of each row, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    sends = columns if text_col in columns else [*columns, text_col]
    width, at = len(columns), sends.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value  # the same object for all tasks of a worker; its scorer keeps it alive
        scorer = held(("scorer", id(model)), lambda: Scorer(model))
        for b in batches:
            scores = np.concatenate([scorer(texts) for _, texts in blocks(b.column(at))]) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), pa.array(scores)], names=[*(f"c{i}" for i in range(width)), "score"])

    kinds = [docs.schema[c].dataType.simpleString() for c in columns]
    chosen = docs.select(*(F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`") for c in sends))
    return bounded_batches(chosen).mapInArrow(score, ", ".join([*(f"c{i} {k}" for i, k in enumerate(kinds)), "score double"]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of each row. Every window of the whole text counts; texts without words (null ones too)
    score 0. Repeated rows are scored each; empty tables give no rows; other columns are not read."""
    return _scored(docs, model, text_col, [id_col]).withColumnRenamed("c0", id_col)


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, whatever their names, whose score is below the threshold."""
    below = _scored(docs, model, text_col, docs.columns).where(F.col("score") < threshold)
    return below.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
