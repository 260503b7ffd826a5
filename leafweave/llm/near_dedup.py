"""Near-duplicates by BagMinHash signatures of five-word shingle multisets, bands, and verified multiset overlap.

A text's shingles are a multiset. The weight of a shingle is its number of occurrences, so the similarity of two texts
is the weighted Jaccard similarity: the sum of the smaller counts over the sum of the larger ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import blocks, bounded_batches, broadcast_if_small, held, mark_of, persisted, scratch, splitmix

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 25 = 0.00005.
BANDS, ROWS = 25, 5
#: Rows of a bucket that are compared at once.
BLOCK = 256
#: Shingles of the texts of a block, on average.
BLOCK_SHINGLES = 250_000


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words of a text, lower-cased, as often as they come; a text of fewer words has its
    words as its one shingle, a text without words none."""
    words = text.lower().encode().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = splitmix(out ^ h[k : k + n])
    return out


def _unit(bits: np.ndarray) -> np.ndarray:
    """Above 0 up to 1."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, length: int) -> np.ndarray:
    """[text, place] signatures of weighted sets: element[i] has a weight of weight[i], a whole number, in text owner[i].

    Weights are cut into the ranges [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each element has for each range a Poisson
    process of its own, seeded by both, whose rate is the range's width; each of its points, in the order of time, has
    a place of the signature and a weight within the range, and counts where the text's weight is above that: so of a
    range that a weight cuts in two, texts of different weights see the same points below both. A signature has for
    each place the earliest point's time. Two signatures agree in a place with the weighted Jaccard similarity as its
    probability. A process ends once its time is past the text's latest place, so most give a point or two."""
    level = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))), 0).astype(np.int64) + 1  # ranges it reaches into
    i = np.repeat(np.arange(len(owner)), level)
    r = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level)
    low = np.where(r > 0, 2.0 ** (r - 1), 0.0)
    width = np.where(r > 0, low, 1.0)
    doc, top = owner[i], weight[i].astype(np.float64)
    seed = splitmix(element[i] ^ splitmix(r.astype(np.uint64) + np.uint64(77)))
    time = np.zeros(len(i))
    out = np.full((texts, length), np.inf)
    flat = out.ravel()
    latest = np.full(texts, np.inf)
    while len(doc):
        seed = splitmix(seed)
        time = time - np.log(_unit(seed)) / width
        alive = time < latest[doc]
        doc, time, seed, low, width, top = doc[alive], time[alive], seed[alive], low[alive], width[alive], top[alive]
        other = splitmix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        place = (other % np.uint64(length)).astype(np.int64)
        counts = low + _unit(splitmix(other)) * width <= top
        np.minimum.at(flat, doc[counts] * length + place[counts], time[counts])
        some = np.unique(doc)
        latest[some] = out[some].max(axis=1) if len(some) else 0
    return out


def _grouped(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    found = [shingles(t) for t in texts]
    return found, np.fromiter(map(len, found), np.int64, len(found))


def signed(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """texts (id, mark, t) as id, mark, words (a hash of the text's words in their order), n (its shingles), bands (a key
    for each band) and sketch (a byte for each place of the signature)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = bands * rows
        held("signatures", lambda: None)
        for b in batches:
            for first, texts in blocks(b.column(2), 1 << 20):
                found, n = _grouped(texts)
                owner = np.repeat(np.arange(len(texts)), n)
                every = np.concatenate(found) if found else np.zeros(0, np.uint64)
                order = np.lexsort((every, owner))
                owner, every = owner[order], every[order]
                new = np.ones(len(every), bool)
                new[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                weight = np.diff(np.append(at, len(every)))
                bits = signatures(owner[at], every[at], weight, len(texts), length).view(np.uint64)
                key = np.zeros((len(texts), bands), np.uint64)
                for k in range(rows):
                    key = splitmix(key ^ bits[:, k::rows])
                sketch = splitmix(bits.ravel()).astype(np.uint8).reshape(len(texts), length)
                words = [hashlib.sha256(b" ".join(t.lower().encode().split())).digest() for t in texts]
                some = n > 0
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]), pa.int32()), pa.array(key[some].ravel().view(np.int64)))
                mine = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(words, pa.binary()), pa.array(n, pa.int64()), keys, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "mark", "words", "n", "bands", "sketch"])

    kind = texts.schema["id"].dataType.simpleString()
    return bounded_batches(texts).mapInArrow(sign, f"id {kind}, mark string, words binary, n long, bands array<long>, sketch binary")


def _likely(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches [pair, place] may be of texts so similar: six standard errors leave one pair in 10 ** 9 out."""
    length = a.shape[-1]
    least = similarity - 6 * np.sqrt(similarity * (1 - similarity) / length)
    return (a == b).sum(axis=-1) >= least * length


def _bag(text: str) -> np.ndarray:
    x = np.sort(shingles(text))
    rank = np.arange(len(x)) - np.searchsorted(x, x)  # how many equal ones came before
    return np.sort(splitmix(x ^ splitmix(rank.astype(np.uint64))))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Items that two sorted arrays without repeats share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = _overlap(x, y)
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _fit(a: Column, b: Column, similarity: float) -> Column:
    """Whether numbers of shingles allow the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def _bags(texts: DataFrame) -> DataFrame:
    """row, bag: sorted hashes of a text's (shingle, how many equal ones came before), so that the overlap of multisets is
    that of sets."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in blocks(b.column(1), 2 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)), pa.array([_bag(t).tobytes() for t in some], pa.binary())], names=["row", "bag"])

    return bounded_batches(texts.select("row", "t")).mapInArrow(bag, "row long, bag binary")


def _sketch_filter(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sketches allow the similarity."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(len(b), -1) if len(b) else np.zeros((0, 1), np.uint8) for k in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array(_likely(x, y, similarity), pa.bool_()))

    one = pairs.join(sketches.select(F.col("row").alias("a"), F.col("sketch").alias("sa")), "a")
    both = one.join(sketches.select(F.col("row").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")
    return bounded_batches(both).mapInArrow(agree, "a long, b long")


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs whose shingle multisets are so similar. Bags move to the pairs, which are as many as texts for the
    most part; a hot text's pairs are split by adaptive execution, as both sides are written tables."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(bags.select(F.col("row").alias("a"), F.col("bag").alias("ba")), "a")
    two = one.join(bags.select(F.col("row").alias("b"), F.col("bag").alias("bb")), "b").select("a", "b", "ba", "bb")
    return bounded_batches(two).mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """row, label: the least row of each one's connected component, for all rows in links (a, b). Rounds of taking the
    least label of the neighbours and then the label's own label, each written out, until none changes."""
    with scratch():
        both = persisted(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
        labels = both.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("m")).select("row", F.least("row", "m").alias("label"))
        while True:
            labels = persisted(labels)
            near = both.join(labels.select(F.col("row").alias("b"), "label"), "b").groupBy(F.col("a").alias("row")).agg(F.min("label").alias("m"))
            least = labels.join(near, "row").select("row", F.least("label", "m").alias("new"), "label")
            jump = labels.select(F.col("row").alias("new"), F.col("label").alias("far"))
            after = persisted(least.join(jump, "new", "left").select("row", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old")))
            labels = after.select("row", "label")
            if not after.where("label <> old").head(1):
                return persisted(labels, lasting=True)


def _crossed(labelled: DataFrame, first: DataFrame, bags: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: verified links between rows (labelled: band, key, row, n, label) of one bucket with different labels.

    In each bucket the rows outside its most frequent label are the queries, against all its rows. Queries and rows are
    dealt into blocks bounded in rows and shingles, and each two blocks that meet are a cell of their own, dealt by
    bucket and blocks: so a hot bucket is many cells on many tasks. No row is left out; a pair is verified within its
    cell, in the first band that both share, once its sizes and sketches allow the similarity, and becomes a row
    only as a link. A task holds one cell at a time."""
    per = labelled.groupBy("band", "key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("band", "key")
    per = per.agg(F.max(F.struct("c", "label", "s")).alias("major"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("labels")).where("labels > 1")
    parts = lambda c, s: F.greatest(F.ceil(c / block), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    open_ = broadcast_if_small(per.select("band", "key", F.col("major.label").alias("major"), parts(F.col("c") - F.col("major.c"), F.col("s") - F.col("major.s")).alias("qs"), parts(F.col("c"), F.col("s")).alias("hs")), lasting=False)
    rows = labelled.join(open_, ["band", "key"])
    part = lambda seed, of: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked = rows.where("label <> major").select("band", "key", "row", "n", "label", F.lit(0).alias("side"), part(1, "qs").alias("q"), every("hs").alias("h"))
    held_ = rows.select("band", "key", "row", "n", "label", F.lit(1).alias("side"), every("qs").alias("q"), part(2, "hs").alias("h"))
    some = rows.select("row").distinct()
    facts = persisted(first.join(some, "row", "left_semi").select("row", "sketch", "bands").join(bags, "row"))
    cells = asked.union(held_).join(facts, "row").select("band", "key", "q", "h", "side", "row", "n", "label", "sketch", "bands", "bag")

    def compared(cell: pa.Table) -> pa.RecordBatch:
        band, side = cell["band"][0].as_py(), np.asarray(cell["side"])
        row, n, label = (np.asarray(cell[c]) for c in ("row", "n", "label"))
        sketch = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(len(cell), -1)
        keys = np.asarray(cell["bands"].combine_chunks().flatten()).reshape(len(cell), -1)
        bag = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell["bag"]]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        fits = (label[x, None] != label[y]) & (np.minimum(n[x, None], n[y]) >= similarity * np.maximum(n[x, None], n[y]) - 1e-9)
        for k in range(band):  # pairs that share an earlier band are compared there
            fits &= keys[x, k, None] != keys[y, k]
        left, right = np.nonzero(fits)
        found: list[tuple[int, int]] = []
        for at in range(0, len(left), 1 << 15):
            i, j = x[left[at : at + (1 << 15)]], y[right[at : at + (1 << 15)]]
            likely = _likely(sketch[i], sketch[j], similarity)
            found += [(row[a], row[b]) for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True) if _similar(bag[a], bag[b], similarity)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[pa.RecordBatch] = []
        at: tuple = ()
        for b in batches:
            where = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in range(4)])
            edges = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), len(b)] if len(b) else []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if cell and at != tuple(where[:, begin]):
                    yield compared(pa.Table.from_batches(cell))
                    cell = []
                at = tuple(where[:, begin])
                cell.append(b.slice(begin, end - begin))
        if cell:
            yield compared(pa.Table.from_batches(cell))

    cell = ["band", "key", "q", "h"]
    return bounded_batches(cells.repartition(*cell).sortWithinPartitions(*cell)).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """id_col, class_id, kept and mark (the text's MD5) of each row of docs: class_id is the least id of the connected
    component of texts that are so similar; of a class one row with that id is kept.

    1. Signatures of all rows are made once and written to the shared folder, with a number for each row. Texts of the
       same words (compared by SHA-256) are one class from the start and take part through the row of the least id.
    2. Bands put texts in buckets. Of each bucket the text that shares the most buckets' rows with others, likely the
       common original, is compared with every other: pairs grow with the rows of buckets, not with their square.
       Verified pairs are linked, and their components labelled.
    3. Where a bucket still has more than one label, its other pairs of different labels are compared too, in blocks,
       first by sketches, then as multisets. So no pair that shares a band is left out: links within one component would
       not change it.
    Rows are told apart by their own numbers, so an id may stand for several texts: each takes part.
    Rows with a null id, and texts without words (null ones too), are no duplicates of anything: they are kept, each
    a class of its own with its own id. Rows with the same id and words are one class and all but one of them go.
    Empty tables give no rows; other columns are not read."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), mark_of(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("t"))
    with scratch():
        made = persisted(signed(texts, bands, rows).withColumn("row", F.monotonically_increasing_id()), lasting=True)
        whole = F.struct("id", "row", "mark", "n", "bands", "sketch")
        same = made.where("id IS NOT NULL AND n > 0").groupBy("words").agg(F.min_by(whole, F.struct("id", "row")).alias("first"), F.count("*").alias("copies"))
        same = persisted(same.select("words", "copies", "first.*"))
        first = same.select("id", "row", "mark", "n", "bands", "sketch")
        banded = first.select("row", "n", F.posexplode("bands").alias("band", "key"))
        buckets = persisted(banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"))
        members = persisted(banded.join(buckets, ["band", "key"]))
        score = persisted(members.groupBy("row").agg(F.sum("size").alias("score")))
        ranked = persisted(members.join(score, "row").select("band", "key", "row", "n", "score"))
        reps = persisted(ranked.groupBy("band", "key").agg(F.min_by(F.struct("row", "n"), F.struct(-F.col("score"), F.col("row"))).alias("rep")))
        stars = ranked.join(reps, ["band", "key"]).select(F.col("rep.row").alias("a"), F.col("row").alias("b"), F.col("rep.n").alias("na"), F.col("n").alias("nb"))
        stars = stars.where((F.col("a") != F.col("b")) & _fit(F.col("na"), F.col("nb"), similarity)).select("a", "b").distinct()
        stars = persisted(_sketch_filter(stars, first, similarity))
        wanted = score.select("row").join(first.select("row", "id", "mark"), "row")
        bags = persisted(_bags(texts.join(wanted, ["id", "mark"]).select("row", "t")).dropDuplicates(["row"]))
        links = persisted(_verified(stars, bags, similarity))
        labels = components(links)
        labelled = persisted(ranked.select("band", "key", "row", "n").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")))
        crossed = persisted(_crossed(labelled, first, bags, similarity, block))
        if crossed.head(1):
            labels = components(links.union(crossed))
        # Of a class the row of the least id stays. Texts without links or copies are not in the table of classes.
        best = labels.join(first.select("row", "id"), "row").groupBy("label").agg(F.min(F.struct("id", "row")).alias("best"))
        known = same.select("words", "copies", "row", "id").join(labels.join(persisted(best), "label").select("row", "best"), "row", "left")
        classes = broadcast_if_small(known.where("copies > 1 OR best IS NOT NULL").select("words", F.coalesce("best", F.struct("id", "row")).alias("best")))
    live = F.col("id").isNotNull() & (F.col("n") > 0)
    out = made.join(classes, "words", "left")
    kept = ~live | F.col("best").isNull() | (F.col("best.row") == F.col("row"))
    return out.select(F.col("id").alias(id_col), F.when(live, F.coalesce("best.id", "id")).otherwise(F.col("id")).alias("class_id"), kept.alias("kept"), "mark")
