"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, and becomes a recipe: the ordered list of its chunks'
identifiers. A chunk's bytes move once, to verify that its identifier stands for one content; whole texts never
move: groups are made of recipes, which hold 12 bytes for about 2 KB of text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import bounded_batches, broadcast_if_small, held, persisted, scratch, splitmix

#: Bytes of a chunk: at least, on average beyond that, at most.
LEAST, MEAN, MOST = 512, 2048, 16384
_GEAR = (splitmix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SLICE = 1 << 20


def cuts(data: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Places after which the rolling hash allows a cut. The hash at a place depends on the 32 bytes up to it."""
    found, bits = [], np.uint32(((mean - 1) << 16) & 0xFFFFFFFF)
    for at in range(0, len(data), _SLICE):
        low = max(0, at - 31)
        h = _GEAR[data[low : at + _SLICE]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
        found.append(np.flatnonzero((h & bits) == 0) + low + 1)
        found[-1] = found[-1][found[-1] > at]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(data: np.ndarray, starts: np.ndarray) -> Iterator[list[int]]:
    """For each text, data[starts[i]:starts[i + 1]], the ends of its chunks. They depend on that text alone: a chunk
    has LEAST bytes or more, so that the hash at its end has seen no byte before it."""
    allowed = cuts(data)
    first = np.searchsorted(allowed, starts[:-1] + LEAST).tolist()
    allowed = allowed.tolist()
    for begin, end, k in zip(starts[:-1].tolist(), starts[1:].tolist(), first, strict=True):
        ends = []
        while end - begin > LEAST:
            while k < len(allowed) and allowed[k] < begin + LEAST:
                k += 1
            cut = min(allowed[k] if k < len(allowed) else end, begin + MOST)
            if cut >= end:
                break
            ends.append(cut)
            begin = cut
        ends.append(end)
        yield ends


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 of an Arrow column of texts, one after the other, and where each starts and the last ends."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    return memoryview(whole)[starts[0] : starts[-1]] if whole else memoryview(b""), starts - starts[0]


def _digest(piece: memoryview, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(piece) & ((1 << bits) - 1)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 63) -> DataFrame:
    """row (a number of its own), id, sha (of the text), recipe: for each chunk its digest (8 bytes) and length (4)."""

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held("recipes", lambda: None)
        for b in batches:
            data, starts = _bytes(b.column(1))
            made, shas = [], []
            for begin, ends in zip(starts[:-1].tolist(), chunks(np.frombuffer(data, np.uint8), starts), strict=True):
                shas.append(hashlib.sha256(data[begin : ends[-1]]).hexdigest())
                recipe = bytearray()
                for end in ends:
                    recipe += _digest(data[begin:end], bits).to_bytes(8, "big") + (end - begin).to_bytes(4, "big")
                    begin = end
                made.append(bytes(recipe))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(b)), pa.int64()), b.column(0), pa.array(shas, pa.string()), pa.array(made, pa.binary())], names=["row", "id", "sha", "recipe"])
            row += len(b)

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))).mapInArrow(cook, f"row long, id {kind}, sha string, recipe binary")


def ambiguous(docs: DataFrame, text_col: str = "text", bits: int = 63) -> DataFrame:
    """digest and size of the chunks whose digest and size stand for more than one content. Contents are compared
    byte by byte: equal ones meet in one group however often they come, first within each map task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts = _bytes(b.column(0))
            seen: dict[bytes, int] = {}
            for begin, ends in zip(starts[:-1].tolist(), chunks(np.frombuffer(data, np.uint8), starts), strict=True):
                for end in ends:
                    if (piece := bytes(data[begin:end])) not in seen:
                        seen[piece] = _digest(piece, bits)
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.int64()), pa.array(seen, pa.binary())], names=["digest", "chunk"])

    contents = bounded_batches(docs.select(F.col(f"`{text_col}`").cast("string"))).mapInArrow(cut, "digest long, chunk binary").groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    return contents.select("digest", F.length("chunk").alias("size")).groupBy("digest", "size").agg(F.count("*").alias("contents")).where("contents > 1")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 63) -> DataFrame:
    """id_col, keep_id, group_size, kept and text_sha256 of each row of docs.

    Texts are equal when identical; null counts as empty. Of a group the row with the largest id stays (a null id is
    the least; of rows with the same id and text one stays). Repeated rows count each. Empty tables give no rows;
    other columns are not read. bits: of the digests, fewer only for tests."""
    with scratch():
        made = recipes(docs, id_col, text_col, bits)
        if (doubtful := persisted(ambiguous(docs, text_col, bits))).head(1):
            made = _resolved(persisted(made), doubtful)
        made = persisted(made, lasting=True)
        best = F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "row")).alias("best")
        groups = broadcast_if_small(made.groupBy("recipe").agg(best, F.count("*").alias("group_size")).where("group_size > 1"))
    return made.join(groups, "recipe", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _resolved(made: DataFrame, doubtful: DataFrame) -> DataFrame:
    """made, with recipes that tell apart the contents of the doubtful digests: the recipe of a text that has one ends
    with the text's SHA-256. Reached only where two chunks share 63 bits and a length."""
    numbered = made.select("row", F.posexplode(F.expr("transform(sequence(0, cast(length(recipe) / 12 as int) - 1), i -> substring(recipe, 12 * i + 1, 12))")).alias("place", "entry"))
    marks = doubtful.select(F.unhex(F.concat(F.lpad(F.hex("digest"), 16, "0"), F.lpad(F.hex("size"), 8, "0"))).alias("entry"))
    touched = numbered.join(marks, "entry", "left_semi").select("row").distinct()
    return made.join(touched.withColumn("hit", F.lit(True)), "row", "left").select("row", "id", "sha", F.when(F.col("hit"), F.concat("recipe", F.unhex("sha"))).otherwise(F.col("recipe")).alias("recipe"))
