"""Packing by concatenate and cut: token totals of partitions, prefix sums, fixed windows with boundary records."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from string import ascii_letters, digits

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.llm.common import bounded_batches, broadcast_if_small, held, persisted, runs_of

LENGTH, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k.json"

#: How many words' ids a worker keeps, and the longest words kept; at that number it starts anew with those in use.
MOST_WORDS, LONGEST = 700_000, 64
#: Words encoded at once, one after the other, and what stands after each: a pre-token and an id of its own.
TOGETHER, MARK = 1000, "\x02"
_ALNUM, _STOP = (np.array([chr(c) in some for c in range(256)]) for some in (ascii_letters + digits, ".,;:!?)"))


class WordIds:
    """Ids of texts as the tokenizer's library gives them, by way of runs without ASCII white space: no pre-token of this
    tokenizer holds white space and its normaliser does not look across it, so a text's ids are those of its runs, one
    after the other. Arrow cuts the texts and finds each block's distinct runs; ids of those that recur are looked up,
    the others go through the whole tokenizer, many at once. A last stop after an ASCII letter or digit is a pre-token
    of its own, and so a run of its own. Case is folded beforehand in ASCII runs alone, as letters with combining marks
    may compose in one case only, and never in what may hold a special string, which is told by case."""

    def __init__(self, path: str, end: int = END_ID):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.whole.get_vocab_size(), end + 1) <= 65536 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        (self.mark,) = self.whole.encode(MARK, add_special_tokens=False).ids
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words."""
        some, out = [], {}
        for w in words:
            if len(w) > LONGEST or "<|" in w or MARK in w:
                out[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
            else:
                some.append(w)
        for first in range(0, len(some), TOGETHER):
            part = some[first : first + TOGETHER]
            ids = np.array(self.whole.encode(f" {MARK} ".join([*part, ""]), add_special_tokens=False).ids, self.kind)
            packed, size = ids.tobytes(), self.kind.itemsize
            last = np.flatnonzero(ids == self.mark) * size
            out.update(zip(part, map(packed.__getitem__, map(slice, [0, *(last + size).tolist()[:-1]], last.tolist())), strict=True))
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, of which short ones are kept."""
        found = list(map(self.words.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not missing:
            return found
        if len(self.words) + len(missing) > MOST_WORDS:
            self.words = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}
        learnt = self._learn(missing)
        self.words.update((w, learnt[w]) for w in missing[: MOST_WORDS - len(self.words)] if len(w) <= LONGEST)
        return [learnt[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def packed(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, and the end, as little-endian numbers; null counts as empty."""
        if not len(texts):
            return pa.array([], pa.binary())
        texts = pa.compute.fill_null(texts.cast(pa.string()), "")
        split = pa.compute.ascii_split_whitespace(texts)
        runs, first = split.flatten(), np.asarray(split.offsets, np.int64)
        first = first - first[0]
        # Last stops are cut off by one more offset each; the letters stay where they are.
        at = np.frombuffer(runs.buffers()[1], "<i4", len(runs) + 1, 4 * runs.offset)
        letters = np.frombuffer(runs.buffers()[2] or b"", np.uint8)
        stopped = np.flatnonzero(np.diff(at) > 1)
        last = at[stopped + 1]
        stopped = stopped[_STOP[letters[last - 1]] & _ALNUM[letters[last - 2]]] + 1
        at = np.insert(at, stopped, at[stopped] - 1)
        first += np.searchsorted(stopped, first, side="right")
        runs = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), runs.buffers()[2]])

        plain = pa.compute.string_is_ascii(runs)
        if pa.compute.any(pa.compute.match_substring(texts, "<|")).as_py():
            plain = pa.compute.and_not(plain, pa.compute.match_substring(runs, "<|"))
        low = pa.compute.ascii_lower(runs)
        coded = (low if pa.compute.all(plain).as_py() else pa.compute.if_else(plain, low, runs)).dictionary_encode()
        known = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array([*known, self.end], pa.binary())
        which = np.insert(coded.indices.to_numpy(), first[1:], len(known))
        ids = ids.take(pa.array(which))
        ends = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1)[first + np.arange(len(first))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.packed(pa.array(texts, pa.string())).to_pylist()


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """id, part (the partition), at (tokens of the partition before this text), n and ids (little-endian unsigned
    numbers of 2 bytes, or 4 where the vocabulary is larger than 65536) of each row; null texts count as empty."""
    path = path or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(("words", path, end_id), lambda: WordIds(path, end_id))
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, rows in runs_of(b.column(1), 4 << 20):
                gc.disable()  # what is made here has no cycles, and is much
                ids = encode.packed(b.column(1).slice(first, rows))
                gc.enable()
                n = np.diff(np.frombuffer(ids.buffers()[1], "<i4", rows + 1)).astype(np.int64) // encode.kind.itemsize
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, rows), pa.array(np.full(rows, part, np.int32)), pa.array(at + np.cumsum(n) - n), pa.array(n), ids], names=["id", "part", "at", "n", "ids"])
                at += int(n.sum())

    return bounded_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))).mapInArrow(tokenise, f"id {kind}, part int, at long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of the rows' token ids in sequences of `length`: id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (little-endian unsigned 32-bit).

    Rows' ids, each row's followed by end_id, lie one after the other in the order of partitions, and are cut every
    `length` ids; so only the last sequence may be short and each id is in one piece. First pass: ids are made once
    and written to the shared folder, which also fixes the order that a lost executor must not change. Then the
    partitions' totals (one row a partition) get prefix sums, and are broadcast: their number is checked. Second
    pass: each row is cut where its global place meets a window's edge; a row over several windows gives a record
    for each. Empty and null texts are a lone end_id; repeated rows are packed each; empty tables give no rows."""
    made = persisted(tokenised(docs, id_col, text_col, path, end_id), lasting=True)
    totals = made.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    placed = made.join(broadcast_if_small(before, 1_000_000), "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for i, at, n, ids in zip(range(len(b)), b.column("place").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{len(ids.as_buffer()) // n}").astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    some = min(n - done, length - offset)
                    piece = ids[done : done + some].tobytes()
                    for to, x in zip(rows, (i, done, some, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        to.append(x)
                    done += some
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:7]), pa.array(rows[7], pa.binary())], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = placed.select("id", "n", "ids", (F.col("before") + F.col("at")).alias("place"))
    return bounded_batches(out).mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
