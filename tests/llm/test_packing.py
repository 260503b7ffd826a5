import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leafweave.llm import packing


@pytest.mark.parametrize("length", [7, 4096])
def test_every_id_lies_in_one_piece(documents, awkward, length):
    rows = awkward + [(20 + i, f"Some words, number {i}: l'été 3.14 " * i) for i in range(40)]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=repr)
    got = packing.pack(documents(rows), length=length).collect()
    filled = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 0 < r.length <= length - r.offset
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in filled.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or k == max(filled)
    docs, run = [], {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):  # documents lie one after the other
        run.setdefault("ids", []).extend(np.frombuffer(r.ids, "<u4").tolist())
        assert r.start + r.length == len(run["ids"])
        if r.start + r.length == r.doc_tokens:
            docs.append((r.doc_id, run.pop("ids")))
    assert not run and sorted(docs, key=repr) == want


def test_empty_table(documents):
    assert packing.pack(documents([(1, "x")]).where("doc_id < 0")).collect() == []


def test_ids_are_those_of_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["", " ", "Word. word, (WORD) \"word.\" don't. It'S, x'y. 'll. 3.14, ...a.. a.) a.b. . !", "<|endoftext|> <|ENDOFTEXT|> x<|endoftext|>. <|a. <|", "H\u0331 h\u0331 A\u030a \u0301 a \u0301. K ſ İ ẞ. É. 日本、 日本. 3٣. a\xa0b\u2003c\u3000d\x85e",
             "a\x02b \x02 \x02. \x00 a\x1cb\x1f \t\x0b\x0c\r\n\x7f", "x" * 70 + ". " + "Y" * 5000 + ", \U0001f600" * 40, " Ends. ", "."]
    r = random.Random(5)
    odd = [*" \t\n aAbhHsStT.,;:!?)('\"<|>-_39", "\x02", "\x1e", "\x85", "\xa0", "\u2028", "é", "É", "\u0301", "\u0331", "\u0338", "Σ", "ς", "İ", "ß", "日", "٣", "½", "\u200d", "\U0001f600", "'ll", "'S", "<|endoftext|>", "<|StartOfText|>"]
    texts += ["".join(r.choices(odd, k=r.randrange(60))) for _ in range(1500)]
    want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for some in (texts, texts[::-1]):  # learnt, then looked up
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(some)] == (want if some is texts else want[::-1])
    column = pa.array([None, *texts, None], pa.large_string())
    assert [np.frombuffer(x, "<u2").tolist() for x in encode.packed(column.slice(3, 700)).to_pylist()] == want[2:702]
    assert encode.packed(column.slice(0, 1)).to_pylist() == [encode.end] and len(encode.packed(column.slice(0, 0))) == 0


def test_words_are_kept_whatever_stops_and_case_and_long_ones_are_not(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.WordIds(path)
    encode(["Word word. WORD, (word) " + "y" * 100_000])
    assert set(encode.words) == {"word", ".", ",", "(word", ")"}
    learnt, learn = [], encode._learn
    monkeypatch.setattr(encode, "_learn", lambda words: learnt.extend(words) or learn(words))
    monkeypatch.setattr(packing, "MOST_WORDS", 6)
    encode(["word. two three"])  # the cache is full: those in use stay
    assert learnt == ["two", "three"] and set(encode.words) == {"word", ".", "two", "three"}


def test_word_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole = packing.WordIds(path), Tokenizer.from_file(path)
    for texts in (["a b c"], ["a b d e f"], ["c d e", "g h i j k l"], ["Lorem ipsum a-b"]):
        for t, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]
