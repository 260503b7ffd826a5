import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafweave.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", " ", "  ", "\n", "\n ", "\t", "\xa0", "a", "re", "v", "l", "12", "3", "!", "?!", "é", "ß", "日本", "\U0001f600", "́", "²", "\x00", "The", " hello", "<|endoftext|>", "'S", "ll", "e"]


@pytest.fixture(scope="module")
def counter():
    return C.Counter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_against_the_library(counter, library):
    r = random.Random(3)
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(14))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(1, 0xD7FF), r.randrange(0xE000, 0x10FFFF)])) for _ in range(r.randrange(30))) for _ in range(1000)]
    texts += ["x" * 3000, "ab" * 2000, " " * 700 + "a", "\n" * 600, "".join(r.choices("etaoin", k=5000))]
    n_bytes, tokens = counter(texts)
    assert tokens.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunk_maps_compose(counter, chunk):
    r = random.Random(chunk)
    text = "".join(r.choice(BITS) for _ in range(400))
    points = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
    ends = np.array([len(points) - 1])
    assert counter.lexer.begins(points, ends, chunk).tolist() == counter.lexer.begins(points, ends, 4096).tolist()


def test_caches_start_anew(monkeypatch, library):
    monkeypatch.setattr(C, "MOST_WORDS", 4)
    monkeypatch.setattr(C, "PAIR_BITS", 2)
    counter = C.Counter(PATH)
    for texts in (["a b c d"], ["unbelievable antidisestablishmentarianism", "a b"], ["internationalisation of pseudopseudohypoparathyroidism"]):
        assert counter(texts)[1].tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_table(documents, awkward, library):
    got = C.counted(documents(awkward), limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in awkward]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert C.counted(documents(awkward).where("doc_id < 0")).collect() == []
