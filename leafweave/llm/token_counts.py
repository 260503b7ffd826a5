"""Token counts by compiled finite-state transducers.

Two machines are compiled from a byte-level BPE tokenizer file:

* a lexer, a deterministic automaton over character classes that marks where pre-tokens begin. A text's characters are
  cut into chunks; a chunk's map from the state before it to the state after it is worked out for all states at once,
  and the maps are composed by a parallel prefix scan, which gives every chunk its true first state;
* a transducer over the bytes of a pre-token. Its state is the node of an automaton of all tokens (the longest suffix
  that begins a token) with the last token at each of the places that suffix covers; its transitions carry the
  change in the number of tokens emitted. The last token of a prefix is the longest suffix token that the merges
  keep apart from the last token before it; which pairs they keep apart is compiled as pairs are met."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import blocks, bounded_batches, held

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
CHUNK = 512
#: Pre-tokens whose counts, and pairs of tokens whose verdicts, a worker keeps.
MOST_WORDS, PAIR_BITS = 300_000, 20

# Character classes; the letters of 's 't 're 've 'm 'll 'd have classes of their own.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, STMD, R, V, E, L, END = range(12)
# States: what the last characters are. B: of a run of white space a space is the last. Q: a quote that begins a
# pre-token. QR, QV, QL: after it r, v, l.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_B, S_Q, S_QR, S_QV, S_QL, S_WORD_END, S_BQ = range(12)
STATES, CLASSES = 12, 12
#: Marks of a transition: a pre-token begins here, one begins at the character before, or (R, V, L after a quote that
#: turned out to be no contraction) one begins at the character before besides.
HERE, BEFORE = 1, 2


def _lexer() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and mark[state, class]."""
    to, mark = np.zeros((STATES, CLASSES), np.int8), np.zeros((STATES, CLASSES), np.int8)
    letters = (LETTER, STMD, R, V, E, L)
    run = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER}
    for s in range(STATES):
        for c in range(CLASSES):
            kind = LETTER if c in letters else c
            if c == END:
                to[s, c], mark[s, c] = S_START, HERE
            elif c in (BLANK, SPACE):
                blank = s in (S_BLANK, S_B)
                to[s, c], mark[s, c] = (S_B if c == SPACE else S_BLANK), 0 if blank else HERE
            elif s == S_Q and c == STMD:
                to[s, c] = S_WORD_END
            elif s == S_Q and c in (R, V, L):
                to[s, c] = {R: S_QR, V: S_QV, L: S_QL}[c]
            elif (s, c) in ((S_QR, E), (S_QV, E), (S_QL, L)):
                to[s, c] = S_WORD_END
            elif s in (S_QR, S_QV, S_QL):  # no contraction: the quote stands alone, the letter after it begins a run
                if kind == LETTER:
                    to[s, c], mark[s, c] = S_LETTER, BEFORE
                else:
                    to[s, c], mark[s, c] = (S_Q if c == QUOTE else run[kind]), BEFORE | HERE
            elif s == S_Q:
                if kind in (OTHER, QUOTE):
                    to[s, c] = S_OTHER
                else:
                    to[s, c], mark[s, c] = run[kind], HERE
            elif s == S_B:  # the space belongs to what follows; before it the run of white space ends
                to[s, c], mark[s, c] = (S_OTHER if c == QUOTE else run[kind]), BEFORE
            elif c == QUOTE:
                to[s, c], mark[s, c] = (S_OTHER, 0) if s == S_OTHER else (S_Q, HERE)
            else:
                same = {S_LETTER: LETTER, S_NUMBER: NUMBER, S_OTHER: OTHER}.get(s) == kind
                to[s, c], mark[s, c] = run[kind], 0 if same else HERE
        if s in (S_QR, S_QV, S_QL):  # before white space and at the end too
            for c in (BLANK, SPACE, END):
                mark[s, c] |= BEFORE
    # A run of white space before a character that is none: its last character, if no space, is a pre-token of its own.
    for c in range(CLASSES):
        if c not in (BLANK, SPACE, END):
            mark[S_BLANK, c] |= BEFORE
    return to, mark


def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, everything):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1][out[ord(m[0][0]) : ord(m[0][-1]) + 1] == OTHER] = c
    out[0xD800:0xE000] = OTHER
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        for x in chars:
            out[ord(x)] = c
    return out


class Lexer:
    def __init__(self):
        self.classes = _classes()
        self.next, self.mark = _lexer()

    def chunk_maps(self, classes: np.ndarray) -> np.ndarray:
        """[chunk, state before] -> state after, of classes [chunk, place]."""
        state = np.tile(np.arange(STATES, dtype=np.int8), (len(classes), 1))
        flat = self.next.ravel()
        for c in classes.T:
            state = flat[state.astype(np.int16) * CLASSES + c[:, None]]
        return state

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """The map of all chunks up to each, in as many steps as the logarithm of their number."""
        maps, k = maps.copy(), 1
        while k < len(maps):
            maps[k:] = np.take_along_axis(maps[k:], maps[:-k].astype(np.int64), axis=1)
            k *= 2
        return maps

    def begins(self, points: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Places of `points` (code points, with any one at each of `ends`, after a text) at which pre-tokens begin or
        a text ends. Texts do not act on each other."""
        classes = self.classes[points]
        classes[ends] = END
        n = len(classes)
        whole = np.full(-(-n // chunk) * chunk, END, np.uint8)
        whole[:n] = classes
        whole = whole.reshape(-1, chunk)
        first = np.zeros(len(whole), np.int8)
        first[1:] = self.scan(self.chunk_maps(whole[:-1]))[:, S_START] if len(whole) > 1 else 0
        marks, state, to, mark = np.empty_like(whole), first, self.next.ravel(), self.mark.ravel()
        for i in range(chunk):
            at = state.astype(np.int16) * CLASSES + whole[:, i]
            marks[:, i], state = mark[at], to[at]
        marks = marks.ravel()[:n]
        here = (marks & HERE).astype(bool)
        here[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return np.flatnonzero(here)


class Transducer:
    """Numbers of tokens of pre-tokens. Tokens are numbered by their merges: 0 to 255 the bytes, then merge by merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        number = {c: b for c, b in byte.items()}
        left, right, spelled = [*range(256)], [*range(256)], [bytes([b]) for b in range(256)]
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            if a + b in number:  # made by an earlier merge already
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = len(left)
            left.append(number[a])
            right.append(number[b])
            spelled.append(spelled[left[-1]] + spelled[right[-1]])
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.size = np.array([len(x) for x in spelled], np.int32)
        merged = np.sort((self.left[256:].astype(np.int64) << 32 | self.right[256:]))
        order = np.argsort(self.left[256:].astype(np.int64) << 32 | self.right[256:])
        self.pairs, self.pair_token = merged, order.astype(np.int32) + 256
        self._automaton(spelled)
        self.known = np.full(1 << PAIR_BITS, -1, np.int64)
        self.apart = np.zeros(1 << PAIR_BITS, bool)

    def _automaton(self, spelled: list[bytes]) -> None:
        """Nodes are the beginnings of tokens; go[node, byte] is the longest suffix that is one. token[node]: the longest
        token that ends there; shorter[token]: the next one, a suffix of it."""
        nodes: dict[bytes, int] = {b"": 0}
        for x in sorted(spelled, key=len):
            for k in range(1, len(x) + 1):
                nodes.setdefault(x[:k], len(nodes))
        names = sorted(nodes, key=len)
        at = {x: i for i, x in enumerate(names)}
        own = {x: t for t, x in enumerate(spelled)}
        go = np.zeros((len(names), 256), np.int32)
        fail, token = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
        self.shorter = np.zeros(len(spelled), np.int32)
        children: list[list[tuple[int, int]]] = [[] for _ in names]
        for x, i in at.items():
            if x:
                children[at[x[:-1]]].append((x[-1], i))
        for i, x in enumerate(names):  # shorter names first, so a node's failure is complete before it
            go[i] = go[fail[i]] if i else 0
            below = token[fail[i]]
            token[i] = own.get(x, below)
            if x in own and len(x) > 1:
                self.shorter[own[x]] = below
            for b, child in children[i]:
                fail[child] = go[fail[i], b] if i else 0
                go[i, b] = child
        self.go, self.token = go, token

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a merge makes of each pair, or a number larger than any."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_token[at], np.iinfo(np.int32).max)

    def _compile(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave a and b apart. Both are taken apart again, the later merge first; a merge across
        that comes before the merges taken apart so far would have been made."""
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        most, alive = np.full(len(a), np.iinfo(np.int32).max, np.int64), np.arange(len(a))
        while len(alive):
            x, y = a[alive], b[alive]
            across = self._merge(x, y)
            bad = across < most[alive]
            out[alive[bad]] = False
            alive, x, y = alive[~bad], x[~bad], y[~bad]
            go_left, go_right = (x > y) & (x >= 256), (x <= y) & (y >= 256)
            i = alive[go_left]
            most[i] = a[i]
            a[i] = self.right[a[i]]
            i = alive[go_right]
            most[i] = b[i] + 1
            b[i] = self.left[b[i]]
            alive = alive[go_left | go_right]
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = ((key ^ (key >> 15)) * 0x9E3779B97F4A7C1 >> 7) & ((1 << PAIR_BITS) - 1)
        out = self.apart[slot]
        miss = np.flatnonzero(self.known[slot] != key)
        if len(miss):
            some, back = np.unique(key[miss], return_inverse=True)
            found = self._compile((some >> 32).astype(np.int32), (some & 0xFFFFFFFF).astype(np.int32))
            out[miss] = found[back]
            self.known[slot[miss]], self.apart[slot[miss]] = key[miss], found[back]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word; all words take a byte at a time together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size[order])])
        data = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        last, count = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        ahead, begin = size[order], begin[:-1]
        node = np.zeros(len(words), np.int32)
        for i in range(int(size.max(initial=0))):
            k = int(np.searchsorted(-ahead, -i, side="left"))  # words longer than i
            at = begin[:k] + i
            node[:k] = self.go[node[:k], data[at]]
            token = self.token[node[:k]]
            open_ = np.flatnonzero(self.size[token] <= i)
            while len(open_):
                t = token[open_]
                wrong = open_[~self.stay_apart(last[at[open_] - self.size[t]], t)]
                token[wrong] = self.shorter[token[wrong]]
                open_ = wrong
            last[at] = token
            before = at - self.size[token]
            count[at] = 1 + np.where(self.size[token] <= i, count[before], 0)
        out = np.zeros(len(words), np.int64)
        some = ahead > 0
        out[order[some]] = count[(begin + ahead - 1)[some]]
        return out


class Counter:
    """Numbers of tokens of texts, as the library for the file gives them; special strings in a text are a token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.lexer, self.transducer, self.words = Lexer(), Transducer(path), {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else lambda t: [t]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        parts = [self.cut(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), list(map(len, parts)))
        joined = "\0".join([p for x in parts for p in x]) + "\0"
        data = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for x in parts for p in x]) - 1
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width)])
        begins = self.lexer.begins(points, ends)
        text = np.searchsorted(ends, begins)
        real = points[begins] != 0
        if not real.all():  # a NUL may stand in a text
            real = ~np.isin(begins, ends)
        stop = np.append(begins[1:], len(points))
        text, low, high = text[real], place[begins[real]].tolist(), place[stop[real]].tolist()
        found = [data[a:b] for a, b in zip(low, high, strict=True)]
        needed = set(found)
        missing = needed - self.words.keys()
        if len(self.words) + len(missing) > MOST_WORDS:
            self.words, missing = {}, needed
        missing = list(missing)
        self.words.update(zip(missing, self.transducer.counts(missing).tolist(), strict=True))
        each = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        tokens = np.bincount(owner[text], each, len(texts)).astype(np.int64) + np.array(list(map(len, parts)), np.int64) - 1
        n_bytes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        return n_bytes, tokens


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit of each row, without a shuffle. Null texts count as empty: 0 tokens.
    Repeated rows count each; empty tables give no rows; other columns are not read. A worker compiles the machines
    once and holds them (about 150 MB) for its later tasks."""
    path = path or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("tokens", path), lambda: Counter(path))
        for b in batches:
            for first, texts in blocks(b.column(1), 2 << 20):
                n_bytes, tokens = counter(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return bounded_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
