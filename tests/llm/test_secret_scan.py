import hashlib
import math
import random
import re
import time

from leafweave.llm import secret_scan as S


def brute(text):
    text, base = text or "", []
    for rank, (kind, p, group, least) in enumerate((("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        base += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, text) if len(m[group]) >= least]
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        if any(a < m.end() and m.start() < b for a, _, _, b in base) or any(re.search(p, m[0]) for p in S.ALLOWED):
            continue
        for _, p, w, bits in S.CLASSES:
            if re.search(p, m[0]):
                windows = [m[0][i : i + w] for i in range(len(m[0]) - w + 1)]
                if max(-sum(x.count(c) / w * math.log2(x.count(c) / w) for c in set(x)) for x in windows) >= bits - 1e-9:
                    more.append((m.start(), 3, "entropy", m.end()))
                break
    return sorted(base + more)


def test_against_brute_force(documents, awkward):
    r = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = list(awkward)
    bits = ["password: ", 'API_KEY = "', "token=token: ", "secret=ab ", "passwd='", "AKIA", "AKIAAKIA", "ü\U0001f600", "deadbeef", "\n", " ", "Key", "ſecret=abcdefgh "]
    for i in range(300):
        parts = [r.choice([r.choice(bits), "".join(r.choices(alphabet, k=r.randrange(30))), "".join(r.choices("0123456789abcdef", k=r.randrange(40))), "".join(r.choices("ABCDEF0123456789", k=r.randrange(40)))]) for _ in range(r.randrange(1, 12))]
        rows.append((100 + i, "".join(parts)))
    rows.append((900, "x 8f14e45f-ceea-467f-9b36-34d2b8f8e9aa aVeryRandom/" + "".join(r.choices(alphabet, k=60)) + " EXAMPLE"))
    got = S.scan(documents(rows)).select("doc_id", S.listed("spans").alias("all"), S.listed("spans", True).alias("base")).collect()
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    want = [(i, show(brute(t)), show(x for x in brute(t) if x[1] < 3)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum("entropy" in a for _, a, _ in want) > 20 and sum("access" in a for _, a, _ in want) > 5
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c4")


def test_empty_table(documents):
    assert S.scan(documents([(1, "x")]).where("doc_id < 0")).collect() == []


def test_very_long_strings_and_many_of_them(documents):
    r = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWYZabcdefghijklmnopqrstuvwyz09"  # none of the allowed runs
    run = "".join(r.choices(alphabet, k=1_000_000)) + "1a"
    many = " ".join("".join(r.choices(alphabet, k=22)) + f" token=abcdefg{i % 10}" for i in range(4000))
    rows = [(1, run), (2, many), (3, "/ab" * 100_000), (4, "ab-" * 50_000 + "cd"), (5, "z" * 200_000 + "1"), (6, "deadbeef" * 40_000), (7, "x" + "0123456789abcdefghijklmn" * 20_000)]
    began = time.time()
    got = {x.doc_id: x.spans for x in S.scan(documents(rows)).collect()}
    assert time.time() - began < 120
    assert [(x.kind, x.start, x.end) for x in got[1]] == [("entropy", 0, 1_000_002)]
    assert [(x.start, x.rank, x.kind, x.end) for x in got[2]] == brute(many)
    assert not got[3] and not got[4] and not got[5] and [(x.kind, x.end) for x in got[6]] == [("hex", 320_000)]
