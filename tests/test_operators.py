"""Operators on small tables whose answers are worked out by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import annotations, blocks, chapters, evaluate, footnotes, headers, html, layout, profile, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize("text, want", [(None, []), ("", []), ("Hello world", ["Hello", "world"]), ("Hello world\nSecond line", ["Hello", "world", "\n", "⟩Second", "line"]), ("First\n\n\nSecond", ["First", "\n", "⟩Second"])])
def test_tokens(spark, text, want):
    c = F.lit(text).cast("string")
    assert one(spark, T.tokens(c)) == want and one(spark, T.token_count(c)) == len(want)


def test_scalars(spark):
    assert round(one(spark, T.dice(F.lit("ALICE IN WONDERLAND"), F.lit("ALiLn iin WONDERLAND"))), 4) == 0.8108
    for a, b, want in (("A b", "a  B", 1.0), ("", "x", 0.8), ("a b c", "b", 0.8), ("a b", "b c", 1 / 3)):
        assert one(spark, T.title_match(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert [one(spark, T.roman_to_int(F.lit(x))) for x in ("XIV", "ix", "MD")] == [14, 9, 0]
    assert [one(spark, T.trailing_page(F.lit(x))) for x in ("TITLE ... 42", "TITLE I28", "TITLE")] == [42, 128, None]
    assert one(spark, T.header_text(F.lit("4 2 The Janus faces 17"))) == "The Janus faces"
    assert one(spark, T.strip_html(F.lit("<p>a &amp;lt; b&#233;&nbsp;</p>"))) == "a &lt; bé"
    assert one(spark, T.without_title(F.lit("Chapter One:  the start of it"), F.lit("chapter one"))) == "the start of it"
    assert one(spark, T.without_title(F.lit("Another start"), F.lit("chapter one"))) == "Another start"


def lines(spark, rows, w=612.0, h=792.0):
    full = [("b", 0, i, t, float(y), float(x), float(x + width), float(width), float(font), w, h) for i, (t, y, x, width, font) in enumerate(rows)]
    return spark.createDataFrame(full, "book string, page int, line_no int, text string, y double, min_x double, max_x double, width double, font_size double, page_w double, page_h double")


def test_paragraphs_and_hyphens(spark):
    rows = [("This is the first line of a para-", 72, 72, 460, 10), ("graph that goes on and", 86, 72, 460, 10), ("ends here.", 100, 72, 100, 10), ("Another begins after it and is", 114, 72, 460, 10), ("long.", 160, 72, 460, 10)]
    got = layout.paragraphs(lines(spark, rows).withColumn("col", F.lit(0))).orderBy("par").collect()
    assert [r.text for r in got] == ["This is the first line of a paragraph that goes on and ends here.", "Another begins after it and is", "long."]


def test_same_height_and_superscripts(spark):
    rows = [("He said", 72, 72, 50, 10), ("this.", 73, 124, 30, 10), ("far", 72.5, 400, 20, 10), ("A line that is long enough", 100, 72, 400, 10), ("12", 96, 460, 6, 5)]
    got = layout.same_height_joined(layout.superscripts_joined(lines(spark, rows))).orderBy("y", "min_x").collect()
    assert [r.text for r in got] == ["He saidthis.", "far", "A line that is long enough!12"]


def test_footnotes(spark):
    rows = [(f"Body line number {i} is here", 72 + 14 * i, 72, 400, 10) for i in range(8)] + [("from the page before", 200, 72, 300, 8), ("1. First note is long-", 212, 72, 300, 8), ("er than a line", 224, 72, 300, 8), ("2 Second note", 236, 72, 300, 8), ("42", 250, 300, 10, 10)]
    body, notes = footnotes.separated(lines(spark, rows).withColumn("col", F.lit(0)))
    assert body.count() == 8
    n = notes.head()
    assert [tuple(f) for f in n.footnotes] == [(1, "First note is longer than a line"), (2, "Second note")] and n.continuation == "from the page before"


def test_profile(spark):
    rows = [("A line of text", 72 + 14 * i, 72, 400, 10) for i in range(30)]
    pages = spark.createDataFrame([("b", 0, 612.0, 792.0, False)], "book string, page int, page_w double, page_h double, has_images boolean")
    got = profile.profiles(lines(spark, rows), pages).head()
    assert got.book_type == "scannedOCR" and got.content_type == "general" and got.global_font == 10.0  # one page: integer division


def test_headers(spark):
    pages = [("b", i, f"{'THE BOOK OF KELLS' if i % 3 else 'THE B0OK OF KELLS'} {i}\n\nBody of page {i} goes on.") for i in range(12)]
    df = spark.createDataFrame(pages, "book string, page_idx int, text string")
    found = headers.running_headers(df)
    assert [r.header for r in found.collect()] == ["THE BOOK OF KELLS"]
    assert {r.text for r in headers.stripped(df, found).collect()} == {f"Body of page {i} goes on." for i in range(12)}


def test_contents(spark):
    text = "Contents\n1 The beginning 3\n2 The middle of\nthe long book 10\n3 The end 20"
    pages = [("b", 0, text), *(("b", i, {4: "The beginning\nIt began.", 11: "The middle of the long book\nOn it goes.", 22: "The end\nIt ends.", 25: "INDEX\n\nA, 1"}.get(i, "text")) for i in range(1, 27))]
    df = spark.createDataFrame([(b, i, i, t) for b, i, t in pages], "book string, page_idx int, pdf_page int, text string")
    outline = spark.createDataFrame([], "book string, seq int, title string, pdf_page int")
    got = structure.chapter_starts(df, outline).orderBy("page").collect()
    assert [(r.title, r.page) for r in got] == [("Front Matter", 0), ("1 The beginning", 4), ("2 The middle of the long book", 11), ("3 The end", 22), ("INDEX", 25)]
    starts = structure.chapter_starts(df, outline)
    made = chapters.built(df.withColumn("footnotes", F.expr("cast(array() AS array<struct<number: int, text: string>>)")).withColumn("continuation", F.lit(None).cast("string")), starts).orderBy("start_page").collect()
    assert [(r.title, r.start_page, r.is_back_matter) for r in made][1:] == [("The beginning", 5, False), ("The middle of the long book", 12, False), ("The end", 23, False), ("INDEX", 26, True)]
    books = {
        "a": ["CHAPTER IV.", "LEADERS,", "AND MEN. 15-39", "Synopsis", "CHAPTER V.", "WORK."],
        "b": ["1 First Things 7", "and more 8", "x", "not this", "2 Second .... I2", "0 Nought here", "INDEX 90"],
        "c": ["Some words", "I. BEGINNINGS ... 3", "II. MIDDLES", "17", "III. ENDINGS", "and so on 44", "IV. AB", "nothing here"],
        "d": ["CHAPTER ONE", "The Rise –", "ab", "and Fall 3-9", "CHAPTER", "Chapter two.", "\u201cWhat Now?\u201d 12"],
        "e": [],
    }
    rows = [(b, 10 * k, x) for b, ls in books.items() for k, x in enumerate(ls)]
    got = structure.parsed_contents(spark.createDataFrame(rows, "book string, seq long, line string")).orderBy("book", "seq").collect()
    told = lambda b: [(x.num, x.title, x.page_num) for x in got if x.book == b]
    assert told("a") == [(4, "LEADERS, AND MEN", None), (5, "WORK", None)]
    assert told("b") == [(1, "First Things and more", 7), (2, "Second .... I2", 12)]
    assert told("c") == [(1, "BEGINNINGS", 3), (2, "MIDDLES", 17), (3, "ENDINGS", 44)]
    assert told("d") == [(1, "The Rise – and Fall", None), (2, "What Now", None)] and [x.seq for x in got if x.book == "d"] == [0, 1]


def test_boundaries_and_titles(spark):
    of = lambda pages: spark.createDataFrame([("b", p, t) for p, t in pages], "book string, start_page int, title string")
    p, n = of([(1, "One"), (2, "Two"), (3, "x")]), of([(2, "two")])
    assert evaluate.chapter_boundaries(p, n, clamp=False).head().score == 1.5 and evaluate.chapter_boundaries(p, n).head().score == 1.0
    assert evaluate.chapter_titles(p, n).head().score == pytest.approx(1 / 3)


def test_overall_of_known_scores(spark):
    scores = dict(zip(evaluate.WEIGHTS, (0.9697, 0.9187, 1.0, 1.0, 0.9948, 1.0, 1.0, 0.9986), strict=True))
    df = spark.createDataFrame([("b", k, v) for k, v in scores.items()], "book string, dimension string, score double")
    assert evaluate.overall(evaluate.weighted(df)).head().overall == pytest.approx(0.9831, abs=1e-3)
    gated = evaluate.gate(df.withColumn("score", F.col("score") - F.when(F.col("dimension") == "ocr_quality", 0.021).otherwise(0.0)), df)
    assert [r.dimension for r in gated.where("status = 'regression'").collect()] == ["ocr_quality"]


@pytest.mark.parametrize("text, want", [('```json\n{"a": 1}\n```', {"a": 1}), ('{"n": [1, †, x]}', {"n": [1, "†", "x"]}), ('{"a": [{"b": 1}, {"c": "cut o', {"a": [{"b": 1}, {}]}), ("nonsense", None), (None, None), ('{"a": 1, "b": "cut o', {"a": 1}), ('{"a": 1, "b":', {"a": 1}), ('{"a": ["x", "y', {"a": ["x"]}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": [-1.5, true, "q", b\\c]}', {"a": [-1.5, True, "q", "b\\c"]}), ('{"a": NaN}', None)])
def test_json_repair(text, want):
    got = annotations.repaired_json(text)
    assert (json.loads(got) if got else None) == want


def test_roll_up(spark):
    rows = [
        {"book": "b", "page": 1, "isChapterStart": True, "chapterTitle": "One", "regions": [{"type": "running_header", "readingOrder": 0, "text": "H"}, {"type": "body", "readingOrder": 2, "text": "Second.\n\nThird."}, {"type": "heading", "readingOrder": 1, "text": " One "}, {"type": "footnote", "readingOrder": 3, "text": "7 A note"}]},
        {"book": "b", "page": 2, "isBackMatter": True, "backMatterType": "index", "regions": [{"type": "body", "readingOrder": 1, "text": "Fourth."}, {"type": "footnote", "readingOrder": 2, "text": "no number"}], "footnoteReferences": [{"number": "7"}]},
    ]
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", "book string, page int, " + annotations.SCHEMA).alias("r")).select("r.*")
    got = annotations.rolled_up(df).head()
    assert (got.title, got.paragraphs, got.ws_word_count, got.is_back_matter, got.back_matter_type) == ("One", ["One", "Second.", "Third.", "Fourth."], 4, True, "index")
    assert [tuple(f) for f in got.footnotes] == [(7, "A note".join(["7 ", ""])), (2, "no number")] and got.footnote_references[0].pageNumber == 2


def test_blocks(spark):
    tree = {"book": "b", "children": [
        {"children": [{"block_type": "SectionHeader", "html": "<h1>CHAPTER 1</h1>"}, {"block_type": "SectionHeader", "html": "<h1>THE START</h1>"}, {"block_type": "Text", "html": "<p>Hello &amp; you.</p>"}]},
        {"children": [{"block_type": "PageHeader", "html": "<p>head</p>"}, {"block_type": "Text", "html": "<p>25. Author Name, A Long Title of a Book, Place, 1991, pages 3 to 9.</p>"}]},
        {"children": [{"block_type": "SectionHeader", "html": "<h2>Index</h2>"}, {"block_type": "ListGroup", "children": [{"text": "a, 1"}, {"text": "b, 2"}]}]},
    ]}
    df = spark.createDataFrame([json.dumps(tree)], "string").select(F.from_json("value", "book string, " + blocks.SCHEMA).alias("r")).select("r.*")
    got = blocks.converted(blocks.flattened(df)).orderBy("start_page").collect()
    assert [(r.title, r.start_page, r.is_back_matter) for r in got] == [("CHAPTER 1 THE START", 1, False), ("Index", 3, True)]
    assert got[0].plain_text.startswith("Hello & you.\n\n———\n\n25. Author") and got[1].plain_text == "a, 1 b, 2" and 'id="fn-25"' in got[0].html


def test_html_links(spark):
    notes = "\n\n".join(f"{i} Note {i}." for i in range(1, 7))
    rows = [("b", 1, f"A claim.1 And <more>.2 But 1999 stays.\n\n{notes}"), ("b", 2, f"One.^ Two.^ Three.^ Four.\n\nFive.^\n\n{notes}"), ("b", 3, "Only text.")]
    got = {r.chapter: r.html for r in html.rendered(spark.createDataFrame(rows, "book string, chapter long, text string")).collect()}
    assert got[1].startswith('<p>A claim.<sup><a href="#endnote-1" data-note-link="1">1</a></sup> And &lt;more&gt;.<sup><a href="#endnote-2"') and "But 1999 stays" in got[1]
    assert got[1].count("<p id=") == 6 and got[2].count("data-note-link") == 4 and '#endnote-4" data-note-link="1">4</a></sup></p>' in got[2]
    assert got[3] == "<p>Only text.</p>"


def ocr_brute(t, aggressive=False):
    for split in ("o f", "i n", "i t", "o n", "i s", "a t", "a s", "b e", "b y", "t o", "o r", "a n"):
        for a, b in ((r"(\w{2,})", r"(\w{2,})"), (r"(\w{3,})", r"(\w)"), (r"(\w)", r"(\w{3,})")):
            t = re.sub(f"{a} {split} {b}", rf"\1 {split.replace(' ', '')} \2", t)
    for split in "micro scopic|strat egy|philos ophy|philos opher|knowl edge|al chemy|al chemical|al chemist|ex periment|ex perimental|in terpret|inter pretation|mech anical|mech anism|math ematical|math ematics|dem onstration|cor respondence|phenom ena|grav itation".split("|"):
        t = re.sub(split, split.replace(" ", ""), t, flags=re.I)
    if not aggressive:
        return t
    t = re.sub(r"(?:^|\s)[^\w\s]{1,4}(?=\s|$)", " ", t, flags=re.M)
    t = re.sub(r"(?:^|\s)[^\w\s]{1,3}(\w{3,})", r" \1", t, flags=re.M)
    t = re.sub(r"(\w{2,})[^\w\s]{1,3}(?=\s|$)", r"\1", t)
    t = re.sub(" {2,}", " ", t.replace("'11 ", "'ll ").replace("'11\n", "'ll\n"))
    out = []
    for p in (x.strip() for x in t.split("\n\n")):
        plain = sum(c.isalnum() or c.isspace() for c in p)
        if p and not (len(p) <= 3 and not any(c.isalnum() for c in p)) and not (len(p) < 100 and plain < len(p) // 2):
            out.append(p)
    return "\n\n".join(out)


def test_ocr_cleaning(spark):
    r = random.Random(5)
    parts = ["o f", "i n", "t o", "a", "ab", "abc", "o", "f", "été", "Philos Ophy", "al chemist", "ofthe", "(^", "&", "<$past", "cenJ*", "it'11", "x.", "word,", "====", "~~~~~", "\n", "\n\n"]
    texts = ["composed o f several", "direction o f a Com", "a o f b", "ab o f cd o f ef", "abc o f def o f ghi", "x" * 3000 + " o f abc o f d", "ofthe", "%&\n\nKept text\n\n$%^&*ab", "", *("".join(x + r.choice([" ", " ", " ", "  "]) for x in r.choices(parts, k=r.randrange(1, 25))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for aggressive in (False, True):
        got = {x.t: x.c for x in df.select("t", layout.ocr_cleaned(F.col("t"), aggressive).alias("c")).collect()}
        assert got == {t: ocr_brute(t, aggressive) for t in texts}


def test_logical_pages_are_cleaned(spark):
    rows = [("The world is composed o f several parts, as", 72, 72, 460, 10), ("the Philos ophy o f nature says & it'11 be so.", 86, 72, 460, 10)]
    page, single = lines(spark, rows), lines(spark, [("Only one line o f text", 72, 72, 200, 10)]).withColumn("page", F.lit(1))
    both = page.unionByName(single)
    assert [x.text for x in layout.logical_pages(both).orderBy("page").collect()] == ["The world is composed of several parts, as the philosophy of nature says & it'11 be so.", "Only one line o f text"]
    scan = spark.createDataFrame([("b", "scannedOCR", False, 10.0)], "book string, book_type string, prefer_content boolean, global_font double")
    assert [x.text for x in layout.logical_pages(page, scan).collect()] == ["The world is composed of several parts as the philosophy of nature says it'll be so"]


def test_whole_page_chunks(spark, tmp_path):
    from hashlib import md5

    from leafweave.plans import registry

    texts = [(i, f"text {i} " * (i % 7) * 9, f"s{i % 2 if i < 46 else 2}") for i in range(49)]
    spark.createDataFrame([(i, t or None, s, "en") for i, t, s in texts], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.book, x.chunk): (x.title, x.first_page, x.last_page, x.chars, x.digest) for x in registry.queries()["page_chunks"](spark, str(tmp_path)).collect()}
    want = {}
    for book in ("s0", "s1", "s2"):
        pages = [t for _, t, s in texts if s == book]
        size = -(-len(pages) // max(1, len(pages) // 10))
        for k in range(0, len(pages), size):
            part = pages[k : k + size]
            title = book if len(pages) <= size else f"Page {k + 1}" if len(pages) <= 20 else f"Pages {k + 1}-{k + len(part)}"
            want[book, k // size] = (title, k + 1, k + len(part), len("\n".join(part)), md5("\n".join(md5(t.encode()).hexdigest() for t in part).encode()).hexdigest())
    assert got == want


def test_dice_of_all_whole_texts(spark, tmp_path):
    from collections import Counter

    from leafweave.plans import registry

    r = random.Random(7)
    texts = {i: "".join(r.choices("abC é", k=r.choice([0, 1, 1, 2, 5, 60, 200]))) for i in range(30)} | {40: "x" * 50 + "tail", 90: "X" * 50 + "TAIL", 91: "x" * 50 + "end", 92: None}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def brute(a, b):
        if a is None or b is None:
            return None
        a, b = a.lower(), b.lower()
        x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) if len(t) > 1 else Counter([t]) for t in (a, b))
        return 1.0 if a == b else 2 * (x & y).total() / (x.total() + y.total())

    got = {(x.one, x.two): x.dice for x in registry.queries()["dice_similarity"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): pytest.approx(brute(texts[i], texts[j]), abs=1e-6) if texts[i] is not None and texts[j] is not None else None for i in texts for j in texts if i < j}
    assert got[40, 90] == 1.0 and got[40, 91] < 1.0


def test_line_queries_read_short_texts(spark, tmp_path):
    from leafweave.plans import registry, views

    texts = [(0, "one line alone"), (1, "12\nBody of two lines"), (2, "4\nFirst line of it\nSecond line of it\n5"), (3, "\n".join(f"Line {i} of seven" for i in range(7))), (4, "\n".join(f"Line {i} of nine" for i in range(9))), (5, " \n ")]
    spark.createDataFrame([(i, t, "s", "en") for i, t in texts], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    q = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    seen = views.lines(spark, str(tmp_path)).groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("font_size") < 10).alias("notes")).collect()
    assert {x.page: (x.n, x.notes) for x in seen} == {0: (1, 0), 1: (2, 0), 2: (4, 0), 3: (7, 0), 4: (9, 3)}
    for name in ("font_mode_median", "paragraphs_from_lines", "superscript_merge", "footnotes_split", "logical_pages"):
        assert {x.page for x in q(name)} == {0, 1, 2, 3, 4}, name
    assert {x.chapter for x in q("rendered_html")} == {0, 1, 2, 3, 4}
    assert {x.page for x in q("column_split")} == {0, 1, 2, 3, 4, -1, -2, -3, -4, -5}
    assert {x.page for x in q("footnotes_parsed")} == {4} and {x.page for x in q("footnotes_split") if x.start is not None} == {4}
    stripped = {x.page: (x.first, x.last, x.lines) for x in q("page_numbers_stripped")}
    assert stripped[0] == (0, 0, 1) and stripped[1] == (0, 1, 2) and stripped[2] == (1, 3, 3) and stripped[3] == (2, 4, 3)


def test_entry_without_llm(spark):
    import __spark_entry__

    assert "word_boundaries" in __spark_entry__.queries() and "word_boundaries" in __spark_entry__.oracle_sql()


def test_running_sums_by_ranges(spark):
    import random

    from leafweave.operators.ranges import running

    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "book string, page int, n int").repartition(7)
    got = {(x.book, x.page): (x.words, x.place) for x in running(df, ["book"], ["page"], words=F.col("n"), place=F.lit(1)).collect()}
    want, seen = {}, {}
    for b, p, n in sorted(rows, key=lambda x: x[1]):
        words, place = seen.get(b, (0, 0))
        want[b, p], seen[b] = (words, place), (words + n, place + 1)
    assert got == want
    assert running(df.where("page < 0"), ["book"], ["page"], words=F.col("n")).collect() == []


def test_writers_and_cache(spark, tmp_path):
    from leafweave.sources import tables

    c = spark.createDataFrame([("a", 1, "Two", "second text", 2), ("a", 0, "One", "first", 1), ("b", 0, "Only", "x y z", 3)], "book string, chapter_idx int, title string, plain_text string, ws_word_count long")
    assert {x.book: x.line for x in tables.summary(c).collect()} == {"a": "Extracted 2 chapters, 3 words", "b": "Extracted 1 chapters, 3 words"}
    tables.write_text(c, f"{tmp_path}/text")
    text = spark.read.text(f"{tmp_path}/text/book=a", wholetext=True).head()[0]
    assert text.index("One") < text.index("first") < text.index("Two") < text.index("second text")
    tables.write_rows(c, f"{tmp_path}/rows")
    assert sorted(x.title for x in spark.read.json(f"{tmp_path}/rows").collect()) == ["One", "Only", "Two"]
    tables.write_structure(c, f"{tmp_path}/structure")
    one = spark.read.json(f"{tmp_path}/structure/book=a").head()
    assert [x.title for x in one.chapters] == ["One", "Two"]
    note = lambda k, n: spark.createDataFrame([(k, n)], "key string, n int").selectExpr("key", "named_struct('pageNumber', n, 'layout', 'single_column') AS annotation")
    for k, n in (("k", 1), ("l", 2), ("k", 3)):
        tables.cache_append(note(k, n), f"{tmp_path}/cache")
    assert {x.key: x.annotation.pageNumber for x in tables.cache_read(spark, f"{tmp_path}/cache").collect()} == {"k": 3, "l": 2}
    found = spark.createDataFrame([("a", "MEDIUM")], "book string, severity string")
    assert not tables.any_high(found) and tables.any_high(found.union(spark.createDataFrame([("b", "HIGH")], found.schema)))


def test_readers(spark, tmp_path):
    import json

    from leafweave.sources import tables

    for book, n in (("x", 0.5), ("y", 1.0)):
        (tmp_path / book).mkdir()
        (tmp_path / book / "baseline.json").write_text(json.dumps({"book": book, "locked": "2026-01-01", "overall": n, "dimensions": {"ocr_quality": n / 2}}, indent=2))
    (tmp_path / "x" / "native.json").write_text("{}")
    got = {(r.book, r.dimension): r.score for r in tables.baselines(spark, f"{tmp_path}/*/baseline.json").collect()}
    assert got == {("x", "overall"): 0.5, ("x", "ocr_quality"): 0.25, ("y", "overall"): 1.0, ("y", "ocr_quality"): 0.5}
    assert {(f.book, f.length) for f in tables.files(spark, str(tmp_path), "native.json").collect()} == {("x", 2)}
    assert [b.book for b in tables.corpus(spark, str(tmp_path), ("native.json", "baseline.json")).collect()] == ["x"]
    assert sorted(p.page for p in tables.page_range("3-5,9, 4", spark).collect()) == [3, 4, 5, 9]
    (tmp_path / "trees" / "z").mkdir(parents=True)
    (tmp_path / "trees" / "z" / "t.json").write_text(json.dumps({"children": [{"block_type": "Page", "children": [{"block_type": "Text", "html": "<p>a</p>"}]}]}))
    tree = tables.block_trees(spark, f"{tmp_path}/trees/*/t.json").head()
    assert tree.book == "z" and tree.children[0].children[0].html == "<p>a</p>"
    (tmp_path / "notes.jsonl").write_text(json.dumps({"book": "x", "pageNumber": 3, "layout": "two_column"}) + "\n")
    assert [(a.book, a.pageNumber, a.regions) for a in tables.page_annotations(spark, f"{tmp_path}/notes.jsonl").collect()] == [("x", 3, None)]
