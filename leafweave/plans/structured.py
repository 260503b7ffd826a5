"""Queries of books: contents pages, chapters, notes, images, html and block trees, each with its SQL twin beside it.

Conversations are books and their turns pages. What the operators look for (contents pages, notes, marks, trees) is made
from the turns, so that the twins can say what has to be found."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import annotations, blocks, chapters, evaluate, footnotes, headers, html, layout, profile, structure
from leafweave.plans.sql import CHAPTERS, LINE_VIEW, TOKENS, WORDS, WS
from leafweave.plans.views import chapters as chapters_of
from leafweave.plans.views import lines as lines_of
from leafweave.plans.views import turns as turns_of
from leafweave.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Turns with a text, the numbers of their users' turns, and whether they have several lines.
TALK = """talk AS (SELECT CAST(conv_id AS VARCHAR) AS book, CAST(turn AS INT) AS page, role = 'user' AS is_start, text, split_part(text, chr(10), 1) AS line, contains(text, chr(10)) AS several,
  count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE text IS NOT NULL)"""


def query(sql: str):
    def take(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


def digest(text: str):
    return F.md5(F.col(text).cast("binary"))


def talk(spark: SparkSession, d: str) -> DataFrame:
    """TALK, without the numbers."""
    return turns_of(spark, d).where("text IS NOT NULL").select("book", "page", "is_start", "text", F.col("title").alias("line"), F.contains("text", F.lit("\n")).alias("several"))


@query("""WITH o AS (SELECT source AS book, doc_id AS seq, coalesce(nullif(split_part(text, chr(10), 1), ''), 'Untitled') AS title, coalesce(n_chars % 50, 0) AS leaf FROM documents)
SELECT book, min(seq) AS seq, arg_min(title, seq) AS title, min(seq) AS page FROM o GROUP BY book, leaf""")
def outline_starts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items of outlines, their lengths by 50 as PDF pages."""
    o = tables.read(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("seq"), F.nullif(F.substring_index("text", "\n", 1), F.lit("")).alias("title"), (F.col("n_chars") % 50).alias("pdf_page"))
    return structure.outline_starts(o, o.select("book", F.col("seq").alias("page_idx"), F.coalesce("pdf_page", F.lit(0)).alias("pdf_page")))


def contents_book(spark: SparkSession, d: str) -> DataFrame:
    """Books whose page 0 lists their users' turns, and whose other pages are the turns, users' ones under their titles."""
    t = talk(spark, d).withColumn("title", F.concat(F.lit("The part of turn "), F.col("page"), F.lit(" and more")))
    listed = F.expr("transform(array_sort(collect_list(CASE WHEN is_start THEN struct(page, title) END)), (x, i) -> concat(i % 99 + 1, ' ', x.title, ' ', x.page + 1))")
    first = t.groupBy("book").agg(F.concat(F.lit("Contents\n\n"), F.array_join(listed, "\n")).alias("text")).select("book", F.lit(0).alias("page_idx"), "text")
    rest = t.select("book", (F.col("page") + 1).alias("page_idx"), F.when(F.col("is_start"), F.concat("title", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))
    return first.union(rest)


USERS = f"{TALK}, u AS (SELECT book, page, nth, CAST((nth - 1) % 99 + 1 AS INT) AS num, 'The part of turn ' || page || ' and more' AS title, min(page) OVER (PARTITION BY book) AS low, max(page) OVER (PARTITION BY book) AS high, count(*) OVER (PARTITION BY book) AS n FROM talk WHERE is_start)"


@query(f"WITH {USERS} SELECT book, CAST(nth - 1 AS INT) AS seq, num, title, page + 1 AS page_num FROM u WHERE n >= 2")
def contents_entries(spark: SparkSession, d: str) -> DataFrame:
    return structure.parsed_contents(structure.contents_lines(contents_book(spark, d)))


@query(f"""WITH {USERS} SELECT book, CAST(nth - 1 AS INT) AS seq, num || ' ' || title AS title, page + 1 AS page FROM u WHERE n >= 2
UNION ALL SELECT DISTINCT book, -1, 'Front Matter', 0 FROM u WHERE n >= 2 AND low > 0""")
def contents_placed(spark: SparkSession, d: str) -> DataFrame:
    pages = contents_book(spark, d)
    placed = structure.placed_contents(structure.parsed_contents(structure.contents_lines(pages)), pages)
    return structure.with_front_matter(tables.settled(placed), pages).select("book", "seq", "title", "page")


@query(f"""WITH {USERS}, p AS (SELECT book, max(page) + 2 AS last_ FROM talk GROUP BY book)
SELECT book, CAST(nth - 1 AS INT) AS seq, num || ' ' || title AS title, page + 1 AS page, false AS is_back FROM u WHERE n >= 2
UNION ALL SELECT DISTINCT book, -1, 'Front Matter', 0, false FROM u WHERE n >= 2 AND low > 0
UNION ALL SELECT DISTINCT u.book, 1000000, 'Index of names', last_, true FROM u JOIN p ON p.book = u.book WHERE n >= 2 AND last_ - (high + 1) >= least(4, (last_ - high) // 3)""")
def chapter_starts(spark: SparkSession, d: str) -> DataFrame:
    """The same with an index as the last page of each book."""
    pages = contents_book(spark, d)
    last = pages.groupBy("book").agg((F.max("page_idx") + 1).alias("page_idx")).select("book", "page_idx", F.lit("Index of names\n\nAnn, 12").alias("text"))
    pages = pages.unionByName(last).withColumn("pdf_page", F.col("page_idx"))
    none = spark.createDataFrame([], "book string, seq int, title string, pdf_page int")
    return structure.chapter_starts(pages, none).select("book", "seq", "title", "page", "is_back")


def start_rows(t: DataFrame) -> DataFrame:
    return t.where("is_start").select("book", F.col("page").alias("seq"), F.concat(F.lit("7 Part "), F.col("page")).alias("title"), "page", F.col("several").alias("is_back"))


ASSIGNED = f"""{TALK}, a AS (SELECT *, last_value(CASE WHEN is_start THEN page END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page) AS first_, last_value(CASE WHEN is_start THEN several END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page) AS back FROM talk)"""


@query(f"""WITH {ASSIGNED} SELECT book, page AS page_idx, CAST(coalesce(nth - 1, -1) AS INT) AS chapter_idx, CASE WHEN first_ IS NULL THEN 'Front Matter' ELSE 'Part ' || first_ END AS title, coalesce(back, false) AS is_back_matter, coalesce(first_, 0) AS first FROM a""")
def chapters_assigned(spark: SparkSession, d: str) -> DataFrame:
    t = talk(spark, d)
    return chapters.assigned(t.select("book", F.col("page").alias("page_idx")), start_rows(t))


@query(f"""WITH {ASSIGNED}, c AS (SELECT book, nth, first_, any_value(back) AS back, string_agg(text, chr(10) ORDER BY page) AS body, min(page) + 1 AS start_page, arg_min(line, page) AS line, string_agg(line, ' ' ORDER BY page) FILTER (NOT is_start) AS more,
  arg_min(length(text), page) AS chars FROM a GROUP BY book, nth, first_),
n AS (SELECT *, first_ IS NOT NULL AS noted, chars || CASE WHEN more IS NULL THEN '' ELSE ' ' || more END AS two FROM c), t AS (SELECT *, CASE WHEN noted THEN body || chr(10) || chr(10) || '1 ' || line || chr(10) || chr(10) || '2 ' || two ELSE body END AS text FROM n WHERE noted OR trim(body) <> '')
SELECT book, CAST(CASE WHEN noted THEN nth - 1 ELSE -1 END AS INT) AS chapter_idx, CASE WHEN noted THEN 'Part ' || first_ ELSE 'Front Matter' END AS title, start_page, md5(text) AS text, CAST(CASE WHEN noted THEN 2 ELSE 0 END AS INT) AS notes, coalesce(back, false) AS is_back_matter,
  {TOKENS} AS word_count, CAST({WORDS} AS BIGINT) AS ws_word_count FROM t""")
def chapters_built(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns have two notes, and what follows goes on with the second."""
    t = talk(spark, d)
    notes = F.when(F.col("is_start"), F.array(F.struct(F.lit(1).alias("number"), F.col("line").alias("text")), F.struct(F.lit(2).alias("number"), F.length("text").cast("string").alias("text")))).otherwise(F.array().cast("array<struct<number: int, text: string>>"))
    pages = t.select("book", F.col("page").alias("page_idx"), F.col("page").alias("pdf_page"), "text", notes.alias("footnotes"), F.when(~F.col("is_start"), F.col("line")).alias("continuation"))
    out = chapters.built(pages, start_rows(t))
    return out.select("book", "chapter_idx", "title", "start_page", digest("plain_text").alias("text"), F.coalesce(F.size("footnotes"), F.lit(0)).alias("notes"), "is_back_matter", "word_count", "ws_word_count")


@query(f"""WITH {TALK}, w AS (SELECT book, page, CAST(coalesce(nth, 0) AS INT) AS chapter_idx, CAST({WORDS} AS BIGINT) AS w, line FROM talk), s AS (SELECT *, sum(w) OVER (PARTITION BY book, chapter_idx) AS all_, coalesce(sum(w) OVER (PARTITION BY book, chapter_idx ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM w),
i AS (SELECT *, unnest([0, 1]) AS k FROM s)
SELECT book, chapter_idx, page AS page_idx, k, coalesce(CAST(trunc(least(1.0, (before_ + (0.25 + 0.5 * k) * w) / nullif(all_, 0)) * (all_ - 1)) AS INT), 0) AS word_position FROM i""")
def images_placed(spark: SparkSession, d: str) -> DataFrame:
    """Two images on each turn, a quarter and three quarters down."""
    t = tables.read(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("book"), F.col("turn").cast("int").alias("page_idx"), "text", "role")
    nth = F.expr("count_if(role = 'user') OVER (PARTITION BY book ORDER BY page_idx)").cast("int")
    image = lambda k: F.struct(F.concat_ws("-", "book", "page_idx").alias("data_uri"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit(0.25 + 0.5 * k).alias("y_position"))
    out = chapters.images_placed(t.withColumn("chapter_idx", nth).withColumn("images", F.array(image(0), image(1))))
    return out.select("book", "chapter_idx", F.explode("images").alias("i")).select("book", "chapter_idx", "i.page_idx", "i.k", "i.word_position")


@query("SELECT event_id, user_id >= 50 AND value * 10 >= 50 AND event_id > 100 AND NOT (user_id * (value * 10) > 0.7 * (72 * 144) * (150.0 / 72) * (150.0 / 72)) AS usable FROM events")
def images_usable(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select("event_id", F.col("user_id").alias("width"), (F.col("value") * 10).alias("height"), F.col("event_id").alias("size"), F.lit(72).alias("page_w"), F.lit(144).alias("page_h"))
    return e.select("event_id", chapters.usable_image().alias("usable"))


def _starts(rule: str, kind: str) -> str:
    return f"""WITH {LINE_VIEW}, f AS (SELECT page, max(n) AS n FROM lines GROUP BY page), s AS (SELECT *, n >= 8 AS noted, {rule} FROM f)
SELECT page, CAST(n AS BIGINT) AS n, CAST(CASE WHEN noted THEN start END AS BIGINT) AS start, CAST(CASE WHEN noted THEN strategy END AS BIGINT) AS strategy FROM s"""


def _found(spark: SparkSession, d: str, kind: str) -> DataFrame:
    out = footnotes.starts(lines_of(spark, d, kind).withColumn("col", F.lit(0)))
    return out.where("i = 0").select("page", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.col("strategy").cast("long").alias("strategy"))


@query(_starts("n - 3 AS start, 2 AS strategy", "tight"))
def footnotes_by_font(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "tight")


@query(_starts("n - 3 AS start, 3 AS strategy", "plain_notes"))
def footnotes_by_gap(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "plain_notes")


@query(_starts("CASE WHEN 72 + 14 * (n - 3) > 792 * 0.65 THEN n - 3 ELSE n - 2 END AS start, CASE WHEN 72 + 14 * (n - 3) > 792 * 0.65 THEN 4 ELSE 2 END AS strategy", "low"))
def footnotes_by_place(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "low")


@query(f"""WITH {LINE_VIEW}, l AS (SELECT page, n, line_no, n - 3 AS pair, CAST(floor(n * 0.4) AS INT) AS low, length(trim(text)) AS len FROM lines),
s AS (SELECT page, n, coalesce(max(line_no) FILTER (line_no < pair AND (line_no < low OR len > 80)) + 1, 0) AS start FROM l GROUP BY page, n)
SELECT page, CAST(n AS BIGINT) AS n, CAST(CASE WHEN n >= 8 THEN start END AS BIGINT) AS start, CAST(CASE WHEN n >= 8 THEN 5 END AS BIGINT) AS strategy FROM s""")
def footnotes_by_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "even")


@query(f"""WITH {TALK}, p AS (SELECT book, count(*) AS p, count(*) FILTER (several) AS n FROM talk WHERE is_start GROUP BY book) SELECT book, round(CASE WHEN n = 0 THEN 0.0 ELSE n / p END, 6) AS score FROM p""")
def chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that share no word, of users' turns, against those of several lines."""
    t = talk(spark, d).where("is_start").select("book", F.col("page").alias("start_page"), F.md5(F.concat_ws("-", "book", "page").cast("binary")).alias("title"), "several")
    return evaluate.chapter_titles(t, t.where("several").withColumn("title", F.upper("title"))).select("book", F.round("score", 6).alias("score"))


@query(f"""WITH {TALK}, o AS (SELECT book, page, substr(line, 1, 50) AS note, line, page % 10 AS number FROM talk WHERE is_start), b AS (SELECT book, page, is_start, CASE WHEN several THEN replace(text, ' ', '7 ') ELSE text END AS text FROM talk),
k AS (SELECT o.book, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.book = o.book AND NOT b.is_start AND contains(b.text, substr(o.note, 1, 30))) ) AS leaked FROM o WHERE length(note) >= 10 GROUP BY o.book),
w AS (SELECT book, string_agg(text, chr(10) ORDER BY page, text) AS whole FROM b GROUP BY book),
r AS (SELECT o.book, w.whole, list_filter(string_split_regex(regexp_replace(line, '\\d', '', 'g'), '\\s+'), lambda x: length(x) > 3)[1] AS word FROM o JOIN w ON w.book = o.book WHERE length(line) >= 5),
a AS (SELECT book, whole, CASE WHEN word IS NULL THEN 0 ELSE instr(lower(whole), lower(word)) END AS pos FROM r),
f AS (SELECT book, avg(CASE WHEN pos > 0 AND regexp_matches(substr(whole, greatest(pos - 50, 1), least(pos - 1, 50) + 100), '[a-zA-Z]7[a-zA-Z]|[a-zA-Z]7\\s') THEN 0.0 ELSE 1.0 END) AS clean FROM a GROUP BY book),
books AS (SELECT DISTINCT book FROM talk)
SELECT books.book, round(0.6 * coalesce(1 - leaked / n, 1.0) + 0.4 * coalesce(clean, 1.0), 6) AS score FROM books LEFT JOIN k ON k.book = books.book LEFT JOIN f ON f.book = books.book""".replace("\\\\", "\\"))
def footnote_separation(spark: SparkSession, d: str) -> DataFrame:
    """Users' first lines as notes and as the context of references to a note 7, which turns of several lines have after each word."""
    t = talk(spark, d).withColumn("text", F.when(F.col("several"), F.replace("text", F.lit(" "), F.lit("7 "))).otherwise(F.col("text")))
    note = F.struct(F.lit(1).alias("number"), F.col("line").alias("text"))
    p = t.where("is_start").select("book", F.array(note).alias("footnotes"), F.array(F.struct(F.lit("7").alias("number"), F.col("line").alias("nearText"))).alias("footnote_references"))
    n = t.select("book", F.col("page").alias("start_page"), "text", F.when(F.col("is_start"), F.array(note)).otherwise(F.array().cast("array<struct<number: int, text: string>>")).alias("footnotes"))
    return evaluate.footnote_separation(p, n).select("book", F.round("score", 6).alias("score"))


@query(f"""WITH {TALK}, l AS (SELECT book, page, string_split(text, chr(10)) AS ls FROM talk), f AS (SELECT book, array_to_string(string_split_regex(ls[1], '\\s+')[1:5], ' ') AS w FROM l WHERE len(ls) >= 2),
s AS (SELECT book, CASE WHEN EXISTS (SELECT 1 FROM talk t WHERE t.book = f.book AND t.is_start AND contains(t.text, w)) THEN 1 ELSE 0 END AS hit FROM f WHERE length(w) >= 10)
SELECT b.book, round(coalesce(avg(hit), 1.0), 6) AS score FROM (SELECT DISTINCT book FROM talk) b LEFT JOIN s ON s.book = b.book GROUP BY b.book""".replace("\\\\", "\\"))
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages of two columns whose regions are their lines, against users' turns."""
    t = talk(spark, d)
    region = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("body").alias("type"), i.alias("readingOrder"), x.alias("text")))
    a = t.select("book", "page", F.lit("two_column").alias("layout"), region.alias("regions"))
    return evaluate.reading_order(a, t.where("is_start")).select("book", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT source AS book, max(CAST(doc_id AS INT)) + 1 AS n FROM documents GROUP BY source), k AS (SELECT *, least(10, n) AS k, n // 5 AS from_, greatest(1, (n - n // 5) // least(10, n)) AS stride FROM n)
SELECT book, CAST(k AS INT) AS k, CAST(i AS INT) AS nth, CAST(least(from_ + i * stride, n - 1) AS INT) AS page FROM (SELECT *, unnest(range(0, k)) AS i FROM k)""")
def profile_sample(spark: SparkSession, d: str) -> DataFrame:
    return profile.sampled(tables.read(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page")))


@query(f"""WITH {LINE_VIEW}, n AS (SELECT source AS book, max(CAST(doc_id AS INT)) + 1 AS n FROM documents GROUP BY source), k AS (SELECT *, least(10, n) AS k, n // 5 AS from_, greatest(1, (n - n // 5) // least(10, n)) AS stride FROM n),
p AS (SELECT book, k, least(from_ + i * stride, n - 1) AS page FROM (SELECT *, unnest(range(0, k)) AS i FROM k)), l AS (SELECT p.book, p.page, p.k, font_size, lines.text, lines.n, lines.line_no FROM p JOIN lines ON lines.book = p.book AND lines.page = p.page),
s AS (SELECT p.book, p.page, sum(length(l.text)) AS chars FROM p LEFT JOIN l ON l.book = p.book AND l.page = p.page GROUP BY ALL), held AS (SELECT DISTINCT source AS book, CAST(doc_id AS INT) AS page FROM documents),
i AS (SELECT s.book, count(*) FILTER (coalesce(chars, 0) < 200) AS few, count(*) AS pages FROM s JOIN held ON held.book = s.book AND held.page = s.page GROUP BY s.book),
m AS (SELECT book, CAST(round(font_size * 10) AS INT) AS b, count(*) AS c FROM l GROUP BY ALL), g AS (SELECT book, arg_max(b, struct_pack(c := c, b := b)) / 10 AS global_font FROM m GROUP BY book)
SELECT i.book, CASE WHEN few > k // 5 THEN 'scannedOCR' ELSE 'digitalClean' END AS book_type, 'general' AS content_type, k // 3 <= 0 AS is_two_column, global_font, false AS prefer_content FROM i JOIN k ON k.book = i.book LEFT JOIN g ON g.book = i.book""")
def book_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages that all have images."""
    pages = tables.read(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"), F.lit(True).alias("has_images"))
    return profile.profiles(lines_of(spark, d), pages)


@query(rf"""WITH {TALK} SELECT book, page + 1 AS start_page, page AS start_page_raw, 'CHAPTER ' || page || ' Begins' AS title, md5(body || CASE WHEN note = '' THEN '' ELSE chr(10) || chr(10) || '———' || chr(10) || chr(10) || note END) AS plain_text, CAST(CASE WHEN note = '' THEN 0 ELSE 1 END AS INT) AS notes, false AS is_back_matter
FROM (SELECT book, first_ AS page, string_agg(CASE WHEN t <> '' THEN t END, chr(10) || chr(10) ORDER BY page) AS body, coalesce(max(CASE WHEN is_start THEN '1. Note ' || repeat('x', 50) END), '') AS note
  FROM (SELECT *, trim(text, {WS} || chr(10)) AS t, last_value(CASE WHEN is_start THEN page END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page) AS first_ FROM talk) WHERE first_ IS NOT NULL GROUP BY book, first_)""")
def blocks_converted(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages of blocks: users' ones with a heading and a note."""
    t = talk(spark, d)
    leafs = F.array().cast(f"array<{blocks.LEAF}>")
    block = lambda kind, html_, text=None: F.struct(F.lit(kind).alias("block_type"), html_.alias("html"), (F.lit(None).cast("string") if text is None else text).alias("text"), leafs.alias("children"))
    heading = block("SectionHeader", F.concat(F.lit("<h1>CHAPTER "), F.col("page"), F.lit(" <b>Begins</b></h1>")))
    body = block("Text", F.concat(F.lit("<p>"), T.escape_html("text"), F.lit("</p>")))
    note = block("Text", F.lit("<p>1. Note " + "x" * 50 + "</p>"))
    other = block("PageHeader", F.lit("<p>Title</p>"))
    page = F.struct(F.lit("Page").alias("block_type"), F.when(F.col("is_start"), F.array(other, heading, body, note)).otherwise(F.array(other, body)).alias("children"))
    none = F.struct(F.lit("Page").alias("block_type"), F.array().cast(f"array<{blocks.BLOCK}>").alias("children"))
    trees = t.groupBy("book").agg(F.max("page").alias("last"), F.map_from_entries(F.collect_list(F.struct("page", page))).alias("m"))
    trees = trees.select("book", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.element_at("m", i), none)).alias("children"))
    out = blocks.converted(blocks.flattened(trees))
    return out.where("title <> 'Full Text'").select("book", "start_page", "start_page_raw", "title", digest("plain_text").alias("plain_text"), F.size("footnotes").alias("notes"), "is_back_matter")


@query(f"""WITH {TALK} SELECT book, page, page AS number, CASE WHEN is_start THEN 'two_column' ELSE 'single_column' END AS layout, CASE WHEN page % 3 = 2 THEN NULL ELSE md5(line) END AS title FROM talk""")
def json_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of turns as a model writes them: whole, in a code fence, or cut off within a string."""
    t = talk(spark, d)
    layout_ = F.when(F.col("is_start"), "two_column").otherwise("single_column")
    whole = F.to_json(F.struct(F.col("page").alias("pageNumber"), layout_.alias("layout"), F.col("line").alias("chapterTitle")))
    fenced = F.concat(F.lit("```json\n"), whole, F.lit("\n```"))
    cut = F.concat(F.lit('{"pageNumber": '), F.col("page"), F.lit(', "layout": "'), layout_, F.lit('", "chapterTitle": "Cut of'))
    text = F.when(F.col("page") % 3 == 0, whole).when(F.col("page") % 3 == 1, fenced).otherwise(cut)
    out = annotations.parsed(t.select("book", "page", text.alias("text")))
    return out.select("book", "page", F.col("annotation.pageNumber").alias("number"), F.col("annotation.layout").alias("layout"), F.md5(F.col("annotation.chapterTitle").cast("binary")).alias("title"))


def _rendered(mark: str, figure: str) -> str:
    """Marks are links where there are five notes or more; three notes or more are a section of their own."""
    link = """'<sup><a href="#endnote-' || k || '" data-note-link="1">' || k || '</a></sup>'"""
    return f"""WITH {TALK}, t AS (SELECT book, CAST(page // 50 AS INT) AS chapter, page, row_number() OVER w AS k, count(*) OVER (PARTITION BY book, page // 50) AS n FROM talk WINDOW w AS (PARTITION BY book, page // 50 ORDER BY page)),
b AS (SELECT book, chapter, min(n) AS n, string_agg('<p>Part' || page || ' says so.' || CASE WHEN n >= 5 THEN {link} ELSE '{mark}' END || '</p>', '' ORDER BY page) AS body,
  string_agg(CASE WHEN n >= 3 THEN '<p id="endnote-' || k || '"><strong>' || k || '</strong> Note of ' || page || '</p>' ELSE '<p>' || k || '. Note of ' || page || '</p>' END, '' ORDER BY page) AS notes FROM t GROUP BY book, chapter)
SELECT book, chapter, md5('{figure}' || body || CASE WHEN n >= 3 THEN '<section class="transposed-endnotes"><hr><h3>Notes</h3>' || notes || '</section>' ELSE notes END) AS html FROM b"""


def marked_chapters(spark: SparkSession, d: str, mark: str) -> DataFrame:
    """Fifty turns each, a paragraph with a mark for each turn, and a note for each at the end."""
    t = talk(spark, d).groupBy("book", F.expr("cast(page div 50 AS int)").alias("chapter")).agg(F.array_sort(F.collect_list("page")).alias("ps"))
    body = F.transform("ps", lambda p: F.concat(F.lit("Part"), p, F.lit(f" says so.{mark}")))
    notes = F.transform("ps", lambda p, i: F.concat(i + 1, F.lit(". Note of "), p))
    return t.select("book", "chapter", F.array_join(F.concat(body, notes), "\n\n").alias("text"))


@query(_rendered("^", ""))
def html_carets(spark: SparkSession, d: str) -> DataFrame:
    return html.rendered(marked_chapters(spark, d, "^")).select("book", "chapter", digest("html").alias("html"))


@query(_rendered("†", '<figure class="transposed-figure"><img src="x.png" alt="a" width="3" height="4" loading="lazy"></figure>'))
def html_glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Daggers for carets, and a figure at the start."""
    c = marked_chapters(spark, d, "†")
    figures = c.select("book", "chapter", F.lit(0).alias("word_position"), F.lit("x.png").alias("src"), F.lit("a").alias("alt"), F.lit(3).alias("width"), F.lit(4).alias("height"))
    return html.rendered(c, figures).select("book", "chapter", digest("html").alias("html"))


@query(f"""WITH {LINE_VIEW}, r AS (SELECT page, line_no, n, text FROM lines) SELECT page, CAST(line_no AS INT) AS line_no, md5(text) AS text, round(72.0 + 14 * line_no, 3) AS y, 9.0::DOUBLE AS font_size FROM r""")
def scanned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines by their heights from a page's foot, with blanks around them and blank ones between."""
    df = lines_of(spark, d)
    raw = df.select("book", "page", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), F.lit(1e6).alias("page_h"), (1e6 - (72.0 + 14 * F.col("line_no")) - 12.0).alias("y"), F.lit(12.0).alias("height"), "min_x", "width", "page_w")
    blank = raw.withColumn("text", F.lit("  ")).withColumn("y", F.col("y") - 3)
    return layout.scanned(raw.unionByName(blank)).select("page", "line_no", digest("text").alias("text"), F.round("y", 3).alias("y"), "font_size")


@query(f"""WITH {LINE_VIEW}, h AS (SELECT page, line_no, text, width FROM lines) SELECT page, CAST(line_no AS INT) AS line_no, md5('a' || text || 'b' || CASE WHEN width <= 300 THEN 'c' ELSE '' END) AS text FROM h
UNION ALL SELECT page, CAST(line_no + 2000000 AS INT), md5('c') FROM h WHERE width > 300""")
def same_height(spark: SparkSession, d: str) -> DataFrame:
    """Each line between two short ones near its height, and a third that is far from those that end early."""
    df = lines_of(spark, d).select("book", "page", "line_no", "text", F.col("width").alias("w"))
    piece = lambda text, at, low, high, dy: df.select("book", "page", (F.col("line_no") * 4 + at).alias("line_no"), text.alias("text"), (72.0 + 14 * F.col("line_no") + dy).alias("y"), low.alias("min_x"), high.alias("max_x"), (high - low).alias("width"), F.lit(10.0).alias("font_size"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"))
    f = F.lit
    rows = [piece(f("a"), 0, f(60.0), f(70.0), 0.0), piece(F.col("text"), 1, f(72.0), 72.0 + F.col("w"), 1.0), piece(f("b"), 2, 74.0 + F.col("w"), 80.0 + F.col("w"), -1.0), piece(f("c"), 3, F.when(F.col("w") <= 300, 90.0 + F.col("w")).otherwise(200.0 + F.col("w")), 95.0 + F.col("w"), 0.0)]
    out = layout.same_height_joined(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))
    return out.select("page", F.when(F.col("text") == "c", F.expr("cast((line_no - 3) / 4 + 2000000 AS int)")).otherwise(F.expr("cast(line_no / 4 AS int)")).alias("line_no"), digest("text").alias("text"))


@query(f"""WITH {TALK} SELECT book, page, CASE WHEN is_start THEN 1 ELSE 0 END AS col, CASE WHEN NOT is_start THEN line || CASE WHEN several THEN ' more' ELSE '' END ELSE '' END AS note, CASE WHEN is_start OR NOT several THEN NULL ELSE NULL END AS continuation FROM talk WHERE false
UNION ALL SELECT book, page, c AS col, CASE WHEN c = 0 AND several THEN line || ' and on' WHEN c = 0 THEN line ELSE 'right' END, CASE WHEN c = 0 AND is_start THEN 'left' END FROM (SELECT *, unnest([0, 1]) AS c FROM talk)""")
def notes_continued(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages of two columns; the right one goes on with the left one's note where the turn has several lines."""
    t = talk(spark, d)
    note = lambda x: F.array(F.struct(F.lit(1).alias("number"), x.alias("text")))
    left = t.select("book", "page", F.lit(0).alias("col"), "text", note(F.col("line")).alias("footnotes"), F.when(F.col("is_start"), F.lit("left")).alias("continuation"))
    right = t.select("book", "page", F.lit(1).alias("col"), "text", note(F.lit("right")).alias("footnotes"), F.when(F.col("several"), F.lit("and on")).alias("continuation"))
    out = layout.with_continuations(left.unionByName(right))
    return out.select("book", "page", "col", F.expr("footnotes[0].text").alias("note"), "continuation")


@query(rf"""WITH {CHAPTERS}, p AS (SELECT book, chapter, trim(text) AS t FROM chapters), b AS (SELECT book FROM chapters GROUP BY book HAVING count(*) > 10),
q AS (SELECT p.book, chapter, trim(unnest(string_split(t, chr(10)))) AS p FROM p JOIN b ON b.book = p.book),
s AS (SELECT book, p FROM q WHERE length(p) >= 5 AND length(p) < 70 AND NOT regexp_matches(p, '[.!?]["'')\]]*\s*$')),
h AS (SELECT book, regexp_replace(regexp_replace(p, '^(\d\s){{1,3}}\d\s*\^?\s*', ''), '\s*\^?\s*(\d\s){{1,3}}\d$', '') AS h FROM s),
g AS (SELECT book, trim(replace(regexp_replace(regexp_replace(h, '^\d{{1,4}}\s*\^?\s*', ''), '\s*\^?\s*\d{{1,4}}$', ''), '^', ''), ' ' || chr(9) || chr(10) || chr(13)) AS h FROM h),
f AS (SELECT p.book, list_filter(string_split_regex(trim(split_part(t, chr(10), 1)), '\s+'), lambda w: w <> '') AS w, trim(split_part(t, chr(10), 1)) AS p FROM p JOIN b ON b.book = p.book),
k AS (SELECT book, w, list_min(list_filter(range(1, least(len(w) - 1, 12)), lambda j: regexp_matches(w[j + 1], '^\d{{1,4}}$'))) AS pos FROM f WHERE length(p) > 70 AND len(w) > 1),
t AS (SELECT book, array_to_string(w[1:pos], ' ') AS h FROM k WHERE pos IS NOT NULL)
SELECT book, h AS header, count(*) AS count FROM (SELECT book, h FROM g WHERE length(h) >= 5 UNION ALL SELECT book, h FROM t WHERE length(h) BETWEEN 5 AND 59 AND NOT regexp_matches(h, '[.!?]["'')\]]*\s*$')) GROUP BY ALL""")
def header_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of running headers, before those that are alike are merged."""
    return headers.candidates(chapters_of(spark, d).select("book", F.col("chapter").alias("page_idx"), "text"), "\n")


@query(rf"""WITH {TALK} SELECT book, page, md5(line || chr(10) || line) AS marks, md5(line) AS number, CASE WHEN page < 1000 THEN page END AS trailing FROM talk""")
def line_marks(spark: SparkSession, d: str) -> DataFrame:
    """Page marks within a text, note numbers after a word, and numbers at a line's end."""
    t = talk(spark, d)
    marked = F.concat("line", F.lit("\n" + T.PAGE_MARK + "\n"), "line")
    noted = F.concat(F.lit("word."), F.lit("3"), F.lit(" Next "))
    return t.select("book", "page", F.md5(T.without_page_marks(marked).cast("binary")).alias("marks"), F.when(layout.without_references(noted, F.array(F.lit(1))) == "word. Next ", F.md5(F.col("line").cast("binary"))).alias("number"), T.trailing_page(F.concat(F.lit("Word .. "), F.col("page"))).alias("trailing"))


@query(f"""WITH {TALK}, f AS (SELECT book, page, is_start, line, several FROM talk) SELECT book, page, is_start OR several AS again, NOT is_start AS skipped FROM f""")
def annotation_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns as the annotated pages; those, and pages of two columns, are looked at again."""
    t = talk(spark, d)
    a = t.where("is_start").select("book", "page", *(F.lit(True).alias(c) if c == "isChapterStart" else v.alias(c) for c, v in annotations.fallback().items()))
    filled = annotations.with_fallback(t, a).join(t.select("book", "page", "several"), ["book", "page"])
    filled = filled.withColumn("layout", F.when(F.col("several"), F.lit("two_column")).otherwise(F.col("layout")))
    return filled.select("book", "page", annotations.interesting().alias("again"), F.col("_skipped").alias("skipped"))


@query("""WITH s AS (SELECT source AS book, least(1.0, count(*) / 1000) AS a, least(1.0, avg(length(coalesce(text, ''))) / 5000) AS b FROM documents GROUP BY source), l AS (
SELECT book, 'chapter_titles' AS dimension, a AS score, 0.13 AS w FROM s UNION ALL SELECT book, 'ocr_quality', b, 0.10 FROM s UNION ALL SELECT book, 'reading_order', 1.0, 0.09 FROM s)
SELECT book, dimension, '  ' || CASE WHEN score >= 0.8 THEN 'PASS' ELSE 'FAIL' END || ' ' || rpad(dimension, 24, ' ') || ' ' || printf('%6.2f', score * 100) || '% (weight ' || printf('%.2f', w) || ')' AS line FROM l""")
def fidelity_report(spark: SparkSession, d: str) -> DataFrame:
    s = chapters_of(spark, d).groupBy("book").agg(F.least(F.lit(1.0), F.count("*") / 1000).alias("a"), F.least(F.lit(1.0), F.avg(F.length("text")) / 5000).alias("b"))
    long = s.select("book", F.explode(F.create_map(F.lit("chapter_titles"), F.col("a"), F.lit("ocr_quality"), F.col("b"), F.lit("reading_order"), F.lit(1.0))).alias("dimension", "score"))
    return evaluate.report(evaluate.weighted(long))


@query("SELECT CAST(doc_id AS VARCHAR) AS book, md5(coalesce(source, '')) AS pdf_hash, CAST(n_chars % 3 * 100 AS INT) AS dpi FROM documents WHERE n_chars % 3 * 100 = 200 AND source = lower(source)")
def pages_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Documents as books at three resolutions, whose manifests are all of one, with the hashes of their sources in small letters."""
    df = tables.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("book"), F.coalesce("source", F.lit("")).alias("s"), (F.col("n_chars") % 3 * 100).cast("int").alias("dpi"))
    manifests = df.select("book", F.md5(F.lower("s").cast("binary")).alias("pdf_hash"), F.lit(200).alias("dpi"))
    return tables.pages_rendered(manifests, df.select("book", F.md5(F.col("s").cast("binary")).alias("pdf_hash"), "dpi"))


@query(f"""WITH {TALK} SELECT book, 'Extracted ' || count(*) || ' chapters, ' || CAST(sum({WORDS}) AS BIGINT) || ' words' AS line FROM talk GROUP BY book""")
def book_summaries(spark: SparkSession, d: str) -> DataFrame:
    return tables.summary(talk(spark, d).select("book", T.word_count("text").alias("ws_word_count")))


@query(f"""WITH {TALK} SELECT book || '-' || page AS id, CASE WHEN several THEN NULL ELSE md5(text) END AS text, CASE WHEN several THEN 'ValueError: several lines' END AS error FROM talk""")
def requests_answered(spark: SparkSession, d: str) -> DataFrame:
    """Turns as requests of a model that refuses those of several lines."""

    def model():
        def infer(prompt: str) -> str:
            if "\n" in prompt:
                raise ValueError("several lines")
            return hashlib.md5(prompt.encode()).hexdigest()

        return infer

    return annotations.answered(talk(spark, d).select(F.concat_ws("-", "book", "page").alias("id"), F.col("text").alias("prompt")), model)
