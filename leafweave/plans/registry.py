"""Queries over the driver's tables; their SQL twins are in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators import anomalies, annotations, chapters, evaluate, footnotes, headers, html, layout, structure
from leafweave.plans import sql, structured
from leafweave.plans.views import chapters as chapters_of
from leafweave.plans.views import lines as lines_of
from leafweave.plans.views import turns as turns_of
from leafweave.sources import tables

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def word_boundaries(spark: SparkSession, d: str) -> DataFrame:
    c = chapters_of(spark, d).select("book", "chapter", T.token_count("text").alias("word_count"))
    return chapters.word_boundaries(c)


@query
def paragraph_starts(spark: SparkSession, d: str) -> DataFrame:
    words, starts = T.paragraph_tokens("text", "\n")
    return chapters_of(spark, d).select("chapter", F.size(words).cast("long").alias("words"), F.array_join(starts, ",").alias("starts"))


@query
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return chapters_of(spark, d).select("chapter", F.md5(F.array_join(T.tokens("text"), "|").cast("binary")).alias("tokens"), F.size(T.tokens("text")).cast("long").alias("n"))


@query
def repeated_short_lines(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.repeated_lines(chapters_of(spark, d))


@query
def header_leakage(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.header_leakage(chapters_of(spark, d)).select("book", "severity", "text", "count")


@query
def header_leakage_plain(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.header_leakage(chapters_of(spark, d), numbers=False).select("book", "severity", "text", "count")


@query
def garbage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.garbage_ratio(chapters_of(spark, d)).select("book", "chapter", "severity", F.round("ratio", 6).alias("ratio"))


@query
def corpus_garbage(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.corpus_garbage(chapters_of(spark, d)).select("book", F.round("ratio", 6).alias("ratio"))


@query
def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ocr_quality(chapters_of(spark, d)).select("book", F.round("score", 6).alias("score"))


@query
def stub_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.stub_paragraphs(chapters_of(spark, d), r"\s").select("book", "chapter", "severity", "text", "count")


@query
def missing_breaks(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.missing_breaks(chapters_of(spark, d)).select("book", "chapter", "severity", "count")


@query
def word_count_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.word_count_anomaly(chapters_of(spark, d)).select("book", "chapter", "severity", "count", "median")


@query
def duplicate_text(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.duplicate_text(chapters_of(spark, d)).select("book", "chapter", "other", "severity", "count")


@query
def title_garbling(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "pages").select(F.lit("pages").alias("book"), F.col("page_id").alias("chapter"), T.decode_entities(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))
    return anomalies.title_garbling(p).select("chapter", "severity", F.coalesce(F.round("ratio", 6), F.lit(0.0)).alias("ratio"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


@query
def image_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Events as images: those of a type are as wide as its name is long, but clicks as their users' numbers."""
    c = tables.read(spark, d, "events").select(F.col("event_type").alias("book"), F.when(F.col("event_type") == "click", F.col("user_id")).otherwise(F.length("event_type")).cast("int").alias("width"), F.lit(7).alias("height"))
    return anomalies.image_shapes(c).select("book", "text", "count")


@query
def anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    c = chapters_of(spark, d)
    found = anomalies.garbage_ratio(c).unionByName(anomalies.missing_breaks(c)).unionByName(anomalies.word_count_anomaly(c))
    return anomalies.severities(found)


@query
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "pages").select("page_id", T.strip_html("html").alias("text"), T.heading_level("html").alias("level"))


@query
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(?:p|li|h1)>([^<]*)"), F.lit(1))).alias("k", "block"))
    return p.select("page_id", "k", T.decode_entities("block").alias("block"))


@query
def block_html(spark: SparkSession, d: str) -> DataFrame:
    return chapters_of(spark, d).select("chapter", F.md5(T.paragraphs_html("text").cast("binary")).alias("html"))


@query
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return structure.page_chunk_totals(chapters_of(spark, d).select("book", F.col("chapter").alias("page_idx"), "text"))


@query
def chapter_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Turns as annotated pages of one body region each."""
    t = turns_of(spark, d)
    region = F.struct(F.lit("body").alias("type"), F.lit(0).alias("readingOrder"), F.col("text").alias("text"), F.lit("full").alias("column"), F.lit(1.0).alias("confidence"))
    a = t.select("book", "page", F.col("is_start").alias("isChapterStart"), F.col("title").alias("chapterTitle"), F.array(region).alias("regions"), *(v.alias(c) for c, v in annotations.fallback().items() if c not in ("isChapterStart", "chapterTitle", "regions")))
    return annotations.rolled_up(a).select("book", "start_page", "title", "ws_word_count", F.size("paragraphs").cast("long").alias("paragraphs"), F.md5(F.col("plain_text").cast("binary")).alias("text"), "is_back_matter")


@query
def boundary_f1(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that begin with a user's turn against those that begin with a turn of several lines."""
    t = turns_of(spark, d)
    p = t.where("is_start").select("book", F.col("page").alias("start_page"))
    n = t.where(F.contains("text", F.lit("\n"))).select("book", F.col("page").alias("start_page"))
    return evaluate.chapter_boundaries(p, n).select("book", F.round("score", 6).alias("score"))


@query
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts against the same without their last line."""
    c = chapters_of(spark, d)
    return evaluate.body_text_completeness(c, c.withColumn("text", F.regexp_replace("text", r"\n[^\n]*\z", ""))).select("book", F.round("score", 6).alias("score"))


@query
def back_matter_f1(spark: SparkSession, d: str) -> DataFrame:
    c = chapters_of(spark, d)
    p = c.select("book", "title", (F.col("chapter") % 3 == 0).alias("is_back_matter"))
    n = c.select("book", F.when(F.col("chapter") % 5 == 0, "Notes on it").otherwise(F.lit("Text")).alias("title"), F.lit(False).alias("is_back_matter"))
    return evaluate.back_matter_detection(p, n).select("book", F.round("score", 6).alias("score"))


@query
def header_clean(spark: SparkSession, d: str) -> DataFrame:
    """Lines that many documents have, as running headers of an annotation, against the documents."""
    c = chapters_of(spark, d)
    top = anomalies.repeated_lines(c, numbers=False).where("count >= 3")
    a = top.groupBy("book").agg(F.collect_list(F.struct(F.lit("running_header").alias("type"), F.lit(0).alias("readingOrder"), F.col("line").alias("text"))).alias("regions"))
    return evaluate.running_header_clean(a, c).select("book", F.round("score", 6).alias("score"))


@query
def font_mode_median(spark: SparkSession, d: str) -> DataFrame:
    df = lines_of(spark, d).withColumn("bucket", F.round(F.col("font_size") * 10).cast("int"))
    mode = df.groupBy("book", "page", "bucket").agg(F.count("*").alias("c")).groupBy("book", "page").agg(F.max_by("bucket", F.struct("c", "bucket")).alias("mode"))
    return mode.join(df.groupBy("book", "page").agg(F.median("width").alias("width"), F.var_pop("font_size").alias("variance")), ["book", "page"]).select("book", "page", "mode", F.round("width", 6).alias("width"), F.round("variance", 6).alias("variance"))


@query
def paragraphs_from_lines(spark: SparkSession, d: str) -> DataFrame:
    out = layout.paragraphs(lines_of(spark, d).withColumn("col", F.lit(0)))
    return out.select("book", "page", "par", F.md5(F.col("text").cast("binary")).alias("text"))


@query
def column_split(spark: SparkSession, d: str) -> DataFrame:
    both = lines_of(spark, d, "wide").unionByName(lines_of(spark, d).withColumn("page", -F.col("page") - 1))
    return layout.columns_split(both).groupBy("page", "col").agg(F.count("*").alias("lines"), F.min("line_no").alias("first"))


@query
def page_numbers_stripped(spark: SparkSession, d: str) -> DataFrame:
    df = lines_of(spark, d).withColumn("text", F.when((F.col("line_no") < 2) | (F.col("line_no") % 7 > 4), F.col("line_no").cast("string")).otherwise(F.col("text"))).withColumn("col", F.lit(0))
    return layout.page_numbers_stripped(df).groupBy("page").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("lines"))


@query
def superscript_merge(spark: SparkSession, d: str) -> DataFrame:
    out = layout.superscripts_joined(lines_of(spark, d, "marks"))
    return out.select("page", "line_no", F.md5(F.col("text").cast("binary")).alias("text"), F.round("max_x", 3).alias("max_x"))


@query
def footnotes_split(spark: SparkSession, d: str) -> DataFrame:
    out = footnotes.starts(lines_of(spark, d).withColumn("col", F.lit(0)))
    return out.where("i = 0").select("page", F.col("n").cast("long").alias("n"), F.col("start").cast("long").alias("start"), F.col("strategy").cast("long").alias("strategy"))


@query
def footnotes_parsed(spark: SparkSession, d: str) -> DataFrame:
    _, notes = footnotes.separated(lines_of(spark, d).withColumn("col", F.lit(0)))
    return notes.select("page", F.posexplode("footnotes").alias("k", "f")).select("page", "k", F.col("f.number").alias("number"), F.md5(F.col("f.text").cast("binary")).alias("text"))


@query
def calibration_interp(spark: SparkSession, d: str) -> DataFrame:
    """Turns of users as entries that are found (some out of order), all turns as pages that are looked for."""
    t = turns_of(spark, d).select("book", F.col("page").alias("toc"), "is_start", F.length("text").alias("n")).where("n IS NOT NULL")
    points = structure.calibrated(t.where("is_start").select("book", "toc", (3 * F.col("toc") + F.col("n") % 5 - 1).cast("int").alias("pdf")))
    return structure.interpolated(t.select("book", "toc"), points).select("book", "toc", "pdf")


@query
def dice_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of every two benchmark texts, whole."""
    return evaluate.dice_pairs(tables.read(spark, d, "benchmark")).withColumn("dice", F.round("dice", 6))


@query
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The title of each page against its heading."""
    of = lambda tag: F.regexp_extract("html", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    p = tables.read(spark, d, "pages").select("page_id", of("title").alias("title"), of("footer").alias("footer"), of("h1").alias("heading"))
    return p.select("page_id", F.round(T.title_match("title", "heading"), 6).alias("heading"), F.round(T.title_match("title", "footer"), 6).alias("footer"))


@query
def header_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = chapters_of(spark, d).select("book", F.col("chapter").alias("page_idx"), "text")
    return headers.candidates(p, "\n")


@query
def header_strip(spark: SparkSession, d: str) -> DataFrame:
    p = chapters_of(spark, d).select("book", F.col("chapter").alias("page_idx"), "text")
    out = headers.stripped(p, headers.running_headers(p, "\n"), "\n")
    return out.select("page_idx", F.md5(F.col("text").cast("binary")).alias("text"))


@query
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    c = chapters_of(spark, d)
    now = evaluate.ocr_quality(c).select("book", F.lit("ocr_quality").alias("dimension"), "score")
    then = evaluate.ocr_quality(c.withColumn("text", F.regexp_replace("text", r"\n[^\n]*\z", ""))).select("book", F.lit("ocr_quality").alias("dimension"), "score")
    return evaluate.gate(now, then).select("book", "dimension", F.round("delta", 6).alias("delta"), "status")


@query
def weighted_overall(spark: SparkSession, d: str) -> DataFrame:
    s = chapters_of(spark, d).groupBy("book").agg((F.count("*") / 1000).alias("a"), F.least(F.lit(1.0), F.avg(F.length("text")) / 5000).alias("b"))
    long = s.select("book", F.explode(F.create_map(F.lit("chapter_titles"), F.col("a"), F.lit("ocr_quality"), F.col("b"), F.lit("reading_order"), F.lit(1.0))).alias("dimension", "score"))
    return evaluate.overall(evaluate.weighted(long), 0.1).select("book", F.round("overall", 6).alias("overall"), F.col("pass").alias("passed"))


@query
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: annotations.cache_key(T.content_key(F.col(c).cast("string")), "model", "v1")
    pages = tables.read(spark, d, "documents").select("doc_id", key("doc_id").alias("key"))
    return annotations.cache_misses(pages, tables.read(spark, d, "labels").select(key("doc_id").alias("key"))).select("doc_id", "key")


@query
def triage_merge(spark: SparkSession, d: str) -> DataFrame:
    t = turns_of(spark, d).select("book", "page", F.when(F.col("is_start"), "two_column").otherwise("single_column").alias("layout"), F.col("text").alias("chapterTitle"))
    detail = t.where("layout = 'two_column'").select("book", "page", "layout", F.concat(F.lit("!"), "chapterTitle").alias("chapterTitle"))
    return annotations.merged(t, detail).select("book", "page", "layout", F.md5(F.col("chapterTitle").cast("binary")).alias("title"))


@query
def ocr_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return chapters_of(spark, d).select("chapter", F.md5(layout.ocr_cleaned(F.col("text")).cast("binary")).alias("text"))


@query
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of texts, up to 3999, as numerals; and back, where no numeral is above C."""
    n = tables.read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 3999 + 1).cast("int").alias("n"))
    return n.select("doc_id", "n", T.int_to_roman("n").alias("roman"), T.roman_to_int(T.int_to_roman(F.col("n") % 400)).alias("back"))


@query
def contents_table(spark: SparkSession, d: str) -> DataFrame:
    c = chapters_of(spark, d).select("book", F.col("chapter").alias("chapter_idx"), "title", T.token_count("text").alias("word_count"))
    return chapters.contents_table(chapters.word_boundaries(c, order="chapter_idx"))


@query
def book_totals(spark: SparkSession, d: str) -> DataFrame:
    return chapters.metadata(chapters_of(spark, d).select("book", T.token_count("text").alias("word_count"))).select("book", "total_chapters", "total_words")


@query
def images_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").select(F.col("event_type").alias("book"), F.col("event_id").alias("page_idx"), F.lit(0).alias("k"), T.image_key(F.col("user_id") % 50, F.lit(3), F.lit(4)).alias("key"))
    return chapters.images_distinct(e).select("book", "page_idx", "key")


@query
def logical_pages(spark: SparkSession, d: str) -> DataFrame:
    out = layout.logical_pages(lines_of(spark, d))
    return out.select("book", "page", "col", "page_idx", F.md5(F.col("text").cast("binary")).alias("text"), F.size("footnotes").alias("notes"))


@query
def rendered_html(spark: SparkSession, d: str) -> DataFrame:
    c = lines_of(spark, d).groupBy("book", F.col("page").alias("chapter")).agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(line_no, text))), x -> x.text)"), "\n\n").alias("text"))
    return html.rendered(c).select("book", "chapter", F.md5(F.col("html").cast("binary")).alias("html"), F.contains("html", F.lit("transposed-endnotes")).alias("notes"))


@query
def top_lines(spark: SparkSession, d: str) -> DataFrame:
    """The three most repeated short lines of each book."""
    r = anomalies.repeated_lines(chapters_of(spark, d), numbers=False)
    return r.withColumn("k", F.row_number().over(W.partitionBy("book").orderBy(F.desc("count"), "line"))).where("k <= 3")


def queries() -> dict:
    return {**QUERIES, **structured.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**sql.SQL, **structured.SQL}
