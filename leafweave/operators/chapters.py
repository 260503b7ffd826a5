"""Chapters from logical pages and their starts: text, notes, images, word boundaries, tables of contents, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.operators.ranges import running
from leafweave.operators.structure import back_title


def assigned(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """pages with the chapter (chapter_idx, title, is_back_matter, first) whose range [start, next start) they are in; pages
    before the first start are a front-matter chapter, -1. Starts without a page of their own vanish."""
    o = W.partitionBy("book").orderBy("page", "seq")
    s = starts.withColumn("chapter_idx", F.row_number().over(W.partitionBy("book").orderBy("seq", "page")) - 1).withColumn("until", F.lead("page").over(o)).where("until IS NULL OR until > page")
    marks = s.select("book", F.col("page").alias("page_idx"), F.struct("chapter_idx", "title", F.col("page").alias("first"), "is_back").alias("c"))
    at = pages.join(marks, ["book", "page_idx"], "left")
    at = at.withColumn("c", F.last("c", ignorenulls=True).over(W.partitionBy("book").orderBy("page_idx")))
    title = F.coalesce(T.chapter_title("c.title"), F.lit("Front Matter"))
    return at.select(*pages.columns, F.coalesce("c.chapter_idx", F.lit(-1)).alias("chapter_idx"), title.alias("title"), F.coalesce(F.col("c.is_back") | back_title(F.col("c.title")), F.lit(False)).alias("is_back_matter"), F.coalesce("c.first", F.lit(0)).alias("first"))


def notes_resolved(pages: DataFrame) -> DataFrame:
    """book, chapter_idx, footnotes (a struct array by number, the first of each number): what continues a note goes to the
    last note of the nearest page before that has any."""
    o = W.partitionBy("book", "chapter_idx").orderBy("page_idx")
    has = F.when(F.size("footnotes") > 0, F.col("page_idx"))
    to = F.last(has, ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, -1))
    df = pages.withColumn("_to", F.when(F.col("continuation").isNotNull(), to))
    more = df.where("_to IS NOT NULL").groupBy("book", "chapter_idx", F.col("_to").alias("page_idx")).agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(page_idx AS p, continuation AS t))), x -> x.t)"), " ").alias("more"))
    rows = df.select("book", "chapter_idx", "page_idx", "footnotes", F.posexplode("footnotes").alias("k", "f")).join(more, ["book", "chapter_idx", "page_idx"], "left")
    text = F.when((F.col("k") == F.size("footnotes") - 1) & F.col("more").isNotNull(), F.concat(F.col("f.text"), F.lit(" "), F.col("more"))).otherwise(F.col("f.text"))
    first = rows.groupBy("book", "chapter_idx", F.col("f.number").alias("number")).agg(F.min_by(text, F.struct("page_idx", "k")).alias("text"))
    return first.groupBy("book", "chapter_idx").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("footnotes"))


def images_placed(pages: DataFrame) -> DataFrame:
    """pages (with images: array of (data_uri, width, height, y_position)) -> book, chapter_idx, images by word position: the
    share of the chapter's words before the page and of the page above the image, times the last word."""
    o = W.partitionBy("book", "chapter_idx").orderBy("page_idx")
    df = pages.withColumn("_w", T.word_count("text")).withColumn("_all", F.sum("_w").over(W.partitionBy("book", "chapter_idx"))).withColumn("_before", F.coalesce(F.sum("_w").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = df.select("book", "chapter_idx", "page_idx", "_w", "_all", "_before", F.posexplode("images").alias("k", "i"))
    at = (F.least(F.lit(1.0), (F.col("_before") + F.col("i.y_position") * F.col("_w")) / F.nullif("_all", F.lit(0))) * (F.col("_all") - 1)).cast("int")
    item = F.struct(F.coalesce(at, F.lit(0)).alias("word_position"), "page_idx", "k", F.col("i.data_uri").alias("src"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
    return rows.groupBy("book", "chapter_idx").agg(F.array_sort(F.collect_list(item)).alias("images"))


def images_distinct(images: DataFrame) -> DataFrame:
    """images (book, page_idx, k, key, ...): the first of each key of a book."""
    first = images.groupBy("book", "key").agg(F.min(F.struct("page_idx", "k")).alias("_f")).select("book", "key", F.col("_f.page_idx").alias("page_idx"), F.col("_f.k").alias("k"))
    return images.join(first, ["book", "key", "page_idx", "k"], "left_semi")


def usable_image(width="width", height="height", size="size", page_w="page_w", page_h="page_h"):
    """Images of 50 points a side or more and over 100 bytes, which don't fill seven tenths of a page at 150 dots an inch."""
    w, h = F.col(width), F.col(height)
    page = F.col(page_w) * F.col(page_h) * (150.0 / 72) ** 2
    return (w >= 50) & (h >= 50) & (F.col(size) > 100) & ~(w * h > 0.7 * page)


def built(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """chapters: book, chapter_idx, title, start_page (from 1), plain_text (with its notes at the end), footnotes,
    is_back_matter, tokens, paragraph_starts, word_count and ws_word_count. Blank front matter is left out."""
    at = assigned(pages, starts)
    texts = at.groupBy("book", "chapter_idx").agg(
        F.first("title").alias("title"), F.max("is_back_matter").alias("is_back_matter"), (F.min("pdf_page") + 1).alias("start_page"),
        F.array_join(F.expr("transform(array_sort(collect_list(struct(page_idx, text))), x -> x.text)"), "\n").alias("body"),
    )
    df = texts.join(notes_resolved(at), ["book", "chapter_idx"], "left").where((F.col("chapter_idx") >= 0) | (F.trim("body") != ""))
    body = T.without_title("body", "title")
    notes = F.array_join(F.transform("footnotes", lambda f: F.concat_ws(" ", f["number"], f["text"])), "\n\n")
    df = df.withColumn("plain_text", F.when(F.size("footnotes") > 0, F.concat(body, F.lit("\n\n"), notes)).otherwise(body))
    tokens, at_words = T.paragraph_tokens("plain_text")
    return df.select("book", "chapter_idx", "title", "start_page", "plain_text", "footnotes", "is_back_matter", tokens.alias("tokens"), at_words.alias("paragraph_starts"), T.token_count("plain_text").alias("word_count"), T.word_count("plain_text").alias("ws_word_count"))


def word_boundaries(chapters: DataFrame, count: str = "word_count", order: str = "chapter") -> DataFrame:
    """chapters with start_word_index and end_word_index, the words of a book counted on, by ranges of its chapters."""
    out = running(chapters, ["book"], [order], start_word_index=F.col(count))
    return out.withColumn("end_word_index", (F.col("start_word_index") + F.col(count)).cast("long"))


def contents_table(chapters: DataFrame) -> DataFrame:
    """book, title, word_index, chapter_index."""
    df = running(chapters.select("book", "chapter_idx", "title", "start_word_index"), ["book"], ["chapter_idx"], chapter_index=F.lit(1))
    return df.select("book", F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("start_word_index").alias("word_index"), "chapter_index")


def metadata(chapters: DataFrame, source: str = "native", version: str = "1.0") -> DataFrame:
    return chapters.groupBy("book").agg(F.count("*").alias("total_chapters"), F.sum("word_count").alias("total_words")).select("book", F.lit(source).alias("source"), F.lit(version).alias("version"), "total_chapters", "total_words")
