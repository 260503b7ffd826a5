"""Block trees of another converter: pages of typed blocks to chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.functions import text as T

LEAF = "struct<block_type: string, html: string, text: string>"
BLOCK = f"struct<block_type: string, html: string, text: string, children: array<{LEAF}>>"
SCHEMA = f"children array<struct<block_type: string, children: array<{BLOCK}>>>"

#: Forms of chapter headings, in the order in which they are tried.
NAMED = r"(?i)^(INTRODUCTION|PREFACE|PROLOGUE|EPILOGUE|APPENDIX|NOTES|INDEX|CONTENTS)"
SPECIAL = r"(?i)^(LIST OF|TABLE OF|COMMISSION)"
CAPITALS = r"""^[\x{201C}\x{201D}"A-Z][A-Z\s\x{201C}\x{201D}"',.\-\x{2014}:?!()]+$"""
BACK = r"(?i)^(appendix|notes|index|bibliography|glossary)"


def flattened(trees: DataFrame) -> DataFrame:
    """trees (book, children) -> book, page, k, type, text, html, level. A block's text is its html's, else its children's
    joined by blanks, else its own."""
    pages = trees.select("book", F.posexplode("children").alias("page", "p"))
    b = pages.select("book", "page", F.posexplode("p.children").alias("k", "b"))
    kids = F.array_join(F.transform("b.children", lambda c: F.when(F.coalesce(c["html"], F.lit("")) != "", T.strip_html(c["html"])).otherwise(F.coalesce(c["text"], F.lit("")))), " ")
    text = F.when(F.coalesce("b.html", F.lit("")) != "", T.strip_html("b.html")).when(F.size("b.children") > 0, kids).otherwise(F.coalesce("b.text", F.lit("")))
    html = F.when(F.coalesce("b.html", F.lit("")) != "", T.clean_block_html("b.html")).otherwise(F.array_join(F.transform("b.children", lambda c: T.clean_block_html(F.coalesce(c["html"], F.lit("")))), "\n"))
    kind = F.coalesce("b.block_type", F.lit("?"))
    df = b.select("book", "page", "k", kind.alias("type"), text.alias("text"), F.coalesce(html, F.lit("")).alias("html"))
    df = df.withColumn("level", F.when(F.col("type") == "SectionHeader", T.heading_level("html")))
    note = (F.col("type") == "Text") & F.col("text").rlike(r"^\d{1,3}\.\s+[A-Z]") & (F.length("text") > 50)
    return df.withColumn("type", F.when(note, "Footnote").otherwise(F.col("type")))


def all_capitals(text: Column) -> Column:
    return text.rlike(CAPITALS)


def italic(html: Column) -> Column:
    """Whether less than two fifths of a heading's text are left without what is in italics."""
    inner = F.trim(F.regexp_replace(html, r"(?i)</?h\d[^>]*>", ""))
    whole, rest = F.length(F.trim(T.strip_html(inner))), F.length(F.trim(T.strip_html(F.regexp_replace(inner, r"(?is)<i[^>]*>.*?</i>", ""))))
    return F.coalesce((whole >= 3) & (rest < whole * 0.4), F.lit(False))


def chapter_kind(text: Column, level: Column, html: Column) -> Column:
    """The first rule that makes a heading a chapter's, or null."""
    long = F.length(text) > 5
    return (
        F.when(text.rlike(r"^\d+\.\d+\s"), F.lit(None).cast("string")).when(text.rlike(r"(?i)^CHAPTER\s"), "chapter-keyword")
        .when((level <= 1) & long & ~text.rlike(r"^\(") & all_capitals(text), "h1").when(text.rlike(NAMED), "named-section")
        .when((level <= 2) & text.rlike(r"^\d+[.\s]\s*[A-Z]") & ~text.rlike(r"^\d+\.\d+"), "numbered-chapter").when(text.rlike(SPECIAL), "special-section")
        .when((level <= 2) & all_capitals(text) & long, "allcaps-h2").when(italic(html) & long, "italic-title")
    )


def contents_pages(blocks: DataFrame) -> DataFrame:
    """book, page with a table of contents, or right after one with more than three headings and no more texts than those."""
    per = blocks.groupBy("book", "page").agg(F.count_if(F.col("type") == "TableOfContents").alias("t"), F.count_if(F.col("type") == "SectionHeader").alias("h"), F.count_if(F.col("type") == "Text").alias("x"))
    toc = per.where("t > 0").select("book", "page")
    after = per.where("h > 3 AND x <= h").join(toc.select("book", (F.col("page") + 1).alias("page")), ["book", "page"], "left_semi").select("book", "page")
    return toc.union(after).distinct()


def starts(blocks: DataFrame) -> DataFrame:
    """book, page, title, level: chapter headings. A heading takes in the next on its page as a subtitle where both are of
    one style; of a run of such headings every other one does. Of headings that open chapters on one page the first counts."""
    heads = blocks.where("type = 'SectionHeader'").withColumn("text", F.trim("text"))
    w = W.partitionBy("book", "page")
    heads = heads.withColumn("on_page", F.count("*").over(w)).where("text <> '' AND on_page <= 8").join(contents_pages(blocks), ["book", "page"], "left_anti")
    heads = heads.withColumn("level", F.coalesce("level", F.lit(2))).withColumn("kind", chapter_kind(F.col("text"), F.col("level"), F.col("html"))).withColumn("it", italic(F.col("html")))
    o = w.orderBy("k")
    follows = F.lead("text").over(o)
    next_kind = F.coalesce(F.lead("kind").over(o), F.lit("allcaps-h2"))
    joins = F.col("kind").isNotNull() & next_kind.isin("allcaps-h2", "h1") & ((F.col("kind") != "italic-title") | F.lead("it").over(o)) & (all_capitals(follows) | follows.rlike("^[A-Z]"))
    heads = heads.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("next", follows)
    run = F.sum((~F.coalesce(F.lag("joins").over(o), F.lit(False))).cast("int")).over(o)
    heads = heads.withColumn("run", run).withColumn("in_run", F.row_number().over(W.partitionBy("book", "page", "run").orderBy("k")))
    heads = heads.where("in_run % 2 = 1 AND kind IS NOT NULL").withColumn("title", F.when(F.col("joins"), F.concat_ws(" ", "text", "next")).otherwise(F.col("text")))
    return heads.groupBy("book", "page").agg(F.min_by(F.struct("title", "level"), "k").alias("x")).select("book", "page", "x.title", "x.level")


def converted(blocks: DataFrame) -> DataFrame:
    """book, start_page (from 1), start_page_raw (from 0), title, plain_text, html, footnotes, ws_word_count, is_back_matter.
    A book without chapter headings is one chapter, `Full Text`; pages before the first are left out."""
    first = starts(blocks)
    none = blocks.select("book").distinct().join(first, "book", "left_anti").select("book", F.lit(0).alias("page"), F.lit("Full Text").alias("title"), F.lit(1).alias("level"))
    marks = first.unionByName(none).select("book", "page", F.struct(F.col("page").alias("p"), "title").alias("c"))
    pages = blocks.select("book", "page").distinct().join(marks, ["book", "page"], "full").withColumn("c", F.last("c", ignorenulls=True).over(W.partitionBy("book").orderBy("page"))).where("c IS NOT NULL")
    df = blocks.join(pages, ["book", "page"]).where("trim(text) <> '' OR trim(html) <> ''").where("NOT (page = c.p AND type = 'SectionHeader') AND type NOT IN ('PageHeader', 'PageFooter', 'TableOfContents')")
    df = df.withColumn("t", F.trim("text"))
    level = F.coalesce("level", F.lit(3)).cast("string")
    shown = F.when(F.col("type") == "SectionHeader", F.concat(F.lit("<h"), level, F.lit(">"), T.strip_html(F.when(F.col("html") != "", F.col("html")).otherwise(F.col("text"))), F.lit("</h"), level, F.lit(">"))).when(F.col("html") != "", F.col("html")).otherwise(F.concat(F.lit("<p>"), T.strip_html("text"), F.lit("</p>")))
    number = F.regexp_extract("t", r"^(\d+)\.\s", 1)
    anchored = F.when(number != "", F.regexp_replace("html", F.concat(F.lit(r"(>\s*(?:<[^>]+>\s*)*)"), number, F.lit(r"\.\s")), F.concat(F.lit('$1<a href="#fn-top" class="fn-num">'), number, F.lit(".</a> ")))).otherwise(F.col("html"))
    note_html = F.when(F.col("html") != "", F.concat(F.lit('<div class="footnote"'), F.when(number != "", F.concat(F.lit(' id="fn-'), number, F.lit('"'))).otherwise(""), F.lit(">"), anchored, F.lit("</div>")))
    note = F.col("type") == "Footnote"
    of = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond & value.isNotNull(), F.struct("page", "k", value.alias("v"))))), lambda x: x["v"])
    out = df.groupBy("book", F.col("c.p").alias("start_page_raw"), F.col("c.title").alias("title")).agg(of(~note, F.col("t")).alias("body"), of(~note, shown).alias("body_html"), of(note, F.col("t")).alias("notes"), of(note, note_html).alias("notes_html"))
    starts_ = pages.groupBy("book").agg(F.collect_set("c").alias("cs")).select("book", F.explode("cs").alias("c")).select("book", F.col("c.p").alias("start_page_raw"), F.col("c.title").alias("title"))
    out = starts_.join(out, ["book", "start_page_raw", "title"], "left")
    empty = F.array().cast("array<string>")
    for c in ("body", "body_html", "notes", "notes_html"):
        out = out.withColumn(c, F.coalesce(c, empty))
    rule = F.lit("\n\n———\n\n")
    plain = F.concat(F.array_join("body", "\n\n"), F.when(F.size("notes") > 0, F.concat(rule, F.array_join("notes", "\n\n"))).otherwise(""))
    html = F.concat(F.lit('<div id="fn-top"></div>\n'), F.array_join("body_html", "\n"), F.when(F.size("notes_html") > 0, F.concat(F.lit('\n<hr class="footnote-divider">\n<section class="footnotes">\n<h4 class="footnotes-header">Footnotes</h4>\n'), F.array_join("notes_html", "\n"), F.lit("\n</section>"))).otherwise(""))
    title = F.trim(F.regexp_replace(F.regexp_replace("title", r"\s+", " "), r"^\d+[.\s]\s*", ""))
    out = out.withColumn("plain_text", plain).withColumn("html", html).withColumn("title", title)
    notes = F.transform("notes", lambda t, i: F.struct((i + 1).alias("number"), t.alias("text")))
    return out.select("book", (F.col("start_page_raw") + 1).alias("start_page"), "start_page_raw", "title", "plain_text", "html", notes.alias("footnotes"), T.word_count("plain_text").alias("ws_word_count"), F.col("title").rlike(BACK).alias("is_back_matter"))
