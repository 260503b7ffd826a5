"""Chapters as HTML: paragraphs, linked note references, notes, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.functions import text as T

#: How a note's paragraph begins, and marks of references after punctuation (or letters).
NOTE = r"^(\d{1,4})[.\s]"
CARET = r"(?<=[.,:;!?'\"\)\]])\s?(\^[\^'°*]*)"
GLYPH = r"(?<=[.,:;!?\)\]\"\x{201C}\x{201D}])\s?([*®†‡§¶©°«»¤¥£¢¦¬~`\x{2019}]|!\d{1,3})|(?<=\p{L})\s?([*®†‡§¶©°«»¤¥£¢¦¬~`]|!\d{1,3})"
INLINE = r"(?<=[.,:;!?'\"\)\]^])\s?(\d{1,3})(?=\s|$)"


def link(number: Column) -> Column:
    n = number.cast("string")
    return F.concat(F.lit('<sup><a href="#endnote-'), n, F.lit('" data-note-link="1">'), n, F.lit("</a></sup>"))


def paragraph_rows(chapters: DataFrame) -> DataFrame:
    """book, chapter, i, para (escaped), n: the paragraphs of each chapter's text."""
    ps = T.paragraphs(T.escape_html("text"))
    return chapters.select("book", "chapter", F.size(ps).alias("n"), F.posexplode(ps).alias("i", "para"))


def notes_marked(paras: DataFrame) -> DataFrame:
    """paras with is_note, notes_from (where the endnotes begin: at the last run of three numbered paragraphs or more; null
    without one), defined (the numbers of the notes, in order), linked, and mode: caret, glyph, inline or none."""
    w, o = W.partitionBy("book", "chapter"), W.partitionBy("book", "chapter").orderBy("i")
    df = paras.withColumn("is_note", F.col("para").rlike(NOTE))
    df = df.withColumn("_run", F.sum((~F.col("is_note")).cast("int")).over(o))
    df = df.withColumn("_long", F.count_if("is_note").over(W.partitionBy("book", "chapter", "_run")))
    last = F.max(F.when(F.col("is_note") & (F.col("_long") >= 3), F.col("_run"))).over(w)
    df = df.withColumn("notes_from", F.min(F.when(F.col("is_note") & (F.col("_run") == last), F.col("i"))).over(w))
    number = F.regexp_extract("para", NOTE, 1).try_cast("int") if hasattr(Column, "try_cast") else F.expr("try_cast(regexp_extract(para, '^(\\\\d{1,4})[.\\\\s]', 1) AS int)")
    df = df.withColumn("defined", F.sort_array(F.collect_set(F.when((F.col("i") >= F.col("notes_from")) & F.col("is_note"), number)).over(w)))
    d = F.size("defined")
    df = df.withColumn("linked", F.coalesce((d >= 5) & (F.col("notes_from") < d * 20), F.lit(False)))
    body = F.col("i") < F.coalesce("notes_from", "n")
    count = lambda p: F.sum(F.when(body, F.regexp_count("para", F.lit(p))).otherwise(0)).over(w)
    few = count(INLINE) + count("!")
    mode = F.when(~F.col("linked"), "none").when(count(CARET) >= 3, "caret").when((few < F.floor(d / 3)) & (count(GLYPH) + few >= F.floor(d / 4)), "glyph").otherwise("inline")
    return df.withColumn("mode", mode).drop("_run", "_long")


def inline_linked(text: Column, defined: Column) -> Column:
    """Numbers up to 200 that notes define, right after punctuation, as links."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(INLINE), F.lit(1))), lambda n: F.array_contains(defined, n.cast("int")) & (n.cast("int") <= 200))
    mark = lambda n: F.concat(F.lit(r"(?<=[.,:;!?'\"\)\]^])(\s?)"), n, F.lit(r"(?=\s|$)"))
    return F.aggregate(found, text, lambda t, n: F.regexp_replace(t, mark(n), F.concat(F.lit("$1"), link(n.cast("int")))))


def sequential_linked(text: Column, pattern: str, defined: Column, base: Column) -> Column:
    """Marks of a text as links to the notes from the base-th on; marks after the last note stay."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    piece = lambda x, k: F.concat(F.coalesce(F.get(gaps, k), F.lit("")), F.when(base + k < F.size(defined), link(F.get(defined, (base + k).cast("int")))).otherwise(x))
    return F.when(F.size(whole) > 0, F.concat(F.array_join(F.transform(whole, piece), ""), F.coalesce(F.get(gaps, F.size(whole)), F.lit("")))).otherwise(text)


def marker_base(paras: DataFrame, pattern: str, floor: str | None = None) -> DataFrame:
    """paras with base: how many marks come before a paragraph, at least the number of notes of the pages before it (floor,
    a column that is null but where a page begins). With M the marks so far and f a floor, that is M + max(f - M)."""
    o = W.partitionBy("book", "chapter").orderBy("i")
    df = paras.withColumn("_m", F.regexp_count("para", F.lit(pattern)).cast("long"))
    df = df.withColumn("_b", F.coalesce(F.sum("_m").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    over = F.greatest(F.lit(0), F.coalesce(F.max(F.col(floor) - F.col("_b")).over(o), F.lit(0))) if floor else F.lit(0)
    return df.withColumn("base", (F.col("_b") + over).cast("int")).drop("_m", "_b")


def rendered(chapters: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """chapters (book, chapter, text) -> book, chapter, html. figures (book, chapter, word_position, src, alt, width, height)
    stand before the paragraph at their share of the chapter's words."""
    df = notes_marked(paragraph_rows(chapters))
    df = marker_base(df, CARET).withColumnRenamed("base", "caret_base")
    df = marker_base(df, GLYPH).withColumnRenamed("base", "glyph_base")
    body = F.col("i") < F.coalesce("notes_from", "n")
    note = F.concat(F.lit('<p id="endnote-'), F.regexp_extract("para", NOTE, 1), F.lit('"><strong>'), F.regexp_extract("para", NOTE, 1), F.lit("</strong> "), F.trim(F.regexp_replace("para", NOTE, "")), F.lit("</p>"))
    text = F.when(F.col("mode") == "caret", sequential_linked(F.col("para"), CARET, F.col("defined"), F.col("caret_base")))
    text = text.when(F.col("mode") == "glyph", sequential_linked(F.col("para"), GLYPH, F.col("defined"), F.col("glyph_base"))).when(F.col("mode") == "inline", inline_linked(F.col("para"), F.col("defined"))).otherwise(F.col("para"))
    rows = df.select("book", "chapter", "notes_from", F.col("i").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("k"), F.when(~body & F.col("is_note"), note).otherwise(F.concat(F.lit("<p>"), F.when(body, text).otherwise(F.col("para")), F.lit("</p>"))).alias("part"))
    if figures is not None:
        sizes = chapters.select("book", "chapter", F.size(T.paragraphs("text")).alias("n"), F.greatest(F.lit(1), T.token_count("text")).alias("tokens"))
        at = F.least(F.col("n"), F.greatest(F.lit(0), (F.col("word_position") / F.col("tokens") * F.col("n")).cast("int")))
        tag = F.format_string('<figure class="transposed-figure"><img src="%s" alt="%s" width="%d" height="%d" loading="lazy"></figure>', "src", "alt", "width", "height")
        extra = figures.where("src <> ''").join(sizes, ["book", "chapter"]).select("book", "chapter", F.lit(None).cast("int").alias("notes_from"), at.alias("at"), F.lit(0).alias("kind"), "word_position", tag.alias("part"))
        extra = extra.withColumn("k", F.row_number().over(W.partitionBy("book", "chapter", "at").orderBy("word_position", "part"))).drop("word_position")
        rows = rows.unionByName(extra.select(rows.columns))
    parts = rows.groupBy("book", "chapter").agg(F.max("notes_from").alias("from"), F.array_sort(F.collect_list(F.struct("at", "kind", "k", "part"))).alias("ps"))
    join = lambda cond: f"array_join(transform(filter(ps, x -> {cond}), x -> x.part), '')"
    html = F.when(F.col("from").isNull(), F.expr(join("true"))).otherwise(F.concat(F.expr(join("x.at < `from` OR (x.at = `from` AND x.kind = 0)")), F.lit('<section class="transposed-endnotes"><hr><h3>Notes</h3>'), F.expr(join("x.at > `from` OR (x.at = `from` AND x.kind = 1)")), F.lit("</section>")))
    return parts.select("book", "chapter", html.alias("html"))
