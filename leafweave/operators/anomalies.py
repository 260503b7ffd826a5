"""Detectors of anomalies in extracted chapters: chapters(book, chapter, title, text) -> anomalies.

Each returns book, detector, severity, message-free facts (chapter, other, text, count, ratio, median). Groups are made
by (book, line), (book, shingle) and so on, never by book alone, so that a book of any size is spread out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.functions import text as T

COLUMNS = {"chapter": "long", "other": "long", "text": "string", "count": "long", "ratio": "double", "median": "long"}


def _shaped(df: DataFrame, detector: str, severity: Column, **values: Column) -> DataFrame:
    cells = [values.get(k, F.lit(None)).cast(t).alias(k) for k, t in COLUMNS.items()]
    return df.select("book", F.lit(detector).alias("detector"), severity.alias("severity"), *cells)


def _chapter_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book").agg(F.count("*").alias("chapters"))


def repeated_lines(chapters: DataFrame, numbers: bool = True) -> DataFrame:
    """book, line, count: in how many chapters of a book a short phrase is a line. numbers: page numbers are taken off."""
    found = chapters.select("book", "chapter", F.explode(T.lines("text")).alias("line")).where(T.short_phrase("line"))
    if numbers:
        found = found.withColumn("line", T.leak_text("line")).where(F.length("line") >= 5)
    return found.distinct().groupBy("book", "line").agg(F.count("*").alias("count"))


def header_leakage(chapters: DataFrame, numbers: bool = True) -> DataFrame:
    """Phrases that are lines of three chapters or more, and of three in ten."""
    found = repeated_lines(chapters, numbers).where("count >= 3").join(_chapter_counts(chapters), "book")
    found = found.where((F.col("chapters") >= 3) & (F.col("count") >= F.greatest(F.lit(3), F.floor(F.col("chapters") * 0.3))))
    return _shaped(found, "running_header_leakage", F.lit("HIGH"), text=F.col("line"), count=F.col("count"))


def garbage_ratio(chapters: DataFrame) -> DataFrame:
    found = chapters.where(F.length("text") >= 50).withColumn("ratio", T.odd_characters("text") / F.length("text")).where("ratio > 0.05")
    return _shaped(found, "ocr_garbage_ratio", F.when(F.col("ratio") > 0.15, "HIGH").otherwise("MEDIUM"), chapter=F.col("chapter"), ratio=F.col("ratio"))


def stub_paragraphs(chapters: DataFrame, breaks: str = r"\n{2,}") -> DataFrame:
    stubs = F.filter(T.paragraphs("text", breaks), lambda p: F.length(p) < 5)
    found = chapters.select("book", "chapter", stubs.alias("stubs")).where(F.size("stubs") > 3)
    return _shaped(found, "stub_paragraph", F.when(F.size("stubs") > 10, "HIGH").otherwise("MEDIUM"), chapter=F.col("chapter"), text=F.array_join(F.slice("stubs", 1, 5), "|"), count=F.size("stubs"))


def image_shapes(images: DataFrame) -> DataFrame:
    """images(book, width, height): books with five images or more, all of one shape."""
    found = images.groupBy("book").agg(F.count("*").alias("count"), F.min(F.struct("width", "height")).alias("low"), F.max(F.struct("width", "height")).alias("high"))
    return _shaped(found.where((F.col("count") >= 5) & (F.col("low") == F.col("high"))), "image_orientation", F.lit("MEDIUM"), text=F.concat_ws("x", "low.width", "low.height"), count=F.col("count"))


def title_garbling(chapters: DataFrame) -> DataFrame:
    """Titles of three characters or more with many unusual ones, or (but for all capitals) with many unusual words."""
    some = chapters.where(F.length("title") >= 3)
    ratio = T.odd_characters("title", T.TITLE_ORDINARY) / F.length("title")
    chars = some.withColumn("ratio", ratio).where("ratio > 0.3")
    words = F.split("title", r"\s+")
    garbled = F.size(F.filter(words, lambda w: (F.length(w) > 3) & w.rlike(r"[^a-zA-Z0-9'\-]")))
    bad = some.where(~F.col("title").rlike(r"^[A-Z\s]+$") & F.col("title").rlike("^[A-Z]")).withColumn("n", garbled).where((F.col("n") > 0) & (F.col("n") / F.size(words) > 0.3))
    high = _shaped(chars, "title_garbling", F.lit("HIGH"), chapter=F.col("chapter"), text=F.col("title"), ratio=F.col("ratio"))
    return high.unionByName(_shaped(bad, "title_garbling", F.lit("MEDIUM"), chapter=F.col("chapter"), text=F.col("title"), count=F.col("n")))


def missing_breaks(chapters: DataFrame) -> DataFrame:
    found = chapters.withColumn("n", T.word_count("text")).where((F.col("n") > 500) & ~F.contains("text", F.lit("\n\n")))
    return _shaped(found, "missing_paragraph_breaks", F.lit("HIGH"), chapter=F.col("chapter"), count=F.col("n"))


def word_count_anomaly(chapters: DataFrame) -> DataFrame:
    """Chapters of 1 to 49 words, and those of over ten times the book's upper median. A book's counts are histogrammed
    first: the median comes from as many rows as there are different counts."""
    counted = chapters.select("book", "chapter", T.word_count("text").alias("n"))
    different = counted.groupBy("book", "n").agg(F.count("*").alias("c"))
    w = W.partitionBy("book")
    upto = different.select("book", "n", F.sum("c").over(w).alias("chapters"), F.sum("c").over(w.orderBy("n")).alias("upto"))
    medians = upto.where("chapters >= 3 AND upto > floor(chapters / 2)").groupBy("book").agg(F.min("n").alias("median"))
    short, long = F.col("n").between(1, 49), (F.col("median") > 0) & (F.col("n") > 10 * F.col("median"))
    severities = F.filter(F.array(F.when(short, "MEDIUM"), F.when(long, "HIGH")), lambda s: s.isNotNull())
    found = counted.join(medians, "book").where(short | long).withColumn("severity", F.explode(severities))
    return _shaped(found, "word_count_anomaly", F.col("severity"), chapter=F.col("chapter"), count=F.col("n"), median=F.col("median"))


def duplicate_text(chapters: DataFrame, window: int = 20) -> DataFrame:
    """Pairs of chapters of a book that share more than three runs of 20 words, lower-cased.

    Shingles are compared by 64-bit hashes of their words' hashes. Chapters with the same set of shingles stand for each other: they
    are collapsed to one before pairs are made and pairs of sets expanded by their chapters at the end, so a text
    copied often costs one set's pairs and only the answer's own size; and a passage that many share costs each pair of
    them one row, however long it is. Passages are told apart by their sets' number and two hashes over them."""
    words = chapters.select("book", "chapter", F.transform(T.words(F.lower("text")), lambda w: F.xxhash64(w)).alias("h"))
    # The words' hashes are bound to a variable: predicates that are pushed down would else work them out for each window.
    run = F.expr(f"element_at(transform(array(h), w -> CASE WHEN size(w) >= {window} THEN transform(sequence(1, size(w) - {window - 1}), i -> xxhash64(slice(w, i, {window}))) END), 1)")
    sets = words.where(F.size("h") >= window).select("book", "chapter", F.sort_array(F.array_distinct(run)).alias("shingles"))
    sets = sets.withColumn("set", F.sha2(F.to_json("shingles"), 256))
    one = sets.groupBy("book", "set").agg(F.min("chapter").alias("rep"), F.count("*").alias("copies"))
    rows = sets.join(one.select("book", "set", "rep"), ["book", "set"]).where("chapter = rep").select("book", "set", F.explode("shingles").alias("s"))
    # Shingles that the same sets have (those of one shared passage) are counted as one of them, so many times.
    where = rows.groupBy("book", "s").agg(F.count("*").alias("n"), F.sum(F.crc32("set")).alias("h1"), F.bit_xor(F.xxhash64("set")).alias("h2")).where("n > 1")
    passages = where.groupBy("book", "n", "h1", "h2").agg(F.min("s").alias("s"), F.count("*").alias("times")).select("book", "s", "times")
    rows = rows.join(passages, ["book", "s"])
    shared = rows.alias("x").join(rows.select("book", "s", "set").alias("y"), ["book", "s"]).where("x.set < y.set").groupBy("book", F.col("x.set").alias("one"), F.col("y.set").alias("two")).agg(F.sum("times").alias("count")).where("count > 3")
    own = sets.select("book", F.col("set").alias("one"), F.col("set").alias("two"), F.size("shingles").cast("long").alias("count"), "chapter").join(one.where("copies > 1").select("book", F.col("set").alias("one")), ["book", "one"]).where("count > 3").select("book", "one", "two", "count").distinct()
    member = sets.select("book", "set", "chapter")
    pairs = shared.unionByName(own).join(member.select("book", F.col("set").alias("one"), F.col("chapter").alias("i")), ["book", "one"]).join(member.select("book", F.col("set").alias("two"), F.col("chapter").alias("j")), ["book", "two"])
    pairs = pairs.where("one <> two OR i < j")
    return _shaped(pairs, "duplicate_text", F.when(F.col("count") > 20, "HIGH").otherwise("MEDIUM"), chapter=F.least("i", "j"), other=F.greatest("i", "j"), count=F.col("count"))


def inspect(chapters: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """All detectors' anomalies."""
    found = [f(chapters) for f in (header_leakage, garbage_ratio, stub_paragraphs, title_garbling, missing_breaks, word_count_anomaly, duplicate_text)]
    return reduce(DataFrame.unionByName, found + ([image_shapes(images)] if images is not None else []))


def severities(anomalies: DataFrame) -> DataFrame:
    """book, high, medium, low."""
    return anomalies.groupBy("book").agg(*(F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("high", "medium", "low")))


def corpus_garbage(chapters: DataFrame) -> DataFrame:
    """Books of whose characters over one in twenty is unusual."""
    found = chapters.groupBy("book").agg(F.sum(T.odd_characters("text")).alias("odd"), F.sum(F.length("text")).alias("all"))
    return _shaped(found.withColumn("ratio", F.col("odd") / F.nullif("all", F.lit(0))).where("ratio > 0.05"), "ocr_garbage", F.lit("HIGH"), ratio=F.col("ratio"))
