"""Book profiles from a sample of pages: scanned or digital, academic or general, body font."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.operators.footnotes import CITATION, NOTE
from leafweave.operators.layout import columns_split


def sampled(pages: DataFrame, most: int = 10) -> DataFrame:
    """pages (book, page from 0 on) -> book, k, page, nth: up to ten pages at even strides, the first fifth skipped."""
    n = pages.groupBy("book").agg((F.max("page") + 1).alias("n"))
    n = n.withColumn("k", F.least(F.lit(most), F.col("n")).cast("int")).withColumn("from", F.expr("cast(n div 5 AS int)")).withColumn("stride", F.expr("greatest(1, cast((n - from) div k AS int))"))
    return n.select("book", "k", "n", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("nth"), "from", "stride").select("book", "k", "nth", F.least(F.col("from") + F.col("nth") * F.col("stride"), F.col("n") - 1).cast("int").alias("page"))


def profiles(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines, and pages (book, page, page_w, page_h, has_images) -> book, book_type, content_type, is_two_column,
    global_font, prefer_content. Pages are measured first, then books; integer divisions are the rule's own."""
    picked = sampled(pages)
    w = lines.join(picked.select("book", "page").distinct(), ["book", "page"], "left_semi")
    two = columns_split(w, gutter=False).groupBy("book", "page").agg((F.max("col") == 1).alias("two"))
    ordered = w.groupBy("book", "page").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"),
        F.sum(F.length("text")).alias("chars"),
        F.when(F.count_if(F.col("font_size") > 3) >= 5, F.var_pop(F.when(F.col("font_size") > 3, F.col("font_size")))).alias("variance"),
    )
    cited = F.size(F.filter(F.slice("rows", F.floor(F.size("rows") / 2).cast("int") + 1, F.size("rows")), lambda r: F.trim(r["text"]).rlike(NOTE) & F.trim(r["text"]).rlike(CITATION)))
    facts = ordered.select("book", "page", "chars", "variance", cited.alias("cited"))
    per = picked.join(pages, ["book", "page"]).join(facts, ["book", "page"], "left").join(two, ["book", "page"], "left")
    books = per.groupBy("book").agg(
        F.first("k").alias("k"), F.count_if(F.col("page_w") > F.col("page_h") * 1.1).alias("landscape"), F.count_if("two").alias("two"),
        F.count_if(F.col("has_images") & (F.coalesce("chars", F.lit(0)) < 200)).alias("illustrated"), F.sum(F.coalesce("cited", F.lit(0))).alias("cited"), F.coalesce(F.avg("variance"), F.lit(10.0)).alias("variance"),
    )
    fonts = lines.join(picked.select("book", "page"), ["book", "page"]).where("font_size > 3").groupBy("book", F.round(F.col("font_size") * 10).cast("int").alias("b")).agg(F.count("*").alias("c")).groupBy("book").agg((F.max_by("b", F.struct("c", "b")) / 10).alias("global_font"))
    out = books.join(fonts, "book", "left").withColumn("is_two_column", F.expr("two >= k div 3"))
    scanned = F.expr("landscape >= k div 2 OR (is_two_column AND variance < 2) OR illustrated > k div 5")
    out = out.withColumn("book_type", F.when(scanned, "scannedOCR").otherwise("digitalClean")).withColumn("content_type", F.when(F.col("cited") >= 3, "academic").otherwise("general"))
    return out.select("book", "book_type", "content_type", "is_two_column", "global_font", ((F.col("book_type") == "scannedOCR") & (F.col("content_type") == "academic")).alias("prefer_content"))
