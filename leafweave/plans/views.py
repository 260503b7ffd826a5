"""The driver's tables as books, chapters, pages and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.functions import text as T
from leafweave.sources import tables


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters, their sources as books; a title is a text's first line."""
    d = tables.read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.coalesce("text", F.lit("")).alias("text"), F.substring_index("text", "\n", 1).alias("title"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books, their turns as pages; a user's turn begins a chapter, and its first line is the title."""
    c = tables.read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("book"), F.col("turn").cast("int").alias("page"), (F.col("role") == "user").alias("is_start"), F.substring_index("text", "\n", 1).alias("title"), F.col("text"))


def lines(spark: SparkSession, sf_dir: str, kind: str = "plain") -> DataFrame:
    """Texts as pages of positioned lines. Where there are eight lines or more, the last three are numbered notes in a
    smaller font after a gap. kind `wide`: landscape pages whose lines alternate between two columns; `marks`: every
    fourth line has a number above its right half; `tight`, `plain_notes`, `low`, `even`: notes that only other rules
    find (without a gap; the first without its number; both; without a gap in the font of the page)."""
    d = tables.read(spark, sf_dir, "documents").select("source", "doc_id", T.lines("text").alias("ls")).where(F.size("ls") > 0)
    df = d.select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page"), F.size("ls").alias("n"), F.posexplode("ls").alias("line_no", "text"))
    note = (F.col("n") >= 8) & (F.col("line_no") >= F.col("n") - 3)
    first = F.col("line_no") == F.col("n") - 3
    numbered = note if kind not in ("plain_notes", "low") else note & ~first
    text = F.when(numbered, F.concat((F.col("line_no") - (F.col("n") - 4)).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    gap = F.when(note & F.lit(kind not in ("tight", "low", "even")), 20).otherwise(0)
    df = df.withColumn("width", F.least(F.lit(468.0), F.length("text") * 5.0))
    df = df.select(
        "book", "page", "line_no", text.alias("text"), (72.0 + 14 * F.col("line_no") + gap).cast("double").alias("y"), (72.0 + F.when(F.col("line_no") % 5 == 0, 18).otherwise(0)).cast("double").alias("min_x"),
        "width", F.when(note & F.lit(kind != "even"), 8.0).otherwise(10.0).alias("font_size"), F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"),
    )
    if kind == "wide":
        left = F.col("line_no") % 2 == 0
        df = df.withColumn("min_x", F.when(left, 40.0).otherwise(440.0)).withColumn("width", F.lit(300.0)).withColumn("page_w", F.lit(792.0)).withColumn("page_h", F.lit(612.0))
    df = df.withColumn("max_x", F.col("min_x") + F.col("width"))
    names = ["book", "page", "line_no", "text", "y", "min_x", "max_x", "width", "font_size", "page_w", "page_h"]
    if kind == "marks":
        marks = df.where("line_no % 4 = 1").select("book", "page", (F.col("line_no") + 10000).alias("line_no"), (F.col("line_no") % 97 + 1).cast("string").alias("text"), (F.col("y") - 3).alias("y"), (F.col("max_x") - 4).alias("min_x"), F.col("max_x").alias("max_x"), F.lit(4.0).alias("width"), F.lit(5.0).alias("font_size"), "page_w", "page_h")
        df = df.select(names).unionByName(marks)
    return df.select(names)

