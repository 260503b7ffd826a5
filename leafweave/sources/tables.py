"""Readers and writers. Every path is read by Spark, so any store that it knows will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.operators import annotations as A
from leafweave.operators import blocks as B

CONTENT = """chapters array<struct<title: string, plainText: string, paragraphs: array<string>, wordCount: int, startPage: int,
footnotes: array<struct<number: int, text: string>>, footnoteReferences: array<struct<number: string, nearText: string, column: string, pageNumber: int>>,
isBackMatter: boolean, backMatterType: string>>"""


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once and written to the session's checkpoint folder, for what is read several times. On a cluster
    spark.checkpoint.dir must name a shared folder; a local session without it gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with the name of its folder as book."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumn("book", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """book, dimension, score of baseline files, with `overall` as a dimension."""
    df = spark.read.schema("book string, locked string, overall double, dimensions map<string, double>").json(path, multiLine=True)
    return df.select("book", F.explode(F.map_concat("dimensions", F.create_map(F.lit("overall"), F.col("overall")))).alias("dimension", "score"))


def lock(scored: DataFrame, path: str, locked: str) -> None:
    """Writes a baseline for each book of scored (book, dimension, score, weighted)."""
    rows = scored.groupBy("book").agg(F.sum("weighted").alias("overall"), F.map_from_entries(F.collect_list(F.struct("dimension", "score"))).alias("dimensions"))
    rows.select("book", F.lit(locked).alias("locked"), "overall", "dimensions").write.mode("overwrite").partitionBy("book").json(path)


def block_trees(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, B.SCHEMA)


def page_annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of page annotations with a book column."""
    return spark.read.schema("book string, " + A.SCHEMA).json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """book (the folder's name), path, length of the files of a corpus; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return df.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book"), "path", "length")


def corpus(spark: SparkSession, path: str, needed: tuple[str, ...], only: tuple[str, ...] = ()) -> DataFrame:
    """Books whose folders have every file needed."""
    found = files(spark, path).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where(F.col("name").isin(*needed))
    books = found.groupBy("book").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(needed)).select("book")
    return books.where(F.col("book").isin(*only)) if only else books


def page_range(spec: str, spark: SparkSession) -> DataFrame:
    """page of `a-b`, `a`, or a comma-joined list of these."""
    parts = spark.createDataFrame([(p,) for p in spec.split(",")], "p string")
    ends = F.split("p", "-")
    return parts.select(F.explode(F.sequence(F.trim(ends[0]).cast("int"), F.trim(F.element_at(ends, -1)).cast("int"))).alias("page")).distinct()


def write_structure(chapters: DataFrame, path: str) -> None:
    """One JSON object a book, chapters in order, in a folder for each book."""
    body = F.to_json(F.struct(*(F.col(c) for c in sorted(chapters.columns) if c != "book")))
    rows = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", body.alias("j")))).alias("cs"))
    rows.select("book", F.concat(F.lit('{"chapters":['), F.array_join(F.transform("cs", lambda c: c["j"]), ","), F.lit("]}")).alias("value")).write.mode("overwrite").partitionBy("book").text(path)


def summary(chapters: DataFrame) -> DataFrame:
    """book, line: what a run tells of each book."""
    counts = chapters.groupBy("book").agg(F.count("*").alias("n"), F.coalesce(F.sum("ws_word_count"), F.lit(0)).alias("words"))
    return counts.select("book", F.format_string("Extracted %d chapters, %d words", "n", "words").alias("line"))


def write_text(chapters: DataFrame, path: str) -> None:
    """Plain text in a folder for each book: a row a chapter, its title before its text, in the order of chapters."""
    rows = chapters.repartition("book").sortWithinPartitions("book", "chapter_idx")
    rows.select("book", F.concat_ws("\n\n", "title", "plain_text", F.lit("")).alias("value")).write.mode("overwrite").partitionBy("book").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each book: predicted chapters, scored dimensions or anomalies."""
    rows.write.mode("overwrite").partitionBy("book").json(path)


def any_high(anomalies: DataFrame) -> bool:
    """Whether a run over these anomalies fails."""
    return bool(anomalies.where("severity = 'HIGH'").head(1))


def cache_append(annotations: DataFrame, path: str) -> None:
    """Adds rows (key, annotation) to a cache of annotations; the time tells later rows of a key from earlier ones."""
    annotations.select("key", F.to_json("annotation").alias("annotation"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def cache_read(spark: SparkSession, path: str) -> DataFrame:
    """key, annotation: of each key the row that was added last."""
    rows = spark.read.parquet(path).groupBy("key").agg(F.max_by("annotation", F.struct("at", "annotation")).alias("annotation"))
    return rows.select("key", F.from_json("annotation", A.SCHEMA).alias("annotation"))


def pages_rendered(manifests: DataFrame, books: DataFrame) -> DataFrame:
    """The books (book, pdf_hash, dpi) whose manifest is of the same file at the same resolution."""
    return books.join(manifests.select("book", "pdf_hash", "dpi").distinct(), ["book", "pdf_hash", "dpi"], "left_semi")
