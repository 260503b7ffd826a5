"""Page annotations as a stream of JSON lines: new files are annotated rows once each, late and repeated pages go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafweave.operators import annotations as A


def read(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema("book string, at timestamp, " + A.SCHEMA).option("maxFilesPerTrigger", files).json(path)


def fresh(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each (book, page) within the watermark."""
    return pages.withWatermark("at", late).dropDuplicatesWithinWatermark(["book", "pageNumber"])


def page_kinds(pages: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Pages and those that a second pass would look at, by window of time."""
    counted = pages.withWatermark("at", late).groupBy(F.window("at", window))
    return counted.agg(F.count("*").alias("pages"), F.count_if(A.interesting()).alias("interesting"))


def write(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is now as Parquet, and ends; the checkpoint makes a rerun go on where this one ended."""
    return pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
