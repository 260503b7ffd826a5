"""Mixing sources to target weights, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.llm.common import WORD, broadcast_if_small, mark_of, numbered, persisted

#: Weights of the sources by code point, repeating; how often a source may be repeated.
WEIGHTS, MOST_REPEATS = (5.0, 2.0, 1.0), 3
SEED = "mix"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size (one row a source) -> with target and rate.

    Sources are numbered by code point, null last, and weigh by their number. The sum of all sizes is shared by weight:
    each target is a level times the weight. Sources for which that is over `most` times their size get that, and the
    rest is shared among the others at a new level, until none is above. Each round is an aggregate over the sources;
    only its sums come to the driver."""
    places = numbered(sizes.select(F.col("source").isNull().alias("last"), "source", "source_size"), "last", "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int"))
    known = persisted(places.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), lasting=True)
    total, level, capped = known.agg(F.sum("source_size")).head()[0] or 0, 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        n, taken, left = known.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).head()
        if n == capped:
            break
        capped, level = n, (total - (taken or 0.0)) / left if left else float("inf")
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return known.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(*columns: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the columns' values and the seed alone (52 bits of an MD5)."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def occurrences(rows: DataFrame) -> DataFrame:
    """rows (id, mark, source and others) with nth: 0, or for repeated (id, mark) the numbers from 0 on, source by source,
    so that which numbers a source's rows get doesn't depend on the partitions or the order the rows come in. Only
    repeated rows move. They are numbered within the partition they come from, after the counts of the sources and
    partitions before, so that rows repeated without end meet in no task."""
    same = lambda a, b, *names: reduce(and_, (a[n].eqNullSafe(b[n]) for n in names))
    again = broadcast_if_small(rows.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("id", "mark"))
    if not again.head(1):
        return rows.withColumn("nth", F.lit(0).cast("long"))
    placed = rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    some = persisted(placed.join(again, same(placed, again, "id", "mark"), "left_semi"), lasting=True)
    key = ("id", "mark", "source", "part")
    counts = some.groupBy(*key).agg(F.count("*").alias("n"))
    before = persisted(counts.select(*key, (F.sum("n").over(W.partitionBy("id", "mark").orderBy("source", "part")) - F.col("n")).alias("before")), lasting=True)
    within = some.withColumn("within", F.row_number().over(W.partitionBy(*key).orderBy("row")) - 1)
    numbers = within.join(before, same(within, before, *key)).select(*(within[c] for c in rows.columns), (F.col("within") + F.col("before")).alias("nth"))
    return rows.join(again, same(rows, again, "id", "mark"), "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(numbers)


def _planned(docs: DataFrame, rows: DataFrame, weights: Sequence[float], most: float, seed: str) -> DataFrame:
    """rows (id, mark, source and others, of the rows of docs) with source_size, target and copies."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = broadcast_if_small(targets(sums, weights, most).withColumnRenamed("source", "of"))
    extra = draw(F.col("id"), F.col("mark"), F.col("nth"), seed=seed) < F.col("rate") - F.floor("rate")
    out = occurrences(rows).join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("int")).drop("of", "rate", "nth")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc (a struct of all columns, so that their names clash with none), id, mark, source and size of each row."""
    id_, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), id_.alias("id"), mark_of(text).alias("mark"), source.alias("source"), words(text).alias("size"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """id, mark (the text's MD5), source, size, source_size, target and copies of each row of docs: floor(rate) copies,
    and one more with the rest of the rate as its probability, drawn by a hash of the id, the text and, for rows that
    repeat both, the row's number among them, source by source; so reruns and lost tasks agree, and any order or
    partitions of the same rows give the same result.

    Null texts have size 0; rows without a source are a source of their own, the last. A source without words has
    rate 0. Rows with equal or null ids draw each for itself. Texts are read once, their sizes written; sizes are
    summed within map tasks first, and the table of sources is broadcast if it is small, so that rows stay where they
    are, and else joined by a shuffle. Empty tables give no rows; other columns are not read."""
    sizes = persisted(_keyed(docs, id_col, text_col, source_col).drop("doc"), lasting=True)
    return _planned(sizes, sizes, weights, most, seed)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as copies() says, with the columns of docs, whatever their names. Which
    of the rows that repeat id, text and source gets which of their numbers follows the rows' order; it shows only where
    their other columns differ."""
    keyed = _keyed(docs, id_col, text_col, source_col)
    out = _planned(keyed.drop("doc", "mark"), keyed.drop("size"), weights, most, seed).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
