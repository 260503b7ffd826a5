"""Footnotes at the foot of a column: seven strategies for where they begin, two checks, and their parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.operators.layout import COLUMN, joined

#: How a note begins, and what academic citations look like.
NOTE = r"^(\d{1,3})[.\s]"
CITATION = r"([Ii]bid\.?|[Cc]f\.|op\.?\s*cit|supra|infra|[Pp]p?\.\s*\d|[Vv]ol\.\s*[IVX\d]|\(\d{4}\)|\bn\.\s*\d)"


def starts(lines: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """lines (with col) with i, n and start: where the footnotes of the column begin (null: none), and strategy (1 to 7).

    profile(book, prefer_content, global_font) turns on the strategies that look at content. The first four are tried
    line by line, the others in turn; walks back over lines that continue a note are closed forms: the place after the
    last line that stops the walk."""
    w, o = W.partitionBy(*COLUMN), W.partitionBy(*COLUMN).orderBy("line_no")
    df = lines
    if profile is not None:
        df = df.join(profile.select("book", "prefer_content", "global_font"), "book", "left")
    else:
        df = df.withColumn("prefer_content", F.lit(False)).withColumn("global_font", F.lit(None).cast("double"))
    df = df.withColumn("prefer", F.coalesce("prefer_content", F.lit(False))).withColumn("i", F.row_number().over(o) - 1).withColumn("n", F.count("*").over(w))
    df = df.withColumn("t", F.trim("text")).withColumn("num", F.col("t").rlike(NOTE)).withColumn("cite", F.col("t").rlike(CITATION)).withColumn("bucket", F.round(F.col("font_size") * 10).cast("int"))
    df = df.withColumn("_c", F.when(F.col("font_size") > 3, F.count("*").over(W.partitionBy(*COLUMN, "bucket"))))
    mode = F.max(F.when(F.col("_c").isNotNull(), F.struct("_c", "bucket"))).over(w)["bucket"] / 10
    df = df.withColumn("font", F.coalesce(mode, F.lit(10.0)))
    df = df.withColumn("font", F.when(F.col("prefer") & (F.col("font") < F.col("global_font") * 0.95), F.col("global_font")).otherwise(F.col("font")))
    df = df.withColumn("gap", F.abs(F.col("y") - F.lag("y").over(o)))
    body = F.round(F.col("font") * 10).cast("int")
    df = df.withColumn("_body_gap", F.when((F.col("bucket") == body) & (F.lag("bucket").over(o) == body) & (F.col("gap") > 0.5) & (F.col("gap") < 50), F.col("gap")))
    df = df.withColumn("usual", F.coalesce(F.median("_body_gap").over(w), F.lit(12.0)))
    last_num = F.max(F.when(F.col("num"), F.col("i"))).over(w)
    small = lambda share: F.col("font_size") < F.col("font") * share
    rule = (
        F.when(F.col("num") & (F.col("gap") >= F.col("usual") * 1.2), 1).when(F.col("num") & small(0.92), 2)
        .when((F.col("gap") >= F.col("usual") * 1.5) & small(0.92), 3).when((F.col("y") > F.col("page_h") * 0.65) & small(0.88) & (last_num >= F.col("i")), 4)
    )
    df = df.withColumn("_first", F.min(F.when((F.col("i") >= 1) & rule.isNotNull(), F.struct("i", rule.alias("rule")))).over(w))
    low = F.floor(F.col("n") * F.when(F.col("prefer"), 0.5).otherwise(0.4)).cast("int")
    half = F.floor(F.col("n") * 0.5).cast("int")
    down = W.partitionBy(*COLUMN, "_in5").orderBy("i")
    df = df.withColumn("_low", low).withColumn("_half", half).withColumn("_in5", F.col("num") & (F.col("i") >= F.greatest(F.lit(1), low)))
    neighbour = (F.col("i") - F.lag("i").over(down) <= 3) | (F.lead("i").over(down) - F.col("i") <= 3)
    df = df.withColumn("_pair", F.min(F.when(F.col("_in5") & neighbour, F.col("i"))).over(w)).withColumn("_nums", F.count_if("_in5").over(w))
    alone = F.min(F.when(F.col("_in5") & F.col("cite"), F.col("i"))).over(w)
    stop5 = F.max(F.when((F.col("i") < F.col("_pair")) & ((F.col("i") < F.col("_low")) | (~F.col("num") & (F.length("t") > 80))), F.col("i"))).over(w)
    df = df.withColumn("_five", F.when(F.col("prefer") & (F.col("_nums") == 1), alone).when(F.col("_nums") >= 2, F.when(F.col("_pair").isNotNull(), F.coalesce(stop5 + 1, F.lit(0)))))
    df = df.withColumn("_cited", F.min(F.when(F.col("num") & F.col("cite") & (F.col("i") >= F.greatest(F.lit(1), F.col("_half"))), F.col("i"))).over(w))
    stop6 = F.max(F.when((F.col("i") < F.col("_cited")) & ((F.col("i") < F.col("_half")) | (~F.col("num") & ~F.col("cite") & (F.length("t") > 80))), F.col("i"))).over(w)
    df = df.withColumn("_six", F.when(F.col("_cited").isNotNull(), F.coalesce(stop6 + 1, F.lit(0))))
    rest = o.rowsBetween(0, W.unboundedFollowing)
    seven = F.col("prefer") & (F.col("gap") >= F.col("usual") * 2) & small(0.95) & (F.col("i") >= F.floor(F.col("n") / 2)) & (F.count_if("cite").over(rest) > 0) & (F.count_if(small(0.95)).over(rest) / F.count("*").over(rest) >= 0.5)
    df = df.withColumn("_seven", F.min(F.when(seven & (F.col("i") >= 1), F.col("i"))).over(w))
    start = F.coalesce("_first.i", "_five", "_six", "_seven")
    which = F.when(F.col("_first").isNotNull(), F.col("_first.rule")).when(F.col("_five").isNotNull(), 5).when(F.col("_six").isNotNull(), 6).when(F.col("_seven").isNotNull(), 7)
    df = df.withColumn("start", F.when(F.col("n") > 3, start)).withColumn("strategy", F.when(F.col("n") > 3, which))
    above, below = F.col("i") < F.col("start"), F.col("i") >= F.col("start")
    of_body, of_foot = F.median(F.when(above, F.col("font_size"))).over(w), F.median(F.when(below, F.col("font_size"))).over(w)
    more = F.count_if((F.col("i") > F.col("start")) & F.col("num")).over(w) > 0
    df = df.withColumn("_body", F.coalesce(of_body, F.col("font"))).withColumn("_foot", F.coalesce(of_foot, F.col("font")))
    no = ~more & ~(F.col("_foot") < F.col("_body") * 0.92) & (F.count_if(below & F.col("cite")).over(w) == 0) & (F.col("n") - F.col("start") > 3)
    no = no | (of_foot >= F.coalesce(of_body, F.lit(10.0)) * 1.15)
    df = df.withColumn("_no", F.coalesce(no, F.lit(False))).withColumn("body_font", F.coalesce(of_body, F.lit(10.0)))
    df = df.withColumn("start", F.when(~F.col("_no"), F.col("start"))).withColumn("strategy", F.when(~F.col("_no"), F.col("strategy")))
    return df.select(*lines.columns, "i", "n", "t", "num", "start", "strategy", "body_font")


def parsed(placed: DataFrame) -> DataFrame:
    """book, page, col, footnotes and continuation of columns that have a start. A number begins a note, lines after it go
    on with it; lines before the first number continue a note from the page before; a page number at the end is skipped."""
    foot = placed.where("i >= start AND t <> ''").where(~((F.col("i") == F.col("n") - 1) & F.col("t").rlike(r"^[+-]?\d{1,4}$") & (F.length("t") <= 4) & (F.col("font_size") >= F.col("body_font") * 0.85)))
    foot = foot.withColumn("note", F.sum(F.col("num").cast("int")).over(W.partitionBy(*COLUMN).orderBy("i")))
    foot = foot.withColumn("part", F.when(F.col("num"), F.trim(F.regexp_replace("t", NOTE, ""))).otherwise(F.col("t")))
    parts = F.expr("transform(array_sort(collect_list(struct(i, part))), x -> x.part)")
    notes = foot.groupBy(*COLUMN, "note").agg(joined(parts).alias("text"), F.array_join(parts, " ").alias("plain"), F.min_by(F.regexp_extract("t", NOTE, 1), "i").alias("number"))
    each = F.when((F.col("note") > 0) & (F.trim("text") != ""), F.struct("note", F.struct(F.expr("try_cast(number AS int)").alias("number"), F.trim("text").alias("text")).alias("f")))
    return notes.groupBy(*COLUMN).agg(F.array_sort(F.collect_list(each)).alias("_f"), F.max(F.when(F.col("note") == 0, F.trim("plain"))).alias("continuation")).select(*COLUMN, F.expr("transform(_f, x -> x.f)").alias("footnotes"), "continuation")


def separated(lines: DataFrame, profile: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The body lines, and footnotes and continuation by (book, page, col)."""
    placed = starts(lines, profile)
    return placed.where("start IS NULL OR i < start").select(lines.columns), parsed(placed)
