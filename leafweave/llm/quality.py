"""Quality rules with adaptive thresholds, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.llm.common import SPACE, broadcast_if_small, persisted

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Base rules: fewest words, largest share (in hundredths) of words in repeated windows.
FEWEST_WORDS, MOST_REPEAT = 20, 30
#: Measures held against thresholds beyond a group's quartiles, and how far beyond them a threshold is at least.
FENCED = {"symbol_share": 0.05, "word_length": 2.0}
#: Measures that are 0 for most texts, whose quartiles say nothing: held against the group's quantile TOP among texts
#: that pass the base rules, and the least threshold.
RARE, TOP = {"dup_line_share": 0.20, "repeat_share": 0.10}, 0.99
MEASURES = (*FENCED, *RARE)
#: Spreads between the quartiles that a measure may lie beyond them; smallest group with thresholds of its own.
SPREADS, LEAST_ROWS = 4.0, 200
#: Error of the sketches' ranks: one part in so many.
ACCURACY = 10_000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the counts of each row: n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words. Null texts count as empty.

    Windows of eight words are compared by a 64-bit hash of their words' 64-bit hashes, within one text only: in a text of
    n words, two different windows count as one with a probability of n * n / 2 ** 65. Only where a text has a window twice are its windows sorted, with their places, to find the words that repeated windows
    cover: each repeated window adds the words up to the next repeated one, eight at most."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), text.alias("t"))
    trimmed = F.btrim(F.col("t"), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn("words", F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))")).withColumn("lines", F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    some = ", ".join(f"hashes[i + {k}]" if k else "hashes[i]" for k in range(WINDOW))
    df = df.withColumn("windows", F.expr(f"CASE WHEN size(hashes) >= {WINDOW} THEN transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({some})) ELSE cast(array() AS array<bigint>) END"))
    df = df.select(
        "id", "lang", "source", "windows",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    df = df.withColumn("placed", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h, i))) END"))
    df = df.withColumn("again", F.expr("sort_array(transform(filter(placed, (x, k) -> x.h <=> get(placed, k - 1).h OR x.h <=> get(placed, k + 1).h), x -> x.i))"))
    covered = f"aggregate(transform(again, (p, k) -> least({WINDOW}, coalesce(get(again, k + 1) - p, {WINDOW}))), 0, (a, x) -> a + x)"
    return df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("windows", "placed", "again")


def failed() -> Column:
    """Whether a row of measured() fails the base rules."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def thresholds(counts: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source, level (0: both, 1: a language, 3: all), n and for each measure an array: the quartiles of a fenced
    one, the quantile TOP of a rare one (of texts that pass the base rules, as those that fail lie far above). Sketches are
    made within map tasks and merged: a hot group costs its reducer one sketch a task."""
    shares = counts.where("n_words > 0").select(
        "lang", "source",
        (F.col("n_symbols") / F.col("word_chars")).alias("symbol_share"), (F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_share"),
        (F.col("n_repeat_words") / F.col("n_words")).alias("repeat_share"), (F.col("word_chars") / F.col("n_words")).alias("word_length"), failed().alias("failed"),
    )
    sketches = [F.percentile_approx(m, [0.25, 0.75], ACCURACY).alias(m) for m in FENCED]
    sketches += [F.percentile_approx(F.when(~F.col("failed"), F.col(m)), [TOP], ACCURACY).alias(m) for m in RARE]
    return shares.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *sketches).where((F.col("n") >= least_rows) | (F.col("level") == 3))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spreads: float = SPREADS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """id_col, the counts of measured(), base_failed and kept of each row.

    A text fails its base rules with fewer than 20 words, or where over 30 % of its words lie in repeated windows.
    One that passes is kept if its symbol share and word length lie within `spreads` interquartile ranges (or the
    measure's least margin, if that is more) beyond the quartiles of its language and source, and its shares of
    duplicate lines and of words in repeated windows are no higher than the 0.99 quantiles of the base-passing texts
    there (or the least threshold, if that is more). Groups with fewer than least_rows texts use their language's
    quantiles, those of small languages all texts'. Null languages and sources are groups
    like others. Values tied with a limit pass. Repeated rows count each; empty tables give no rows; other columns are
    not read. Counts are made once and written to the shared folder, then read for the sketches and for the filter."""
    counts = persisted(measured(docs, id_col, text_col, lang_col, source_col), lasting=True)
    limits = persisted(thresholds(counts, least_rows))
    out = counts
    for level, name in ((0, "own"), (1, "by_lang")):
        at = limits.where(F.col("level") == level).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.struct(*MEASURES).alias(name))
        on = F.col("lang").eqNullSafe(F.col("l"))
        out = out.join(broadcast_if_small(at), on & F.col("source").eqNullSafe(F.col("s")) if level == 0 else on, "left").drop("l", "s")
    overall = limits.where("level = 3").head()  # one row, or none
    value = lambda m: F.lit(None) if overall is None or overall[m] is None else F.array(*map(F.lit, overall[m]))
    limit = F.coalesce("own", "by_lang", F.struct(*(value(m).cast("array<double>").alias(m) for m in MEASURES)))
    shares = {"symbol_share": F.col("n_symbols") / F.nullif("word_chars", F.lit(0)), "dup_line_share": F.col("n_dup_lines") / F.nullif("n_lines", F.lit(0)), "repeat_share": F.col("n_repeat_words") / F.nullif("n_words", F.lit(0)), "word_length": F.col("word_chars") / F.nullif("n_words", F.lit(0))}
    fits = F.lit(True)
    for m, least in RARE.items():
        fits = fits & (shares[m] <= F.greatest(limit[m][0], F.lit(least)))
    for m, margin in FENCED.items():
        low, high = limit[m][0], limit[m][1]
        room = F.greatest((high - low) * float(spreads), F.lit(margin))
        fits = fits & (shares[m] <= high + room)
        if m == "word_length":
            fits = fits & (shares[m] >= low - room)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & F.coalesce(fits, F.lit(False))).alias("kept"))
