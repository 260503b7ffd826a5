"""Fidelity of one version of extracted chapters against another, and the regression gate.

predicted and native are chapters(book, title, text, start_page, is_back_matter, footnotes, footnote_references) with
whichever of these a dimension reads. Each dimension returns book and score for the books that it can score."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafweave.functions import text as T

#: The weights of the eight dimensions, and the score that passes.
WEIGHTS = {
    "chapter_boundaries": 0.18, "chapter_titles": 0.13, "footnote_separation": 0.18, "running_header_clean": 0.09,
    "body_text_completeness": 0.14, "reading_order": 0.09, "back_matter_detection": 0.09, "ocr_quality": 0.10,
}
THRESHOLD, TOLERANCE = 0.90, 0.02


def _f1(matched: Column, of_one: Column, of_two: Column) -> Column:
    p, r = matched / F.nullif(of_one, F.lit(0)), matched / F.nullif(of_two, F.lit(0))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _books(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [t.select("book") for t in tables]).distinct()


def chapter_boundaries(predicted: DataFrame, native: DataFrame, clamp: bool = True) -> DataFrame:
    """F1 of distinct start pages, one page off allowed. clamp: at most 1 (several predictions may meet one page)."""
    p, n = predicted.select("book", "start_page").distinct(), native.select("book", "start_page").distinct()
    near = n.select("book", F.explode(F.array(F.col("start_page") - 1, "start_page", F.col("start_page") + 1)).alias("start_page")).distinct()
    counts = p.groupBy("book").agg(F.count("*").alias("p")).join(n.groupBy("book").agg(F.count("*").alias("n")), "book", "full")
    counts = counts.join(p.join(near, ["book", "start_page"], "left_semi").groupBy("book").agg(F.count("*").alias("m")), "book", "left").fillna(0)
    score = _f1(F.col("m"), F.col("n"), F.col("p"))
    return counts.select("book", (F.least(score, F.lit(1.0)) if clamp else score).alias("score"))


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Each predicted title, in order, takes the best of the native ones left; of equals the first."""
    used: set[int] = set()
    total = 0.0
    for _, some in pairs.sort_values(["i", "j"]).groupby("i", sort=True):
        left = some[~some["j"].isin(used)]
        if len(left) and (best := left.loc[left["s"].idxmax()])["s"] > 0:
            used.add(best["j"])
            total += best["s"]
    return pd.DataFrame({"book": [pairs["book"].iloc[0]], "total": [total]})


def chapter_titles(predicted: DataFrame, native: DataFrame) -> DataFrame:
    """Greedy fuzzy matching of titles in the order of start pages, over the longer list. A book's titles are few."""
    order = lambda df: df.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("start_page", "title"))).alias("t"))
    p, n = order(predicted), order(native)
    longest = p.join(n.select("book", F.col("t").alias("u")), "book", "full").select("book", F.coalesce(F.size("t"), F.lit(0)).alias("p"), F.coalesce(F.size("u"), F.lit(0)).alias("n"))
    pairs = p.select("book", F.posexplode("t").alias("i", "a")).join(n.select("book", F.posexplode("t").alias("j", "b")), "book")
    matched = pairs.select("book", "i", "j", T.title_match("a.title", "b.title").alias("s")).groupBy("book").applyInPandas(_greedy, "book string, total double")
    return longest.join(matched, "book", "left").select("book", F.when((F.col("p") == 0) | (F.col("n") == 0), 0.0).otherwise(F.coalesce("total", F.lit(0.0)) / F.greatest("p", "n")).alias("score"))


def footnote_separation(predicted: DataFrame, native: DataFrame) -> DataFrame:
    """0.6 times the share of footnotes that are in no body (of chapters without notes), and 0.4 times that of references
    whose number isn't joined to a word near their context."""
    notes = predicted.select("book", F.posexplode("footnotes").alias("k", "f"), F.monotonically_increasing_id().alias("c")).select("book", "c", "k", F.substring("f.text", 1, 50).alias("note")).where(F.length("note") >= 10)
    bodies = native.where(F.coalesce(F.size("footnotes"), F.lit(0)) <= 0).select("book", F.col("text").alias("body"))
    leaks = notes.join(bodies, (notes.book == bodies.book) & F.contains(F.col("body"), F.substring("note", 1, 30)), "left_semi")
    leak = notes.groupBy("book").agg(F.count("*").alias("checked")).join(leaks.groupBy("book").agg(F.count("*").alias("leaked")), "book", "left").select("book", (1 - F.coalesce("leaked", F.lit(0)) / F.col("checked")).alias("leak"))
    whole = native.groupBy("book").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(start_page, text))), x -> x.text)"), "\n").alias("whole"))
    refs = predicted.select("book", F.explode("footnote_references").alias("r")).select("book", "r.number", "r.nearText").where(F.length("nearText") >= 5)
    context = F.get(F.filter(F.split(F.regexp_replace("nearText", r"[¹²³⁴⁵⁶⁷⁸⁹⁰\d]", ""), r"\s+"), lambda w: F.length(w) > 3), F.lit(0))
    refs = refs.join(whole, "book", "left").withColumn("word", F.lower(context))
    refs = refs.withColumn("at", F.expr("CASE WHEN word IS NULL THEN 0 ELSE locate(word, lower(whole)) END"))
    near = F.expr("substring(whole, greatest(at - 50, 1), least(at - 1, 50) + 100)")
    n = F.regexp_replace("number", r"([^\w\s])", r"\\$1")
    fused = F.regexp_like(near, F.concat(F.lit("[a-zA-Z]"), n, F.lit(r"[a-zA-Z]|[a-zA-Z]"), n, F.lit(r"\s")))
    ref = refs.groupBy("book").agg(F.avg(F.when((F.coalesce("at", F.lit(0)) > 0) & fused, 0.0).otherwise(1.0)).alias("clean"))
    return _books(predicted, native).join(leak, "book", "left").join(ref, "book", "left").select("book", (0.6 * F.coalesce("leak", F.lit(1.0)) + 0.4 * F.coalesce("clean", F.lit(1.0))).alias("score"))


def running_header_clean(annotations: DataFrame, native: DataFrame) -> DataFrame:
    """1 less a hundred times the share of body lines that are a running header (digits aside)."""
    headers = annotations.select("book", F.explode("regions").alias("r")).where("r.type = 'running_header'").select("book", F.trim("r.text").alias("h")).where(F.length("h") > 5).distinct()
    rows = native.select("book", F.explode(F.split("text", "\n")).alias("line")).select("book", F.trim("line").alias("line"))
    counted = rows.groupBy("book", "line").agg(F.count("*").alias("c"))
    forms = counted.select("book", "c", F.explode(F.array_distinct(F.array("line", F.trim(F.regexp_replace("line", r"\d+", ""))))).alias("h"))
    hits = forms.join(headers, ["book", "h"], "left_semi").groupBy("book").agg(F.sum("c").alias("hits"))
    total = counted.groupBy("book").agg(F.sum("c").alias("lines"))
    return total.join(hits, "book", "left").select("book", F.greatest(F.lit(0.0), 1 - 100 * F.coalesce("hits", F.lit(0)) / F.col("lines")).alias("score"))


def body_text_completeness(predicted: DataFrame, native: DataFrame) -> DataFrame:
    total = lambda df, c: df.groupBy("book").agg(F.sum(T.token_count("text")).alias(c))
    both = total(predicted, "p").join(total(native, "n"), "book", "full").fillna(0)
    score = F.when((F.col("p") == 0) & (F.col("n") == 0), 1.0).when(F.col("p") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(1 - F.col("n") / F.nullif("p", F.lit(0)))))
    return both.select("book", score.alias("score"))


def reading_order(annotations: DataFrame, native: DataFrame) -> DataFrame:
    """Of two-column pages with two body regions or more, the share whose first five words (ten characters) are in the body."""
    two = annotations.where("layout = 'two_column'").select("book", "page", F.posexplode("regions").alias("k", "r")).where("r.type = 'body'")
    first = two.groupBy("book", "page").agg(F.count("*").alias("n"), F.min_by("r.text", F.struct(F.coalesce("r.readingOrder", F.lit(0)).alias("o"), "k")).alias("t")).where("n >= 2")
    first = first.select("book", "page", F.array_join(F.slice(F.split("t", r"\s+"), 1, 5), " ").alias("w")).where(F.length("w") >= 10)
    bodies = native.select(F.col("book").alias("b"), "text")
    found = first.join(bodies, (F.col("book") == F.col("b")) & F.contains("text", F.col("w")), "left_semi").select("book", "page", F.lit(1).alias("hit"))
    scores = first.join(found, ["book", "page"], "left").groupBy("book").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("s"))
    return _books(annotations, native).join(scores, "book", "left").select("book", F.coalesce("s", F.lit(1.0)).alias("score"))


#: Words in a title that make a chapter back matter.
BACK_MATTER = ("bibliography", "index", "appendix", "notes", "references")


def back_matter_detection(predicted: DataFrame, native: DataFrame) -> DataFrame:
    titled = F.coalesce(F.lower("title").rlike("|".join(BACK_MATTER)), F.lit(False))
    p = predicted.groupBy("book").agg(F.count_if("is_back_matter").alias("p"))
    n = native.groupBy("book").agg(F.count_if(F.coalesce("is_back_matter", F.lit(False)) | titled).alias("n"))
    both = p.join(n, "book", "full").fillna(0)
    score = F.when((F.col("p") == 0) & (F.col("n") == 0), 1.0).when(F.col("p") == 0, 0.5).when(F.col("n") == 0, 0.0).otherwise(_f1(F.least("p", "n"), F.col("n"), F.col("p")))
    return both.select("book", score.alias("score"))


def ocr_quality(native: DataFrame) -> DataFrame:
    sums = native.groupBy("book").agg(F.sum(T.odd_characters("text", T.ORDINARY_WIDE)).alias("odd"), F.sum(F.length("text")).alias("all"))
    return sums.select("book", F.when(F.coalesce("all", F.lit(0)) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 10 * F.col("odd") / F.nullif("all", F.lit(0)))).alias("score"))


def fidelity(predicted: DataFrame, native: DataFrame, annotations: DataFrame) -> DataFrame:
    """book, dimension, score, weight, weighted of all eight dimensions."""
    scores = {
        "chapter_boundaries": chapter_boundaries(predicted, native), "chapter_titles": chapter_titles(predicted, native),
        "footnote_separation": footnote_separation(predicted, native), "running_header_clean": running_header_clean(annotations, native),
        "body_text_completeness": body_text_completeness(predicted, native), "reading_order": reading_order(annotations, native),
        "back_matter_detection": back_matter_detection(predicted, native), "ocr_quality": ocr_quality(native),
    }
    long = reduce(DataFrame.unionByName, [df.select("book", F.lit(k).alias("dimension"), "score") for k, df in scores.items()])
    return weighted(long)


def weighted(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """scores (book, dimension, score) with weight and weighted."""
    weights = weights or WEIGHTS
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("dimension"))
    return scores.withColumn("weight", weight).withColumn("weighted", F.col("weight") * F.col("score"))


def overall(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.groupBy("book").agg(F.sum("weighted").alias("overall")).withColumn("pass", F.col("overall") >= threshold)


def gate(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """current and baseline (book, dimension, score; `overall` is a dimension too) -> book, dimension, score, baseline,
    delta, status: regression below -tolerance, improved above it, else passed. Dimensions without a baseline aren't held."""
    both = baseline.select("book", "dimension", F.col("score").alias("baseline")).join(current.select("book", "dimension", "score"), ["book", "dimension"])
    both = both.withColumn("delta", F.col("score") - F.col("baseline"))
    return both.withColumn("status", F.when(F.col("delta") < -tolerance, "regression").when(F.col("delta") > tolerance, "improved").otherwise("passed"))


def gate_summary(gated: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("regression", "improved", "passed")]
    return gated.groupBy("book").agg(*counts, F.min("delta").alias("worst")).withColumn("ok", F.col("regression") == 0)


def report(scored: DataFrame) -> DataFrame:
    """book, dimension, line: the console report."""
    mark = F.when(F.col("score") >= 0.80, "PASS").otherwise("FAIL")
    return scored.select("book", "dimension", F.format_string("  %s %s %6.2f%% (weight %.2f)", mark, F.rpad("dimension", 24, " "), F.col("score") * 100, F.col("weight")).alias("line"))


def dice_pairs(texts: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """one, two, dice: functions.text.dice of every two texts (one < two), found through shared letter pairs; 0 for those
    that share none, null with a null text."""
    t = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t")).withColumn("n", F.greatest(F.length("t") - 1, F.lit(1)))
    pairs = F.when(F.length("t") < 2, F.array("t")).otherwise(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.substring(F.col("t"), i, F.lit(2))))
    g = t.select("id", F.explode(pairs).alias("g")).groupBy("id", "g").agg(F.count("*").alias("c"))
    common = g.alias("a").join(g.alias("b"), F.expr("a.g = b.g AND a.id < b.id")).groupBy(F.col("a.id").alias("one"), F.col("b.id").alias("two")).agg(F.sum(F.least("a.c", "b.c")).alias("common"))
    both = t.alias("a").join(t.alias("b"), F.expr("a.id < b.id")).select(F.col("a.id").alias("one"), F.col("b.id").alias("two"), F.expr("a.t = b.t").alias("same"), F.expr("a.n + b.n").alias("n"))
    dice = F.when(F.col("same"), F.lit(1.0)).when(F.col("same").isNotNull(), 2.0 * F.coalesce("common", F.lit(0)) / F.col("n"))
    return both.join(common, ["one", "two"], "left").select("one", "two", dice.alias("dice"))
