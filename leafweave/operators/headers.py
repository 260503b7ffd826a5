"""Running headers: candidates, fuzzy merging of their counts, and stripping.

pages(book, page_idx, text): paragraphs are parted by blank lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafweave.functions import text as T

#: Pages that a book must exceed, pages that a header is on, words that it has at most, likeness that merges.
LEAST_PAGES, LEAST_COUNT, MOST_WORDS, ALIKE = 10, 3, 10, 0.70


def candidates(pages: DataFrame, breaks: str = "\n\n") -> DataFrame:
    """book, header, count: short paragraphs without page numbers, and what stands before a page number among the first
    words of a long first paragraph; for books of more than ten pages."""
    n = pages.groupBy("book").agg(F.count("*").alias("pages")).where(F.col("pages") > LEAST_PAGES).select("book")
    some = pages.join(n, "book", "left_semi").select("book", "page_idx", F.posexplode(F.split(F.trim("text"), breaks)).alias("nth", "p")).withColumn("p", F.trim("p"))
    short = some.where(T.short_phrase("p")).select("book", T.header_text("p").alias("header")).where(F.length("header") >= 5)
    # Fourteen parts tell of the first eleven words whether others follow; they are bound to a variable, so that the
    # filters that are pushed down do not split a paragraph again for each.
    first = r"array_min(filter(sequence(1, greatest(1, least(size(w) - 1, 11))), j -> regexp_like(get(w, j), '^[0-9]{1,4}$') AND j < size(w) - 1))"
    title = F.expr(rf"get(transform(array(filter(split(p, '\\s+', 14), x -> x <> '')), w -> array_join(slice(w, 1, coalesce({first}, 0)), ' ')), 0)")
    titles = some.where("nth = 0 AND length(p) > 70").select("book", title.alias("header")).where(F.length("header").between(5, 59) & T.short_phrase("header"))
    return short.unionAll(titles).groupBy("book", "header").agg(F.count("*").alias("count"))


def _pairs(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i in range(max(1, len(s) - 1)):
        out[s[i : i + 2]] = out.get(s[i : i + 2], 0) + 1
    return out


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Most frequent first, each candidate takes in the others that are alike. Only those that share a letter pair with it
    are looked at, by an index from pairs to candidates."""
    rows = rows.sort_values(["count", "header"], ascending=[False, True]).reset_index(drop=True)
    low = [h.lower() for h in rows["header"]]
    bags, sizes = [_pairs(s) for s in low], [max(1, len(s) - 1) for s in low]
    index: dict[str, list[tuple[int, int]]] = {}
    for i, bag in enumerate(bags):
        for g, c in bag.items():
            index.setdefault(g, []).append((i, c))
    free, out = [True] * len(rows), []
    for i in range(len(rows)):
        if not free[i]:
            continue
        free[i], common = False, {}
        for g, c in bags[i].items():
            for j, d in index[g]:
                if free[j]:
                    common[j] = common.get(j, 0) + min(c, d)
        total = int(rows["count"][i])
        for j, c in common.items():
            if low[j] == low[i] or 2 * c / (sizes[i] + sizes[j]) > ALIKE:
                free[j] = False
                total += int(rows["count"][j])
        out.append((rows["book"][i], rows["header"][i], total))
    return pd.DataFrame(out, columns=["book", "header", "count"])


def merged(counts: DataFrame) -> DataFrame:
    """book, header, count, with what is alike under the most frequent spelling. A book's different candidates are one group."""
    return counts.groupBy("book").applyInPandas(_merge, counts.select("book", "header", "count").schema)


def running_headers(pages: DataFrame, breaks: str = "\n\n") -> DataFrame:
    """book, header: what stands on three pages or more and has ten words at most."""
    return merged(candidates(pages, breaks)).where((F.col("count") >= LEAST_COUNT) & (F.size(F.split("header", r"\s+")) <= MOST_WORDS)).select("book", "header")


def stripped(pages: DataFrame, headers: DataFrame, breaks: str = "\n\n") -> DataFrame:
    """pages with texts whose paragraphs aren't, or are like, a header, and don't begin with one (with a page number before
    or after it; what is left must be longer than ten characters). Headers are tried longest first; a book's are few and
    go to its pages as one array."""
    lists = headers.groupBy("book").agg(F.sort_array(F.collect_list(F.struct((-F.length("header")).alias("l"), F.col("header").alias("h")))).alias("hs"))
    df = pages.join(lists, "book", "left").withColumn("ps", F.filter(F.transform(F.split("text", breaks), lambda p: F.trim(p)), lambda p: p != ""))
    esc = lambda h: F.concat(F.lit("\\Q"), h, F.lit("\\E"))
    number, apart = r"\d{1,4}", r"(?:\d\s){1,3}\d"
    forms = lambda h: F.concat(F.lit(r"(?i)^(?:"), esc(h), F.lit(rf"\s*\^?\s*(?:{apart}|\d{{0,4}})\s+|(?:{apart}|{number})\s*\^?\s*"), esc(h), F.lit(r"(?:\s+|$))"))
    plain = lambda p: T.header_text(p)
    whole = lambda p: F.exists("hs", lambda h: (h["h"] == plain(p)) | (T.dice(h["h"], plain(p)) > ALIKE))
    first = lambda p: F.get(F.filter("hs", lambda h: F.regexp_like(p, forms(h["h"]))), F.lit(0))["h"]
    rest = lambda p: F.trim(F.regexp_replace(p, forms(first(p)), F.lit("")))
    cut = lambda p: F.when(first(p).isNull(), p).when((F.length(rest(p)) > 10) | (rest(p) == ""), rest(p)).otherwise(p)
    kept = F.filter(F.transform(F.filter("ps", lambda p: ~whole(p)), cut), lambda p: p != "")
    return df.withColumn("text", F.when(F.col("hs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n\n"))).select(pages.columns)
