"""Page layout: positioned lines to logical pages of paragraphs.

lines(book, page, line_no, text, y, min_x, max_x, width, font_size, page_w, page_h). All windows are within a page, so
rows are spread by (book, page) and one exchange on these keys serves the whole chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.operators.ranges import running

PAGE = ("book", "page")
COLUMN = ("book", "page", "col")


def scanned(raw: DataFrame) -> DataFrame:
    """Line selections (y from the page's bottom, height) as lines: trimmed, non-empty, y from the top, font size three
    quarters of the height and 1 at least, numbered by (y, min_x) within the page."""
    df = raw.withColumn("text", F.trim("text")).where("text <> ''")
    df = df.withColumn("y", F.col("page_h") - F.col("y") - F.col("height")).withColumn("font_size", F.greatest(F.lit(1.0), F.col("height") * 0.75)).withColumn("max_x", F.col("min_x") + F.col("width"))
    return df.withColumn("line_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("y", "min_x", "text")) - 1)


def in_rectangle(lines: DataFrame, low: Column, high: Column) -> DataFrame:
    """The lines whose middle is within a band of the page, for pages read by halves."""
    middle = (F.col("min_x") + F.col("max_x")) / 2
    return lines.where((middle >= low) & (middle < high))


def superscripts_joined(lines: DataFrame) -> DataFrame:
    """Numbers of one to three digits that stand less than 6 points above a line of more than ten characters, within it,
    become part of it: `!n` after it if they are in its right half, else before it. Each joins the first such line."""
    keys = [F.col(k) for k in PAGE]
    small = lines.where(F.trim("text").rlike(r"^\d{1,3}$")).select(*keys, F.col("line_no").alias("s_no"), F.trim("text").alias("s_text"), F.col("y").alias("s_y"), F.col("min_x").alias("s_low"), F.col("max_x").alias("s_high"))
    body = lines.where(F.length("text") > 10)
    near = small.join(body, list(PAGE)).where("y - s_y > 0 AND y - s_y < 6 AND s_low >= min_x - 2 AND s_low <= max_x + 5 AND line_no <> s_no")
    one = near.groupBy(*PAGE, "s_no").agg(F.min_by(F.struct("line_no", "s_text", "s_low", "s_high", ((F.col("s_low") + F.col("s_high")) > (F.col("min_x") + F.col("max_x"))).alias("right")), "line_no").alias("m"))
    marks = one.groupBy(*PAGE, F.col("m.line_no").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.when(F.col("m.right"), F.struct("s_no", F.col("m.s_text").alias("t"))))).alias("after"),
        F.reverse(F.array_sort(F.collect_list(F.when(~F.col("m.right"), F.struct("s_no", F.col("m.s_text").alias("t")))))).alias("before"),
        F.max(F.when(F.col("m.right"), F.col("m.s_high"))).alias("far"),
        F.min(F.when(~F.col("m.right"), F.col("m.s_low"))).alias("near"),
    )
    text = F.concat(F.array_join(F.transform("before", lambda x: F.concat(F.lit("!"), x["t"], F.lit(" "))), ""), F.col("text"), F.array_join(F.transform("after", lambda x: F.concat(F.lit("!"), x["t"])), ""))
    kept = lines.join(one.select(*PAGE, F.col("s_no").alias("line_no")), [*PAGE, "line_no"], "left_anti").join(marks, [*PAGE, "line_no"], "left")
    out = kept.withColumn("text", F.when(F.col("after").isNotNull(), text).otherwise(F.col("text")))
    out = out.withColumn("max_x", F.greatest("max_x", F.coalesce("far", "max_x"))).withColumn("min_x", F.least("min_x", F.coalesce("near", "min_x")))
    return out.withColumn("width", F.col("max_x") - F.col("min_x")).select(lines.columns)


def same_height_joined(lines: DataFrame, gap: float = 0.08, near: float = 2.0) -> DataFrame:
    """Lines within `near` of the height of the first of their group, and no further to its right than a share of the
    page, become one. The group's height and extent grow as it is read, so a page's lines are folded in order."""
    item = F.struct("line_no", "text", "y", "min_x", "max_x", "font_size", "page_w", "page_h")
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kind = "array<struct<line_no: int, text: string, y: double, min_x: double, max_x: double, font_size: double, page_w: double, page_h: double>>"
    fold = f"""aggregate(rows, cast(array() AS {kind}), (a, r) -> CASE
      WHEN size(a) > 0 AND abs(element_at(a, -1).y - r.y) <= {near} AND r.min_x - element_at(a, -1).max_x <= r.page_w * {gap}
      THEN concat(slice(a, 1, size(a) - 1), array(named_struct('line_no', element_at(a, -1).line_no, 'text', concat(element_at(a, -1).text, r.text), 'y', element_at(a, -1).y,
        'min_x', least(element_at(a, -1).min_x, r.min_x), 'max_x', greatest(element_at(a, -1).max_x, r.max_x), 'font_size', greatest(element_at(a, -1).font_size, r.font_size), 'page_w', r.page_w, 'page_h', r.page_h)))
      ELSE concat(a, array(named_struct('line_no', cast(r.line_no AS int), 'text', r.text, 'y', cast(r.y AS double), 'min_x', cast(r.min_x AS double), 'max_x', cast(r.max_x AS double), 'font_size', cast(r.font_size AS double), 'page_w', cast(r.page_w AS double), 'page_h', cast(r.page_h AS double)))) END)"""
    rows = pages.select(*PAGE, F.inline(F.expr(fold)))
    return rows.withColumn("width", F.col("max_x") - F.col("min_x")).select(lines.columns)


def columns_split(lines: DataFrame, gutter: bool = True) -> DataFrame:
    """lines with col: 0, or on landscape pages of six lines or more with two columns 0 (left) and 1 (right). Two columns
    need three lines each and few lines across the middle, which are left out; else, if `gutter`, halves that leave
    out 2 % of the page in the middle, with three lines each."""
    middle = (F.col("min_x") + F.col("max_x")) / 2
    w = W.partitionBy(*PAGE)
    side = lambda room: F.when(middle < F.col("page_w") / 2 - room, 0).when(middle > F.col("page_w") / 2 + room, 1)
    df = lines.withColumn("_n", F.count("*").over(w)).withColumn("_side", side(F.col("page_w") * 0.05)).withColumn("_half", side(F.col("page_w") * 0.01))
    number = lambda c, v: F.count_if(F.col(c) == v).over(w)
    wide = (F.col("page_w") > F.col("page_h") * 1.1) & (F.col("_n") >= 6)
    df = df.withColumn("_two", wide & (number("_side", 0) >= 3) & (number("_side", 1) >= 3) & (F.count_if(F.col("_side").isNull()).over(w) <= F.greatest(F.lit(2), F.floor(F.col("_n") / 10))))
    df = df.withColumn("_halves", F.lit(gutter) & wide & ~F.col("_two") & (number("_half", 0) >= 3) & (number("_half", 1) >= 3))
    col = F.when(F.col("_two"), F.col("_side")).when(F.col("_halves"), F.col("_half")).otherwise(F.lit(0))
    return df.withColumn("col", col).where("col IS NOT NULL").select(*lines.columns, "col")


def page_number_line(text: Column | str) -> Column:
    s = F.trim(F.col(text) if isinstance(text, str) else text)
    return (F.length(s) <= 6) & s.rlike(r"^[\divxlcdmIVXLCDM]+$")


def page_numbers_stripped(lines: DataFrame) -> DataFrame:
    """Lines without the page numbers at either end of their column, as long as three lines are left."""
    w = W.partitionBy(*COLUMN)
    df = lines.withColumn("_i", F.row_number().over(w.orderBy("line_no")) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_number", page_number_line("text"))
    first = F.coalesce(F.min(F.when(~F.col("_number"), F.col("_i"))).over(w), F.col("_n"))
    last = F.coalesce(F.max(F.when(~F.col("_number"), F.col("_i"))).over(w), F.lit(-1))
    df = df.withColumn("_lead", F.greatest(F.lit(0), F.least(first, F.col("_n") - 3))).withColumn("_trail", F.greatest(F.lit(0), F.least(F.col("_n") - 1 - last, F.col("_n") - F.col("_lead") - 3)))
    return df.where("_i >= _lead AND _i < _n - _trail").select(lines.columns)


def sentence_start(text: Column) -> Column:
    return F.trim(text).rlike(r"""^[\p{Lu}\p{N}"'\x{201C}\x{2018}]""")


def sentence_end(text: Column) -> Column:
    return F.trim(text).rlike(r"""[.!?]["'\x{201D}\x{2019})\]]?$""")


def continuation_end(text: Column) -> Column:
    return F.trim(text).rlike(r"""[,;:\x{2014}\-]["'\x{201D}\x{2019})\]]?$""")


def heading(text: Column, font: Column, width: Column, fonts: Column, widths: Column) -> Column:
    t = F.trim(text)
    return (F.length(t).between(1, 90)) & ~t.rlike("[/,;]") & (F.regexp_count(t, F.lit(r"\S+")).between(1, 10)) & ((font >= fonts * 1.05) | (width <= widths * 0.68))


def joined(parts: Column) -> Column:
    """Lines of a paragraph as one: with blanks, or without the hyphen that a line ends with."""
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, "\x01"), r"(?<=[^ ])-\x01", ""), "\x01", " ")


def paragraphs(lines: DataFrame) -> DataFrame:
    """book, page, col, par, text: the paragraphs of each column.

    A paragraph begins after a gap of 1.6 times the usual one (2.8 times in the middle of a sentence), at an indented or
    after a short line between sentences, and after a heading. The usual gap is the median of those up to 1.35 times
    the median of all, 8 at least."""
    w, o = W.partitionBy(*COLUMN), W.partitionBy(*COLUMN).orderBy("line_no")
    df = lines.withColumn("_gap", F.abs(F.col("y") - F.lag("y").over(o))).withColumn("_fair", F.when((F.col("_gap") > 0.5) & (F.col("_gap") < 180), F.col("_gap")))
    df = df.withColumn("_middle", F.coalesce(F.median("_fair").over(w), F.lit(12.0)))
    usual = F.greatest(F.lit(8.0), F.coalesce(F.median(F.when(F.col("_fair") <= F.col("_middle") * 1.35, F.col("_fair"))).over(w), F.median("_fair").over(w), F.lit(12.0)))
    df = df.withColumn("_usual", usual).withColumn("_left", F.median("min_x").over(w)).withColumn("_widths", F.greatest(F.lit(1.0), F.median("width").over(w))).withColumn("_fonts", F.greatest(F.lit(1.0), F.median("font_size").over(w)))
    before = {c: F.lag(c).over(o) for c in ("text", "width", "font_size")}
    starts, ends = sentence_start(F.col("text")), sentence_end(before["text"])
    going_on = ~ends | continuation_end(before["text"])
    breaks = (
        ((F.col("_gap") >= F.col("_usual") * 1.6) & (~going_on | (F.col("_gap") >= F.col("_usual") * 2.8)))
        | ((F.col("min_x") - F.col("_left") >= F.greatest(F.lit(8.0), F.col("_fonts") * 0.9)) & starts & ends)
        | ((before["width"] <= F.col("_widths") * 0.72) & ends & starts)
        | (heading(before["text"], before["font_size"], before["width"], F.col("_fonts"), F.col("_widths")) & starts & (F.col("width") >= F.col("_widths") * 0.65))
    )
    df = df.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("par", F.sum("_break").over(o))
    parts = F.expr("transform(array_sort(collect_list(struct(line_no, text))), x -> x.text)")
    out = df.groupBy(*COLUMN, "par").agg(F.trim(joined(parts)).alias("text"))
    return out.where("text <> ''")


def page_texts(pars: DataFrame) -> DataFrame:
    """book, page, col, text: paragraphs joined by blank lines."""
    return pars.groupBy(*COLUMN).agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(par, text))), x -> x.text)"), "\n\n").alias("text"))


def with_continuations(pages: DataFrame) -> DataFrame:
    """pages (book, page, col, text, footnotes, continuation): what continues a note in the right column goes to the left
    column's last footnote (and is lost if that has none); the left column's stays."""
    w = W.partitionBy(*PAGE).orderBy("col")
    df = pages.withColumn("_more", F.when(F.lead("col").over(w) == 1, F.lead("continuation").over(w)))
    longer = F.expr("concat(slice(footnotes, 1, size(footnotes) - 1), array(named_struct('number', element_at(footnotes, -1).number, 'text', concat(element_at(footnotes, -1).text, ' ', _more))))")
    df = df.withColumn("footnotes", F.when(F.col("_more").isNotNull() & (F.size("footnotes") > 0), longer).otherwise(F.col("footnotes")))
    return df.withColumn("continuation", F.when(F.col("col") == 0, F.col("continuation"))).select(pages.columns)


def numbered(pages: DataFrame) -> DataFrame:
    """pages with page_idx, the place among a book's logical pages, counted by ranges of pages."""
    return running(pages, ["book"], ["page", "col"], page_idx=F.lit(1)).withColumn("page_idx", F.col("page_idx").cast("int"))


def without_references(text: Column, numbers: Column) -> Column:
    """A text without note numbers, up to five above the highest defined, between a word or mark and a letter."""
    most = F.array_max(numbers) + 5
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<=[\p{L}.,;:!?\x{201D}\x{2019}\")])(\d{1,3})(?=\s*\p{L})"), F.lit(1))), lambda n: n.cast("int").between(1, most))
    return F.when(F.size(numbers) > 0, F.aggregate(found, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<=[\p{L}.,;:!?\x{201D}\x{2019}\")])"), n, F.lit(r"(?=\s*\p{L})")), F.lit("")))).otherwise(text)


#: Words that recognition splits after their first letter, and words that it splits elsewhere.
SPLIT_WORDS = ("o f", "i n", "i t", "o n", "i s", "a t", "a s", "b e", "b y", "t o", "o r", "a n")
KNOWN_JOINS = {
    "micro scopic": "microscopic", "strat egy": "strategy", "philos ophy": "philosophy", "philos opher": "philosopher", "knowl edge": "knowledge",
    "al chemy": "alchemy", "al chemical": "alchemical", "al chemist": "alchemist", "ex periment": "experiment", "ex perimental": "experimental",
    "in terpret": "interpret", "inter pretation": "interpretation", "mech anical": "mechanical", "mech anism": "mechanism", "math ematical": "mathematical",
    "math ematics": "mathematics", "dem onstration": "demonstration", "cor respondence": "correspondence", "phenom ena": "phenomena", "grav itation": "gravitation",
}
#: Where a run of word characters can begin: at a word's start, or where the match before has ended. With possessive
#: runs, this finds what `(\w{n,})` finds without trying each place of a long word.
RUN = r"(?:\G|(?<!\w))"


def ocr_cleaned(text: Column, aggressive: bool = False, joins: dict[str, str] | None = None) -> Column:
    """A text with split words put together: between two words of two characters or more, or one of three and one of any
    length, each word's three rules in one pass each; and known joins in any case, in lower case. aggressive: also
    without stray symbols, symbols at either end of words, and paragraphs that are garbage."""
    whole = text
    for split in SPLIT_WORDS:
        for before, after in ((RUN + r"(\w{2,}+)", r"(\w{2,})"), (RUN + r"(\w{3,}+)", r"(\w)"), (r"(\w)", r"(\w{3,})")):
            whole = F.regexp_replace(whole, f"(?U){before} {split} {after}", f"$1 {split.replace(' ', '')} $2")
    text = F.when(text.rlike(f" (?:{'|'.join(SPLIT_WORDS)}) "), whole).otherwise(text)
    for split, word in (KNOWN_JOINS if joins is None else joins).items():
        text = F.regexp_replace(text, f"(?iu){split}", word)
    if not aggressive:
        return text
    text = F.regexp_replace(text, r"(?Um)(?:^|\s)[^\w\s]{1,4}(?=\s|$)", " ")
    text = F.regexp_replace(text, r"(?Um)(?:^|\s)[^\w\s]{1,3}(\w{3,})", " $1")
    text = F.regexp_replace(text, rf"(?U){RUN}(\w{{2,}}+)[^\w\s]{{1,3}}(?=\s|$)", "$1")
    text = F.regexp_replace(text, r"'11(?=[ \n])", "'ll")
    text = F.regexp_replace(text, " {2,}", " ")
    pars = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""))
    return F.array_join(F.filter(pars, lambda p: (p != "") & ~garbage(p)), "\n\n")


def garbage(paragraph: Column) -> Column:
    """Three characters or fewer without a letter or digit, or under a hundred of which fewer than half are letters,
    digits or blanks. A letter with its marks is one character."""
    n, plain = F.regexp_count(paragraph, F.lit(r"\X")), F.regexp_count(paragraph, F.lit(r"(?U)(?=[\p{IsAlphabetic}\p{N}\s])\X"))
    return ((n <= 3) & (plain == F.regexp_count(paragraph, F.lit(r"(?U)\s")))) | ((n < 100) & (plain < F.floor(n / 2)))


def logical_pages(lines: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Lines to logical pages: book, page, col, text, footnotes, continuation, page_idx. Texts are cleaned of what
    recognition splits, if their page has more lines than one; aggressively in books whose profile(book, book_type,
    prefer_content, global_font) says that they are scanned."""
    from leafweave.operators import footnotes

    steps = (superscripts_joined, same_height_joined, columns_split, page_numbers_stripped)
    rows = reduce(lambda df, f: f(df), steps, lines)
    body, notes = footnotes.separated(rows, profile)
    texts = page_texts(paragraphs(body))
    every = rows.groupBy(*COLUMN).agg((F.count("*") > 1).alias("_several"))
    every = every.join(profile.select("book", (F.col("book_type") == "scannedOCR").alias("_scan")), "book", "left") if profile is not None else every.withColumn("_scan", F.lit(False))
    cleaned = F.when(F.col("_several") & F.col("_scan"), ocr_cleaned(F.col("text"), True)).when(F.col("_several"), ocr_cleaned(F.col("text"))).otherwise(F.col("text"))
    out = every.join(texts, list(COLUMN), "left").join(notes, list(COLUMN), "left")
    out = out.select(*COLUMN, F.coalesce(cleaned, F.lit("")).alias("text"), F.coalesce("footnotes", F.array().cast("array<struct<number: int, text: string>>")).alias("footnotes"), "continuation")
    return numbered(with_continuations(out))
