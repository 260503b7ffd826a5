"""Page annotations: repair, cache lookups, two passes, and their roll-up to chapters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafweave.functions import text as T

REGION = "struct<type: string, readingOrder: int, text: string, column: string, confidence: double>"
REFERENCE = "struct<number: string, nearText: string, column: string>"
SCHEMA = f"""pageNumber int, layout string, isChapterStart boolean, chapterTitle string, isBackMatter boolean, backMatterType string,
hasFootnotes boolean, footnoteNumbers array<string>, footnoteReferences array<{REFERENCE}>, regions array<{REGION}>, _skipped boolean, _parseError boolean"""


def fallback() -> dict[str, Column]:
    """What a page without an annotation gets."""
    no = F.lit(False)
    return {
        "layout": F.lit("single_column"), "isChapterStart": no, "chapterTitle": F.lit(None).cast("string"), "isBackMatter": no, "backMatterType": F.lit(None).cast("string"), "hasFootnotes": no,
        "footnoteNumbers": F.array().cast("array<string>"), "footnoteReferences": F.array().cast(f"array<{REFERENCE}>"), "regions": F.array().cast(f"array<{REGION}>"),
    }


def with_fallback(pages: DataFrame, annotations: DataFrame) -> DataFrame:
    """pages (book, page) left-joined with annotations (book, page, ...): missing ones are marked skipped."""
    found = annotations.withColumn("_found", F.lit(True))
    out = pages.select("book", "page").join(found, ["book", "page"], "left")
    return out.select("book", "page", *(F.coalesce(F.col(c), v).alias(c) for c, v in fallback().items()), F.col("_found").isNull().alias("_skipped"))


def interesting() -> Column:
    """Pages that the second pass looks at again."""
    return F.coalesce(F.col("isChapterStart") | F.col("hasFootnotes") | F.col("isBackMatter") | (F.col("layout") == "two_column"), F.lit(False))


def merged(triage: DataFrame, detail: DataFrame) -> DataFrame:
    """Detailed annotations where there are any, else those of the first pass; both by (book, page)."""
    names = [c for c in triage.columns if c not in ("book", "page")]
    both = triage.join(detail.select("book", "page", F.struct(*names).alias("_detail")), ["book", "page"], "left")
    return both.select("book", "page", *(F.when(F.col("_detail").isNotNull(), F.col(f"_detail.{c}")).otherwise(F.col(c)).alias(c) for c in names))


def cache_key(content_hash: Column, model: Column | str, prompt: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return T.content_key(F.concat_ws(":", content_hash, as_col(model), as_col(prompt)))


def cache_misses(pages: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Pages whose key isn't in the cache: rows to annotate."""
    return pages.join(cache.select(key).distinct(), key, "left_anti")


def _plain(x: str) -> bool:
    """Whether an item of a flat array is a number, a word of JSON or in quotes."""
    return bool(re.fullmatch(r"-?\d+(\.\d+)?|true|false|null", x)) or (x.startswith('"') and x.endswith('"'))


def _loaded(text: str) -> str | None:
    """A JSON text written anew, or None; NaN and infinities are no JSON."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.dumps(json.loads(text, parse_constant=refuse), ensure_ascii=False)
    except ValueError:
        return None


def _unfinished(text: str) -> Iterator[str]:
    """A text that the end has cut off, made whole: first without its last string that isn't followed by another, and a
    name without a value; then, where that is no JSON, without an open string alone, closed from the inside out."""
    s = re.sub(r',?\s*"[^"]*":\s*\Z', "", re.sub(r',?\s*"[^"]*\Z', "", text, count=1), count=1)
    outside = re.sub(r'"(?:\\.|[^"\\])*("|\Z)', "", s, flags=re.S)
    s = re.sub(r",\s*\Z", "", s)
    yield s + "]" * (outside.count("[") - outside.count("]")) + "}" * (outside.count("{") - outside.count("}"))
    s = text
    if len(re.findall(r'(?<!\\)"', s)) % 2:
        s = s[: s.rindex('"')]
    s = re.sub(r'[,{]\s*"[^"]*"\s*:?\s*$', lambda m: m[0][0] if m[0][0] == "{" else "", s)
    s = re.sub(r",\s*$", "", s)
    yield s + _closers(re.sub(r'"(?:\\.|[^"\\])*"', "", s))


def repaired_json(text: str | None) -> str | None:
    """A model's JSON, made whole: without code fences; with bare tokens in flat arrays quoted; and with what is cut off at
    the end dropped or closed. Each step is tried before the next. None where none helps."""
    s = re.sub(r"^```(?:json)?\s*", "", (text or "").strip())
    s = re.sub(r"\n?```\s*$", "", s, count=1, flags=re.M).strip()
    if (good := _loaded(s)) is not None:
        return good

    def quoted(m: re.Match) -> str:
        items = [x.strip() for x in m[1].split(",")]
        return "[" + ", ".join(x if not x or _plain(x) else '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"' for x in items) + "]"

    s = re.sub(r"\[([^\[\]]*)\]", quoted, s) if not re.search(r"\[[^\[\]]*[{}][^\[\]]*\]", s) else re.sub(r"\[([^\[\]{}]*)\]", quoted, s)
    for whole in (s, *_unfinished(s)):
        if (good := _loaded(whole)) is not None:
            return good
    return None


def _closers(outside: str) -> str:
    open_: list[str] = []
    for c in outside:
        if c in "[{":
            open_.append("]" if c == "[" else "}")
        elif c in "]}" and open_:
            open_.pop()
    return "".join(reversed(open_))


def parsed(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """answers with the column annotation (null where the text can't be repaired) in place of the text. Texts that Spark's
    own parser reads stay in the JVM; only the others go through the repair, in Arrow batches."""
    keep = [c for c in answers.columns if c != text_col]
    good = F.try_parse_json(text_col).isNotNull()

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, text_col, pa.array([repaired_json(x) for x in b.column(at).to_pylist()], pa.string()))

    fixed = answers.where(~F.coalesce(good, F.lit(False)))
    both = answers.where(F.coalesce(good, F.lit(False))).unionByName(fixed.mapInArrow(repair, fixed.schema))
    return both.select(*keep, F.from_json(text_col, SCHEMA).alias("annotation"))


def annotate(pages: DataFrame, infer, schema: str) -> DataFrame:
    """The hook for a model: infer takes and gives an iterator of Arrow batches; it is set up once a worker."""
    return pages.mapInArrow(infer, schema)


def answered(requests: DataFrame, model, id_col: str = "id", prompt_col: str = "prompt") -> DataFrame:
    """id_col, text and error of each request. model: a function of no arguments that sets up a worker's model and gives a
    function from a prompt to an answer. A request that fails gets its error in place of a text; the others go on."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        infer = model()
        for b in batches:
            texts, errors = [], []
            for prompt in b.column(1).to_pylist():
                try:
                    text, error = infer(prompt), None
                except Exception as e:  # what one request raises is its own record
                    text, error = None, f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[id_col, "text", "error"])

    return requests.select(id_col, prompt_col).mapInArrow(ask, f"`{id_col}` {requests.schema[id_col].dataType.simpleString()}, text string, error string")


def chapter_of(pages: DataFrame) -> DataFrame:
    """pages (book, page, is_start, title, ...) -> with chapter_start and chapter_title. Pages before a book's first start
    go; a book without any is one chapter, `Full Text`, from its first page on."""
    w = W.partitionBy("book").orderBy("page")
    own = F.when(F.col("is_start"), F.struct(F.col("page").alias("p"), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Chapter (page "), F.col("page").cast("string"), F.lit(")"))).alias("t")))
    out = pages.withColumn("_at", F.last(own, ignorenulls=True).over(w)).withColumn("_any", F.max(F.coalesce("is_start", F.lit(False))).over(W.partitionBy("book"))).withColumn("_first", F.min("page").over(W.partitionBy("book")))
    out = out.where("_at IS NOT NULL OR NOT _any")
    return out.select(*pages.columns, F.coalesce("_at.p", "_first").alias("chapter_start"), F.coalesce(F.col("_at.t"), F.lit("Full Text")).alias("chapter_title"))


def rolled_up(annotations: DataFrame) -> DataFrame:
    """annotations (book, page and the fields of SCHEMA) -> chapters (book, start_page, title, paragraphs, plain_text,
    ws_word_count, footnotes, footnote_references, is_back_matter, back_matter_type).

    Regions are taken by page, then reading order; running headers and page numbers are left out. A footnote has the
    number that it begins with, or its place among the chapter's. Rows go by (book, chapter), a chapter's paragraphs to one row."""
    pages = annotations.withColumn("is_start", F.coalesce("isChapterStart", F.lit(False))).withColumn("title", F.col("chapterTitle"))
    pages = chapter_of(pages)
    facts = pages.groupBy("book", "chapter_start").agg(
        F.first("chapter_title").alias("title"),
        F.max(F.coalesce("isBackMatter", F.lit(False))).alias("is_back_matter"),
        F.min_by(F.when(F.col("isBackMatter"), F.col("backMatterType")), F.when(F.col("isBackMatter") & F.col("backMatterType").isNotNull(), F.col("page"))).alias("back_matter_type"),
        F.array_sort(F.collect_list(F.when(F.size("footnoteReferences") > 0, F.struct("page", "footnoteReferences")))).alias("_refs"),
    )
    facts = facts.withColumn("footnote_references", F.expr("flatten(transform(_refs, r -> transform(r.footnoteReferences, x -> struct(x.number AS number, coalesce(x.nearText, '') AS nearText, coalesce(x.column, 'full') AS column, r.page AS pageNumber))))")).drop("_refs")
    regions = pages.select("book", "chapter_start", "page", F.posexplode("regions").alias("nth", "r")).select("book", "chapter_start", "page", "nth", "r.*")
    order = F.struct("page", F.coalesce("readingOrder", F.lit(0)).alias("o"), "nth")
    body = F.when(F.col("type").isin("body", "back_matter"), F.when(F.size(T.paragraphs("text")) > 0, T.paragraphs("text")).otherwise(F.array(F.coalesce("text", F.lit("")))))
    body = body.when(F.col("type").isin("chapter_title", "heading") & (F.coalesce("text", F.lit("")) != ""), F.array(F.trim("text")))
    note = F.when(F.col("type") == "footnote", F.struct(order.alias("o"), F.col("text").alias("text")))
    made = regions.groupBy("book", "chapter_start").agg(
        F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct(order.alias("o"), body.alias("p"))))).alias("_body"),
        F.array_sort(F.collect_list(note)).alias("_notes"),
    )
    made = made.select("book", "chapter_start", F.expr("flatten(transform(_body, x -> x.p))").alias("paragraphs"), F.expr(r"transform(_notes, (x, i) -> struct(coalesce(try_cast(nullif(regexp_extract(x.text, '^(\\d+)\\s+', 1), '') AS int), i + 1) AS number, coalesce(x.text, '') AS text))").alias("footnotes"))
    out = facts.join(made, ["book", "chapter_start"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("paragraphs", F.coalesce("paragraphs", none)).withColumn("plain_text", F.array_join("paragraphs", "\n\n"))
    return out.select("book", F.col("chapter_start").alias("start_page"), "title", "paragraphs", "plain_text", T.word_count("plain_text").alias("ws_word_count"), F.coalesce("footnotes", F.array().cast("array<struct<number: int, text: string>>")).alias("footnotes"), "footnote_references", "is_back_matter", F.when(F.col("is_back_matter"), F.col("back_matter_type")).alias("back_matter_type"))
