"""Text functions, Column -> Column, without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark of a word that begins a line after the first, the token of a line break, and the mark
#: of a page break inside a text.
LINE_WORD, BREAK = "⟩", "\n"
PAGE_MARK = "<<<PAGE_BREAK>>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: Column | str) -> Column:
    """The trimmed non-blank lines of a text; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")


def words(text: Column | str) -> Column:
    """Runs of non-white-space."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+"), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+")).cast("long")


def tokens(text: Column | str) -> Column:
    """Words line by line: before each non-blank line but the first come a break token and a mark on its first word."""
    return F.flatten(F.transform(lines(text), lambda x, i: F.when(i == 0, F.split(x, r"\s+")).otherwise(F.concat(F.array(F.lit(BREAK)), F.split(F.concat(F.lit(LINE_WORD), x), r"\s+")))))


def token_count(text: Column | str) -> Column:
    """size(tokens(text)), without making them: the words, and a break between lines."""
    t = F.coalesce(_c(text), F.lit(""))
    filled = F.regexp_count(t, F.lit(r"(?m)^[ \t\r\x0b\x0c]*[^\s]"))
    return (F.regexp_count(t, F.lit(r"\S+")) + F.greatest(filled - 1, F.lit(0))).cast("long")


def paragraphs(text: Column | str, breaks: str = r"\n{2,}") -> Column:
    """The trimmed non-empty parts of a text between blank lines."""
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), breaks, -1), lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))), lambda x: x != "")


def paragraph_tokens(text: Column | str, breaks: str = r"\n\n") -> tuple[Column, Column]:
    """All words of a text's paragraphs, and for each paragraph how many words come before it."""
    each = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), breaks, -1), lambda p: F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0))), lambda w: F.size(w) > 0)
    sizes = F.transform(each, F.size)
    starts = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    return F.flatten(each), starts


def dice(a: Column | str, b: Column | str) -> Column:
    """Dice similarity of the multisets of two texts' letter pairs, lower-cased; a text shorter than a pair is its own."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    pairs = lambda s: F.when(F.length(s) < 2, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
    x, y = pairs(a), pairs(b)
    count = lambda s, v: F.size(F.filter(s, lambda w: w == v))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v)))
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def normal_title(title: Column | str) -> Column:
    return F.regexp_replace(F.btrim(F.lower(F.coalesce(_c(title), F.lit(""))), F.lit(" \t\n\r\x0b\x0c")), r"\s+", " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def title_match(a: Column | str, b: Column | str) -> Column:
    """1 for equal titles, 0.8 where one contains the other, else the Jaccard similarity of their words."""
    x, y = normal_title(a), normal_title(b)
    return F.when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.8)).otherwise(jaccard(F.split(x, " "), F.split(y, " ")))


#: Page numbers of up to four digits, plain or with blanks between the digits, that a caret may set off.
_APART, _PLAIN = r"(?:\d\s){1,3}\d", r"\d{1,4}"


def header_text(line: Column | str) -> Column:
    """A line without the page numbers at its ends, spaced ones first, and without carets."""
    s = _c(line)
    for number in (_APART, _PLAIN):
        s = F.regexp_replace(F.regexp_replace(s, rf"^{number}\s*\^?\s*", ""), rf"\s*\^?\s*{number}$", "")
    return F.btrim(F.replace(s, F.lit("^"), F.lit("")), F.lit(" \t\r\n"))


def leak_text(line: Column | str) -> Column:
    """A line without up to four digits, and a caret, at either end."""
    s = F.regexp_replace(_c(line), r"^\d{1,4}\s*\^?\s*", "")
    return F.btrim(F.regexp_replace(s, r"\s*\^?\s*\d{1,4}$", ""), F.lit(" \t\r\n\x0b\x0c"))


def short_phrase(line: Column | str) -> Column:
    """5 to 69 characters that do not end a sentence."""
    s = _c(line)
    return (F.length(s) >= 5) & (F.length(s) < 70) & ~s.rlike(r"""[.!?]["')\]]*\s*$""")


#: The numerals that are read; other letters count nothing.
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def roman_to_int(numeral: Column | str) -> Column:
    """Numerals of I, V, X, L, C in either case: from the right, a smaller one before a larger one is taken away."""
    value = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in _ROMAN.items() for v in p]), c), F.lit(0))
    letters = F.reverse(F.split(F.upper(_c(numeral)), ""))
    step = lambda a, c: F.struct((a["n"] + F.when(value(c) < a["last"], -value(c)).otherwise(value(c))).alias("n"), F.greatest(value(c), F.lit(0)).alias("last"))
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), step, lambda a: a["n"])


#: The numerals that are written, from the largest on.
NUMERALS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def int_to_roman(n: Column | str) -> Column:
    """A number as numerals, each as often as it fits in what those before it leave; nothing for 0 and less."""
    left, parts = F.greatest(_c(n), F.lit(0)), []
    for value, numeral in NUMERALS:
        parts.append(F.repeat(F.lit(numeral), F.floor(left / value).cast("int")))
        left = left % value
    return F.concat(*parts)


def trailing_page(line: Column | str) -> Column:
    """The number of up to three digits at a line's end, after a blank or dots; else one with I or l for 1 and O for 0."""
    digits = F.regexp_extract(_c(line), r"[\s.]+(\d{1,3})\s*$", 1)
    odd = F.translate(F.regexp_extract(_c(line), r"[\s.]+([\dIlO]{1,3})\s*$", 1), "IlO", "110")
    plain, fixed = F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999")).cast("int"), F.try_to_number(F.nullif(odd, F.lit("")), F.lit("999")).cast("int")
    return F.coalesce(plain, F.when(fixed > 0, fixed))


def normal_token(token: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(token), r"[^\p{L}\p{M}\p{N}]", ""))


def without_title(text: Column | str, title: Column | str) -> Column:
    """A text without its first words where these, normalised, are the title's."""
    t = F.coalesce(_c(text), F.lit(""))
    wanted = F.filter(F.transform(words(title), normal_token), lambda w: w != "")
    n = F.size(wanted)
    # Words without letters or digits do not count, so the place after the n-th word that has some is looked for.
    spans = words(t)
    normal = F.transform(spans, normal_token)
    places = F.filter(F.transform(normal, lambda w, i: F.when(w != "", i).otherwise(F.lit(-1))), lambda i: i >= 0)
    upto = F.get(places, n - 1)
    head = F.filter(F.slice(normal, F.lit(1), F.greatest(F.coalesce(upto, F.lit(-1)) + 1, F.lit(0))), lambda w: w != "")
    rest = F.btrim(F.substring(t, F.length(F.regexp_substr(t, F.concat(F.lit(r"^(?:\s*\S+){"), (F.coalesce(upto, F.lit(0)) + 1).cast("string"), F.lit("}")))) + 1, F.length(t)), F.lit(" \t\n\r"))
    return F.when((n > 0) & upto.isNotNull() & (head == wanted), rest).otherwise(t)


def chapter_title(title: Column | str) -> Column:
    """A title without the number before it and without carets."""
    return F.btrim(F.replace(F.regexp_replace(_c(title), r"^\d+\s+", ""), F.lit("^"), F.lit("")), F.lit(" "))


def block_title(title: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(_c(title), r"^\d+\.?\s+", ""), r"\s+", " "), F.lit(" "))


#: Entities that are decoded, in this order, before numeric ones.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'))


def decode_entities(text: Column | str) -> Column:
    s = _c(text)
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    codes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")
    s = F.aggregate(codes, s, lambda t, n: F.when(n.cast("int").between(1, 0x10FFFF) & ~n.cast("int").between(0xD800, 0xDFFF), F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), char(n))).otherwise(t))
    return F.replace(s, F.lit("&nbsp;"), F.lit(" "))


def strip_html(html: Column | str) -> Column:
    """Text of a block's html: tags go, entities are decoded, and tags that this has made go too."""
    return F.btrim(F.regexp_replace(decode_entities(F.regexp_replace(F.coalesce(_c(html), F.lit("")), r"<[^>]+>", "")), r"<[^>]+>", ""), F.lit(" \t\n\r"))


def heading_level(html: Column | str) -> Column:
    """Of the first heading tag; null without one."""
    return F.nullif(F.regexp_extract(_c(html), r"(?i)<h([1-6])\b", 1), F.lit("")).cast("int")


def clean_block_html(html: Column | str) -> Column:
    s = F.regexp_replace(_c(html), r"""\s*block-type=(?:"[^"]*"|'[^']*')""", "")
    return F.regexp_replace(s, r"(?s)<content-ref[^>]*>(?:.*?</content-ref>)?", "")


def escape_html(text: Column | str) -> Column:
    s = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def paragraphs_html(text: Column | str) -> Column:
    return F.array_join(F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "\n")


def without_page_marks(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\n?" + PAGE_MARK + r"\n?", "\n")


def content_key(content: Column | str, digits: int = 16) -> Column:
    """The first digits of a SHA-256, in hexadecimal."""
    return F.substring(F.sha2(_c(content).cast("binary"), 256), 1, digits)


def image_key(size: Column | str, width: Column | str, height: Column | str, fast: bool = True) -> Column:
    """A number for telling images apart: by their size and shape (different images may share it), or by a real hash."""
    size, width, height = (_c(x).cast("long") for x in (size, width, height))
    return size + width * 31 + height * 97 if fast else F.xxhash64(size, width, height)


#: Characters of ordinary text, for the two measures of garbage.
ORDINARY = r"""[\w\s.,;:!?'"()\-\x{2014}\x{2013}\x{2018}\x{2019}\x{201c}\x{201d}]"""
ORDINARY_WIDE = r"""[\w\s.,;:!?'"()\-\x{2014}\x{2013}\x{2018}\x{2019}\x{201c}\x{201d}\x{2026}\x{00a0}/\[\]{}@#$%&*+=<>~`^|\\]"""
TITLE_ORDINARY = r"[a-zA-Z0-9\s.,:;'\-\x{2014}\x{2013}()]"


def odd_characters(text: Column | str, ordinary: str = ORDINARY) -> Column:
    """How many characters of a text are outside a class. Words are ASCII: letters with accents count."""
    return F.regexp_count(_c(text), F.lit("[^" + ordinary[1:])).cast("long")
