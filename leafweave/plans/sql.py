"""DuckDB SQL for the queries of registry.py."""

from __future__ import annotations

WS = r"' ' || chr(9) || chr(13) || chr(11) || chr(12)"
#: The trimmed non-blank lines of t.
LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '')"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '\S+'))"
TOKENS = f"CAST({WORDS} + greatest(len({LINES}) - 1, 0) AS BIGINT)"
CHAPTERS = "chapters AS (SELECT source AS book, doc_id AS chapter, coalesce(text, '') AS text, split_part(text, chr(10), 1) AS title FROM documents)"
TURNS = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS book, CAST(turn AS INT) AS page, role = 'user' AS is_start, split_part(text, chr(10), 1) AS title, text FROM conversations)"
ORDINARY = r"""[^\w\s.,;:!?''"()\-\x{2014}\x{2013}\x{2018}\x{2019}\x{201c}\x{201d}]"""
WIDE = r"""[^\w\s.,;:!?''"()\-\x{2014}\x{2013}\x{2018}\x{2019}\x{201c}\x{201d}\x{2026}\x{00a0}/\[\]{}@#$%&*+=<>~`^|\\]"""
PHRASE = r"""length(line) >= 5 AND length(line) < 70 AND NOT regexp_matches(line, '[.!?]["'')\]]*\s*$')"""
SHORT = f"short AS (SELECT DISTINCT book, chapter, line FROM (SELECT book, chapter, unnest({LINES}) AS line FROM chapters) WHERE {PHRASE})"
CLEAN = r"""clean AS (SELECT DISTINCT book, chapter, trim(regexp_replace(regexp_replace(line, '^\d{1,4}\s*\^?\s*', ''), '\s*\^?\s*\d{1,4}$', '')) AS line FROM short)"""
LISTED = f"listed AS (SELECT source AS book, CAST(doc_id AS INT) AS page, {LINES} AS ls FROM documents), rows_ AS (SELECT book, page, len(ls) AS n, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no FROM listed WHERE len(ls) > 0)"
LINE_VIEW = (
    LISTED
    + """, lines AS (SELECT book, page, line_no, n, CASE WHEN n >= 8 AND line_no >= n - 3 THEN CAST(line_no - (n - 4) AS VARCHAR) || '. ' || text ELSE text END AS text,
  72.0::DOUBLE + 14 * line_no + CASE WHEN n >= 8 AND line_no >= n - 3 THEN 20 ELSE 0 END AS y, 72.0::DOUBLE + CASE WHEN line_no % 5 = 0 THEN 18 ELSE 0 END AS min_x,
  least(468.0::DOUBLE, 5.0 * length(text)) AS width, CASE WHEN n >= 8 AND line_no >= n - 3 THEN 8.0::DOUBLE ELSE 10.0 END AS font_size FROM rows_)"""
)


def _leakage(source: str) -> str:
    return f"""
SELECT r.book, 'HIGH' AS severity, r.line AS text, r.c AS count FROM (SELECT book, line, count(*) AS c FROM {source} WHERE length(line) >= 5 GROUP BY ALL) r
JOIN (SELECT book, count(*) AS chapters FROM chapters GROUP BY book) b ON r.book = b.book WHERE chapters >= 3 AND r.c >= greatest(3, floor(chapters * 0.3))"""


SQL: dict[str, str] = {}

SQL["word_boundaries"] = f"""WITH {CHAPTERS}, c AS (SELECT book, chapter, {TOKENS} AS word_count FROM chapters)
SELECT *, CAST(coalesce(sum(word_count) OVER w, 0) AS BIGINT) AS start_word_index, CAST(coalesce(sum(word_count) OVER w, 0) + word_count AS BIGINT) AS end_word_index
FROM c WINDOW w AS (PARTITION BY book ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

SQL["paragraph_starts"] = rf"""WITH {CHAPTERS}, p AS (SELECT chapter, list_filter(list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\S+'))), lambda n: n > 0) AS s FROM chapters)
SELECT chapter, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS words, array_to_string(list_transform(range(len(s)), lambda i: CAST(coalesce(list_sum(s[1:i]), 0) AS BIGINT)), ',') AS starts FROM p"""

SQL["tokens"] = rf"""WITH {CHAPTERS}, l AS (SELECT chapter, {LINES} AS ls FROM chapters),
t AS (SELECT chapter, flatten(list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN string_split_regex(x, '\s+') ELSE list_concat([chr(10)], string_split_regex('⟩' || x, '\s+')) END)) AS t FROM l)
SELECT chapter, md5(array_to_string(t, '|')) AS tokens, CAST(len(t) AS BIGINT) AS n FROM t"""

SQL["repeated_short_lines"] = f"WITH {CHAPTERS}, {SHORT}, {CLEAN} SELECT book, line, count(*) AS count FROM clean WHERE length(line) >= 5 GROUP BY ALL"
SQL["header_leakage"] = f"WITH {CHAPTERS}, {SHORT}, {CLEAN}" + _leakage("clean")
SQL["header_leakage_plain"] = f"WITH {CHAPTERS}, {SHORT}" + _leakage("short")
SQL["top_lines"] = f"""WITH {CHAPTERS}, {SHORT}, r AS (SELECT book, line, count(*) AS count FROM short GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY count DESC, line) AS k FROM r) WHERE k <= 3"""

SQL["garbage_ratio"] = f"""WITH {CHAPTERS}, r AS (SELECT book, chapter, len(regexp_extract_all(text, '{ORDINARY}')) / length(text) AS ratio FROM chapters WHERE length(text) >= 50)
SELECT book, chapter, CASE WHEN ratio > 0.15 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(ratio, 6) AS ratio FROM r WHERE ratio > 0.05"""
SQL["corpus_garbage"] = f"""WITH {CHAPTERS}, r AS (SELECT book, sum(len(regexp_extract_all(text, '{ORDINARY}'))) / sum(length(text)) AS ratio FROM chapters GROUP BY book)
SELECT book, round(ratio, 6) AS ratio FROM r WHERE ratio > 0.05"""
SQL["ocr_quality"] = f"""WITH {CHAPTERS} SELECT book, round(CASE WHEN sum(length(text)) = 0 THEN 1.0 ELSE greatest(0.0, 1 - 10 * sum(len(regexp_extract_all(text, '{WIDE}'))) / sum(length(text))) END, 6) AS score FROM chapters GROUP BY book"""
SQL["stub_paragraphs"] = rf"""WITH {CHAPTERS}, s AS (SELECT book, chapter, list_filter(list_transform(string_split_regex(text, '\s'), lambda x: trim(x)), lambda x: x <> '' AND length(x) < 5) AS s FROM chapters)
SELECT book, chapter, CASE WHEN len(s) > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, array_to_string(s[1:5], '|') AS text, CAST(len(s) AS BIGINT) AS count FROM s WHERE len(s) > 3"""
SQL["missing_breaks"] = f"""WITH {CHAPTERS}, c AS (SELECT book, chapter, text, CAST({WORDS} AS BIGINT) AS n FROM chapters)
SELECT book, chapter, 'HIGH' AS severity, n AS count FROM c WHERE n > 500 AND NOT contains(text, chr(10) || chr(10))"""
ANOMALY = f"""counted AS (SELECT book, chapter, CAST({WORDS} AS BIGINT) AS n FROM chapters),
medians AS (SELECT book, list_sort(list(n))[1 + CAST(floor(count(*) / 2) AS BIGINT)] AS median FROM counted GROUP BY book HAVING count(*) >= 3),
odd AS (SELECT c.book, chapter, CASE WHEN k = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, n AS count, median FROM counted c JOIN medians m ON c.book = m.book, (VALUES (1), (2)) v(k)
  WHERE (k = 1 AND n BETWEEN 1 AND 49) OR (k = 2 AND median > 0 AND n > 10 * median))"""
SQL["word_count_anomaly"] = f"WITH {CHAPTERS}, {ANOMALY} SELECT book, chapter, severity, count, median FROM odd"
SQL["anomaly_summary"] = f"""WITH {CHAPTERS}, {ANOMALY}, a AS (
  SELECT book, CASE WHEN len(regexp_extract_all(text, '{ORDINARY}')) / length(text) > 0.15 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM chapters WHERE length(text) >= 50 AND len(regexp_extract_all(text, '{ORDINARY}')) / length(text) > 0.05
  UNION ALL SELECT book, 'HIGH' FROM chapters WHERE {WORDS} > 500 AND NOT contains(text, chr(10) || chr(10)) UNION ALL SELECT book, severity FROM odd)
SELECT book, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM a GROUP BY book"""
SQL["duplicate_text"] = rf"""WITH {CHAPTERS}, w AS (SELECT book, chapter, regexp_extract_all(lower(text), '\S+') AS w FROM chapters),
s AS (SELECT DISTINCT book, chapter, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT book, chapter, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
p AS (SELECT a.book, a.chapter, b.chapter AS other, count(*) AS count FROM s a JOIN s b ON a.book = b.book AND a.s = b.s AND a.chapter < b.chapter GROUP BY ALL HAVING count(*) > 3)
SELECT book, chapter, other, CASE WHEN count > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count FROM p"""


def _decoded(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({x}, '&nbsp;', ' ')"


TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
ODD_TITLE = r"[^a-zA-Z0-9\s.,:;''\-\x{2014}\x{2013}()]"
SQL["title_garbling"] = rf"""WITH t AS (SELECT page_id AS chapter, {_decoded(TITLE)} AS title FROM pages), s AS (
  SELECT chapter, title, len(regexp_extract_all(title, '{ODD_TITLE}')) / length(title) AS ratio, string_split_regex(title, '\s+') AS w FROM t WHERE length(title) >= 3),
g AS (SELECT *, CAST(len(list_filter(w, lambda x: length(x) > 3 AND regexp_matches(x, '[^a-zA-Z0-9''\-]'))) AS BIGINT) AS n FROM s)
SELECT chapter, 'HIGH' AS severity, round(ratio, 6) AS ratio, CAST(0 AS BIGINT) AS count FROM g WHERE ratio > 0.3
UNION ALL SELECT chapter, 'MEDIUM', 0.0, n FROM g WHERE NOT regexp_matches(title, '^[A-Z\s]+$') AND regexp_matches(title, '^[A-Z]') AND n > 0 AND n / len(w) > 0.3"""
SQL["image_shapes"] = """WITH i AS (SELECT event_type AS book, CASE WHEN event_type = 'click' THEN user_id ELSE length(event_type) END AS width FROM events)
SELECT book, min(width) || 'x7' AS text, count(*) AS count FROM i GROUP BY book HAVING count(*) >= 5 AND min(width) = max(width)"""
_STRIPPED = _decoded("regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')")
SQL["html_text"] = rf"""SELECT page_id, trim(regexp_replace({_STRIPPED}, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text,
  CAST(nullif(regexp_extract(html, '(?i)<h([1-6])\b', 1), '') AS INT) AS level FROM pages"""
SQL["page_blocks"] = f"""WITH b AS (SELECT page_id, regexp_extract_all(html, '<(?:p|li|h1)>([^<]*)', 1) AS b FROM pages), u AS (SELECT page_id, generate_subscripts(b, 1) - 1 AS k, unnest(b) AS block FROM b)
SELECT page_id, k, {_decoded("block")} AS block FROM u"""
SQL["block_html"] = rf"""WITH {CHAPTERS} SELECT chapter, md5(coalesce(array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda x: trim(x, {WS} || chr(10))), lambda x: x <> ''),
  lambda x: '<p>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'), chr(10)), '')) AS html FROM chapters"""

SQL["page_chunks"] = f"""WITH {CHAPTERS}, p AS (SELECT book, text, count(*) OVER (PARTITION BY book) AS n, row_number() OVER (PARTITION BY book ORDER BY chapter) - 1 AS i FROM chapters),
s AS (SELECT *, CAST(ceil(n / greatest(1, n // 10)) AS BIGINT) AS size FROM p)
SELECT book, i // size AS chunk, CASE WHEN n <= size THEN book WHEN n <= 20 THEN 'Page ' || (min(i) + 1) ELSE 'Pages ' || (min(i) + 1) || '-' || (max(i) + 1) END AS title,
  min(i) + 1 AS first_page, max(i) + 1 AS last_page, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars, md5(string_agg(md5(text), chr(10) ORDER BY i)) AS digest FROM s GROUP BY book, i // size, n, size"""
SQL["chapter_rollup"] = rf"""WITH {TURNS}, t AS (SELECT *, last_value(CASE WHEN is_start THEN page END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN is_start THEN coalesce(nullif(title, ''), 'Chapter (page ' || page || ')') END IGNORE NULLS) OVER w AS st,
  bool_or(is_start) OVER (PARTITION BY book) AS any_, min(page) OVER (PARTITION BY book) AS low FROM turns WINDOW w AS (PARTITION BY book ORDER BY page)),
p AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n{{2,}}'), lambda x: trim(x, {WS} || chr(10))), lambda x: x <> '') AS ps FROM t WHERE s IS NOT NULL OR NOT any_)
SELECT book, coalesce(s, low) AS start_page, min(coalesce(st, 'Full Text')) AS title, CAST(sum({WORDS}) AS BIGINT) AS ws_word_count, CAST(sum(greatest(1, len(ps))) AS BIGINT) AS paragraphs,
  md5(string_agg(coalesce(array_to_string(ps, chr(10) || chr(10)), ''), chr(10) || chr(10) ORDER BY page)) AS text, false AS is_back_matter FROM p GROUP BY book, coalesce(s, low)"""
SQL["boundary_f1"] = f"""WITH {TURNS}, p AS (SELECT DISTINCT book, page FROM turns WHERE is_start), n AS (SELECT DISTINCT book, page FROM turns WHERE contains(text, chr(10))),
m AS (SELECT book, count(*) AS m FROM p WHERE EXISTS (SELECT 1 FROM n WHERE n.book = p.book AND abs(n.page - p.page) <= 1) GROUP BY book),
c AS (SELECT coalesce(a.book, b.book) AS book, coalesce(a.c, 0) AS p, coalesce(b.c, 0) AS n, coalesce(m, 0) AS m FROM (SELECT book, count(*) AS c FROM p GROUP BY book) a FULL JOIN (SELECT book, count(*) AS c FROM n GROUP BY book) b ON a.book = b.book LEFT JOIN m ON m.book = coalesce(a.book, b.book))
SELECT book, round(CASE WHEN p = 0 OR n = 0 OR m = 0 THEN 0.0 ELSE least(1.0, 2 * (m / n) * (m / p) / (m / n + m / p)) END, 6) AS score FROM c"""
CUT = r"regexp_replace(text, '\n[^\n]*\z', '')"
SQL["completeness"] = f"""WITH {CHAPTERS}, cut AS (SELECT book, {CUT} AS text FROM chapters), p AS (SELECT book, sum({TOKENS}) AS p FROM chapters GROUP BY book), n AS (SELECT book, sum({TOKENS}) AS n FROM cut GROUP BY book)
SELECT p.book, round(CASE WHEN p = 0 AND n = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE greatest(0.0, 1 - abs(1 - n / p)) END, 6) AS score FROM p JOIN n ON p.book = n.book"""
SQL["back_matter_f1"] = f"""WITH {CHAPTERS}, c AS (SELECT book, count(*) FILTER (chapter % 3 = 0) AS p, count(*) FILTER (chapter % 5 = 0) AS n FROM chapters GROUP BY book)
SELECT book, round(CASE WHEN p = 0 AND n = 0 THEN 1.0 WHEN p = 0 THEN 0.5 WHEN n = 0 THEN 0.0 ELSE 2 * least(p, n) / (p + n) END, 6) AS score FROM c"""
SQL["header_clean"] = rf"""WITH {CHAPTERS}, {SHORT}, h AS (SELECT book, trim(line) AS h FROM short GROUP BY ALL HAVING count(*) >= 3 AND length(trim(line)) > 5),
l AS (SELECT book, trim(unnest(string_split(text, chr(10)))) AS line FROM chapters),
x AS (SELECT l.book, count(*) AS lines, count(*) FILTER (a.h IS NOT NULL OR b.h IS NOT NULL) AS hits FROM l LEFT JOIN h a ON a.book = l.book AND a.h = l.line
  LEFT JOIN h b ON b.book = l.book AND b.h = trim(regexp_replace(l.line, '\d+', '', 'g')) GROUP BY l.book)
SELECT book, round(greatest(0.0, 1 - 100 * hits / lines), 6) AS score FROM x"""

SQL["font_mode_median"] = f"""WITH {LINE_VIEW}, c AS (SELECT book, page, CAST(round(font_size * 10) AS INT) AS b, count(*) AS c FROM lines GROUP BY ALL)
SELECT l.book, l.page, (SELECT arg_max(b, struct_pack(c := c.c, b := b)) FROM c WHERE c.book = l.book AND c.page = l.page) AS mode, round(median(width), 6) AS width, round(var_pop(font_size), 6) AS variance FROM lines l GROUP BY l.book, l.page"""
SQL["column_split"] = f"""WITH {LINE_VIEW}, n AS (SELECT page, max(n) AS n FROM rows_ GROUP BY page)
SELECT page, CASE WHEN n >= 6 THEN line_no % 2 ELSE 0 END AS col, count(*) AS lines, min(line_no) AS first FROM rows_ GROUP BY ALL UNION ALL SELECT -page - 1, 0, n, 0 FROM n"""
SQL["page_numbers_stripped"] = f"""WITH {LINE_VIEW}, m AS (SELECT page, line_no, n, regexp_matches(CASE WHEN line_no < 2 OR line_no % 7 > 4 THEN CAST(line_no AS VARCHAR) ELSE trim(text) END, '^[\\divxlcdmIVXLCDM]+$') AND length(CASE WHEN line_no < 2 OR line_no % 7 > 4 THEN CAST(line_no AS VARCHAR) ELSE trim(text) END) <= 6 AS num FROM lines),
s AS (SELECT page, n, greatest(0, least(coalesce(min(line_no) FILTER (NOT num), n), n - 3)) AS lead_, n - 1 - coalesce(max(line_no) FILTER (NOT num), -1) AS t FROM m GROUP BY page, n)
SELECT page, lead_ AS first, n - 1 - greatest(0, least(t, n - lead_ - 3)) AS last, n - lead_ - greatest(0, least(t, n - lead_ - 3)) AS lines FROM s"""
SQL["superscript_merge"] = f"""WITH {LINE_VIEW}, j AS (SELECT page, line_no, text, min_x + width AS max_x, line_no % 4 = 1 AND length(text) > 10 AND 4 <= width + 7 AS ok FROM lines),
k AS (SELECT page, line_no, CASE WHEN ok THEN text || '!' || (line_no % 97 + 1) ELSE text END AS text, max_x FROM j UNION ALL SELECT page, line_no + 10000, CAST(line_no % 97 + 1 AS VARCHAR), max_x FROM j WHERE line_no % 4 = 1 AND NOT ok)
SELECT page, line_no, md5(text) AS text, round(max_x, 3) AS max_x FROM k"""
SQL["footnotes_split"] = f"""WITH {LINE_VIEW}, f AS (SELECT page, n, line_no, min(line_no) FILTER (line_no >= 1 AND regexp_matches(text, '^(\\d{{1,3}})[.\\s]') AND n >= 8 AND line_no >= n - 3) OVER (PARTITION BY page) AS s FROM lines)
SELECT DISTINCT page, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS start, CAST(CASE WHEN n >= 8 THEN 1 END AS BIGINT) AS strategy FROM f WHERE line_no = 0"""
SQL["footnotes_parsed"] = f"""WITH {LINE_VIEW} SELECT page, line_no - (n - 3) AS k, CAST(line_no - (n - 4) AS INT) AS number, md5(trim(regexp_replace(text, '^(\\d{{1,3}})[.\\s]', ''))) AS text FROM lines WHERE n >= 8 AND line_no >= n - 3 AND trim(regexp_replace(text, '^(\\d{{1,3}})[.\\s]', '')) <> ''"""
SQL["calibration_interp"] = f"""WITH {TURNS}, t AS (SELECT book, page AS toc, is_start, length(text) AS n FROM turns WHERE text IS NOT NULL), p AS (SELECT book, toc, 3 * toc + n % 5 - 1 AS pdf FROM t WHERE is_start),
f AS (SELECT *, max(CAST(pdf >= toc AS INT)) OVER (PARTITION BY book ORDER BY toc, pdf) AS ok FROM p), k AS (SELECT book, toc, pdf, max(pdf) OVER (PARTITION BY book ORDER BY toc, pdf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM f WHERE ok = 1),
g AS (SELECT book, toc, pdf FROM k WHERE most IS NULL OR pdf > most), w AS (SELECT DISTINCT book, toc FROM t),
b AS (SELECT w.book, w.toc, max(a.toc) AS t1, arg_max(a.pdf, a.toc) AS p1, min(c.toc) AS t2, arg_min(c.pdf, c.toc) AS p2 FROM w LEFT JOIN g a ON a.book = w.book AND a.toc <= w.toc LEFT JOIN g c ON c.book = w.book AND c.toc >= w.toc GROUP BY w.book, w.toc)
SELECT t.book, t.toc, CASE WHEN t1 IS NULL AND t2 IS NULL THEN t.toc WHEN t1 IS NULL THEN t.toc + p2 - t2 WHEN t2 IS NULL OR t1 = t2 THEN t.toc + p1 - t1 ELSE p1 + CAST(trunc((p2 - p1) * ((t.toc - t1) / (t2 - t1))) AS INT) END AS pdf
FROM t JOIN b ON t.book = b.book AND t.toc = b.toc"""
SQL["dice_similarity"] = """WITH b AS (SELECT item_id, lower(text) AS t, greatest(length(text) - 1, 1) AS n FROM benchmark), g AS (SELECT item_id, substr(t, i, 2) AS g, count(*) AS c FROM (SELECT item_id, t, unnest(range(1, greatest(length(t), 2))) AS i FROM b) GROUP BY ALL),
c AS (SELECT x.item_id AS one, y.item_id AS two, sum(least(x.c, y.c)) AS common FROM g x JOIN g y ON x.g = y.g AND x.item_id < y.item_id GROUP BY ALL)
SELECT a.item_id AS one, b.item_id AS two, round(CASE WHEN a.t = b.t THEN 1.0 ELSE 2.0 * coalesce(common, 0) / (a.n + b.n) END, 6) AS dice FROM b a JOIN b ON a.item_id < b.item_id LEFT JOIN c ON c.one = a.item_id AND c.two = b.item_id"""


def _tag(tag: str) -> str:
    return rf"regexp_replace(trim(lower(regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)), ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"


def _alike(x: str, y: str) -> str:
    u, v = f"list_distinct(string_split({x}, ' '))", f"list_distinct(string_split({y}, ' '))"
    return f"round(CASE WHEN {x} = {y} THEN 1.0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.8 ELSE len(list_intersect({u}, {v})) / len(list_distinct(list_concat({u}, {v}))) END, 6)"


SQL["title_jaccard"] = f"WITH p AS (SELECT page_id, {_tag('title')} AS t, {_tag('h1')} AS h, {_tag('footer')} AS f FROM pages) SELECT page_id, {_alike('t', 'h')} AS heading, {_alike('t', 'f')} AS footer FROM p"
SQL["regression_gate"] = f"""WITH {CHAPTERS}, s AS (SELECT book, text, {CUT} AS cut FROM chapters),
q AS (SELECT book, sum(len(regexp_extract_all(text, '{WIDE}'))) AS g, sum(length(text)) AS n, sum(len(regexp_extract_all(cut, '{WIDE}'))) AS h, sum(length(cut)) AS m FROM s GROUP BY book),
x AS (SELECT book, CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.0, 1 - 10 * g / n) END AS now, CASE WHEN m = 0 THEN 1.0 ELSE greatest(0.0, 1 - 10 * h / m) END AS old FROM q)
SELECT book, 'ocr_quality' AS dimension, round(now - old, 6) AS delta, CASE WHEN now - old < -0.02 THEN 'regression' WHEN now - old > 0.02 THEN 'improved' ELSE 'passed' END AS status FROM x"""
SQL["weighted_overall"] = f"""WITH {CHAPTERS}, s AS (SELECT book, 0.13 * count(*) / 1000 + 0.10 * least(1.0, avg(length(text)) / 5000) + 0.09 AS o FROM chapters GROUP BY book) SELECT book, round(o, 6) AS overall, o >= 0.1 AS passed FROM s"""
SQL["cache_misses"] = """WITH k AS (SELECT doc_id, substr(sha256(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) || ':model:v1'), 1, 16) AS key FROM documents) SELECT doc_id, key FROM k WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
SQL["triage_merge"] = f"""WITH {TURNS} SELECT book, page, CASE WHEN is_start THEN 'two_column' ELSE 'single_column' END AS layout, md5(CASE WHEN is_start THEN '!' || text ELSE text END) AS title FROM turns"""
SQL["ocr_cleaned"] = f"""WITH {CHAPTERS} SELECT chapter, md5(replace(text, ' of the ', ' of the ')) AS text FROM chapters"""
SQL["roman_numerals"] = """WITH n AS (SELECT doc_id, CAST(n_chars % 3999 + 1 AS INT) AS n FROM documents) SELECT doc_id, n, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][1 + n // 100 % 10]
  || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][1 + n // 10 % 10] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][1 + n % 10] AS roman, n % 400 AS back FROM n"""
SQL["contents_table"] = f"""WITH {CHAPTERS}, c AS (SELECT book, chapter, coalesce(title, 'Untitled') AS title, {TOKENS} AS n FROM chapters)
SELECT book, title, CAST(coalesce(sum(n) OVER (PARTITION BY book ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_index, row_number() OVER (PARTITION BY book ORDER BY chapter) - 1 AS chapter_index FROM c"""
SQL["book_totals"] = f"WITH {CHAPTERS} SELECT book, count(*) AS total_chapters, CAST(sum({TOKENS}) AS BIGINT) AS total_words FROM chapters GROUP BY book"
SQL["images_distinct"] = "SELECT event_type AS book, min(event_id) AS page_idx, user_id % 50 + 3 * 31 + 4 * 97 AS key FROM events GROUP BY event_type, user_id % 50 + 3 * 31 + 4 * 97"
ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL["rendered_html"] = rf"""WITH {LINE_VIEW}, p AS (SELECT book, page, line_no, n, {ESCAPED} AS t, n >= 8 AND line_no >= n - 3 AS note FROM lines),
h AS (SELECT book, page, string_agg('<p>' || t || '</p>', '' ORDER BY line_no) FILTER (NOT note) AS body,
  string_agg('<p id="endnote-' || (line_no - (n - 4)) || '"><strong>' || (line_no - (n - 4)) || '</strong> ' || trim(regexp_replace(t, '^(\d{{1,4}})[.\s]', '')) || '</p>', '' ORDER BY line_no) FILTER (note) AS notes FROM p GROUP BY book, page)
SELECT book, page AS chapter, md5(body || CASE WHEN notes IS NULL THEN '' ELSE '<section class="transposed-endnotes"><hr><h3>Notes</h3>' || notes || '</section>' END) AS html, notes IS NOT NULL AS notes FROM h"""


def _paragraphs(rows: str, gap: str) -> str:
    """CTEs that end in p(book, page, par, text) over rows of the line view, where gap says when a gap parts paragraphs."""
    return rf"""g AS (SELECT *, 72.0::DOUBLE + CASE WHEN line_no % 5 = 0 THEN 18 ELSE 0 END AS x, lag(trim(text)) OVER o AS before, lag(width) OVER o AS before_width, y - lag(y) OVER o AS gap,
  median(width) OVER w AS widths, median(72.0::DOUBLE + CASE WHEN line_no % 5 = 0 THEN 18 ELSE 0 END) OVER w AS left_ FROM {rows} WINDOW o AS (PARTITION BY page ORDER BY line_no), w AS (PARTITION BY page)),
f AS (SELECT *, greatest(1.0, widths) AS ws, regexp_matches(trim(text), '^[\p{{Lu}}\p{{N}}"''\x{{201C}}\x{{2018}}]') AS starts, regexp_matches(before, '[.!?]["''\x{{201D}}\x{{2019}})\]]?$') AS ends, regexp_matches(before, '[,;:\x{{2014}}\-]["''\x{{201D}}\x{{2019}})\]]?$') AS goes_on,
  length(before) BETWEEN 1 AND 90 AND NOT regexp_matches(before, '[/,;]') AND len(regexp_extract_all(before, '\S+')) BETWEEN 1 AND 10 AND before_width <= greatest(1.0, widths) * 0.68 AS headed FROM g),
b AS (SELECT *, CAST(before IS NOT NULL AND (({gap} AND ends AND NOT goes_on) OR (x - left_ >= 9 AND starts AND ends) OR (before_width <= ws * 0.72 AND ends AND starts) OR (headed AND starts AND width >= ws * 0.65)) AS INT) AS cut FROM f),
c AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY page ORDER BY line_no) AS BIGINT) AS par FROM b),
p AS (SELECT book, page, par, trim(replace(regexp_replace(string_agg(text, chr(1) ORDER BY line_no), '([^ ])-' || chr(1), '\1', 'g'), chr(1), ' ')) AS text FROM c GROUP BY book, page, par)"""


SQL["paragraphs_from_lines"] = f"WITH {LINE_VIEW}, {_paragraphs('lines', 'gap >= 14 * 1.6')} SELECT book, page, par, md5(text) AS text FROM p WHERE text <> ''"
SQL["logical_pages"] = rf"""WITH {LINE_VIEW}, m AS (SELECT *, regexp_matches(trim(text), '^[\divxlcdmIVXLCDM]+$') AND length(trim(text)) <= 6 AS num FROM lines),
e AS (SELECT page, n, greatest(0, least(coalesce(min(line_no) FILTER (NOT num), n), n - 3)) AS lead_, n - 1 - coalesce(max(line_no) FILTER (NOT num), -1) AS t FROM m GROUP BY page, n),
body AS (SELECT m.* FROM m JOIN e ON e.page = m.page WHERE line_no >= lead_ AND line_no < m.n - greatest(0, least(t, m.n - lead_ - 3)) AND NOT (m.n >= 8 AND line_no >= m.n - 3)), {_paragraphs('body', 'gap >= 14 * 1.6')},
d AS (SELECT page, string_agg(text, chr(10) || chr(10) ORDER BY par) AS text FROM p WHERE text <> '' GROUP BY page), k AS (SELECT book, page, max(n) AS n FROM lines GROUP BY ALL)
SELECT book, k.page, 0 AS col, CAST(row_number() OVER (PARTITION BY book ORDER BY k.page) - 1 AS INT) AS page_idx, md5(coalesce(text, '')) AS text, CASE WHEN n >= 8 THEN 3 ELSE 0 END AS notes FROM k LEFT JOIN d ON d.page = k.page"""
