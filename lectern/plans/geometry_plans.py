"""Page-geometry queries: a document is a book of pages of eight lines, placed by the lengths of its lines.

No table holds geometry, so it is derived: every fourth document has two
columns, every third a chapter marker before each sixth line, every fifth a
running head before each seventh, every second a table of contents. Texts are whole; the SQL twins derive the same lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import geometry as G
from lectern.plans.text_plans import CODE_SQL, DENSITY_SQL
from lectern.sources.tables import table

_LINES = r"""lines0 AS (
  SELECT doc_id AS book, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t, i:
    CASE WHEN doc_id % 3 = 0 AND (i - 1) % 6 = 0 THEN ['Chapter ' || ((i - 1) // 6 + 1), t] WHEN doc_id % 5 = 0 AND (i - 1) % 7 = 0 THEN ['A  Running Head', t] ELSE [t] END)) AS l FROM documents),
lines1 AS (SELECT book, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS k FROM lines0),
lines AS (
  SELECT book, CAST(k // 8 + 1 AS INTEGER) AS page, CAST(k % 8 AS INTEGER) AS line, text,
    CAST(CASE WHEN book % 4 = 0 AND k % 2 = 1 THEN 320 ELSE 60 + CASE WHEN length(text) % 9 = 0 THEN 15 ELSE 0 END END AS DOUBLE) AS x0,
    CAST(CASE WHEN k % 8 = 7 THEN 726 ELSE 40 + 28 * (k % 8) END + CASE WHEN length(text) % 5 = 0 THEN 4 ELSE 0 END AS DOUBLE) AS y0,
    CAST(least(CASE WHEN book % 4 = 0 AND k % 2 = 0 THEN 300 ELSE 560 END, CASE WHEN book % 4 = 0 AND k % 2 = 1 THEN 320 ELSE 75 END + 3 * length(text)) AS DOUBLE) AS x1,
    CAST(12 + CASE WHEN k % 8 = 7 THEN 726 ELSE 40 + 28 * (k % 8) END + CASE WHEN length(text) % 5 = 0 THEN 4 ELSE 0 END AS DOUBLE) AS y1,
    CAST(CASE WHEN length(text) % 11 = 0 AND length(text) < 80 THEN 15 ELSE 10 END AS DOUBLE) AS size,
    CAST(length(text) % 4 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS mono, CAST(792 AS DOUBLE) AS page_height
  FROM lines1)"""


def lines_of(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("book"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    marked = F.transform("l", lambda t, i: F.when((F.col("book") % 3 == 0) & (i % 6 == 0), F.array(F.concat(F.lit("Chapter "), (i / 6).cast("int") + 1), t)).when((F.col("book") % 5 == 0) & (i % 7 == 0), F.array(F.lit("A  Running Head"), t)).otherwise(F.array(t)))
    k, n = F.col("k"), F.length("text")
    two, right = F.col("book") % 4 == 0, F.col("k") % 2 == 1
    y0 = F.when(k % 8 == 7, 726).otherwise(40 + 28 * (k % 8)) + F.when(n % 5 == 0, 4).otherwise(0)
    begin = F.when(two & right, 320).otherwise(75)
    return docs.select("book", F.posexplode(F.flatten(marked)).alias("k", "text")).select(
        "book", (F.floor(k / 8) + 1).cast("int").alias("page"), (k % 8).alias("line"), "text",
        F.when(two & right, 320.0).otherwise(F.when(n % 9 == 0, 75.0).otherwise(60.0)).alias("x0"), y0.cast("double").alias("y0"),
        F.least(F.when(two & ~right, 300).otherwise(560), begin + 3 * n).cast("double").alias("x1"), (y0 + 12).cast("double").alias("y1"),
        F.when((n % 11 == 0) & (n < 80), 15.0).otherwise(10.0).alias("size"), (n % 4 * 0.25).alias("mono"), F.lit(792.0).alias("page_height"),
    )


def entries_of(spark, d):
    """Contents of even books: an entry on every odd page, and one far behind the last for every fifth book."""
    books = lines_of(spark, d).where("book % 2 = 0").groupBy("book").agg(F.max("page").alias("last"))
    pages = F.concat(F.sequence(F.lit(1), F.col("last"), F.lit(2)), F.when(F.col("book") % 5 == 0, F.array(F.lit(9000), F.lit(9001), F.lit(9002), F.lit(9003))).otherwise(F.array().cast("array<int>")))
    return books.select("book", F.posexplode(pages).alias("n", "page")).withColumn("title", F.concat(F.lit("Part "), F.col("n") + 1))


def line_flags(spark, d):
    return lines_of(spark, d).where(~G.is_blank()).groupBy("book").agg(
        F.count_if(G.in_band()).alias("in_band"), F.count_if(G.is_page_number(F.col("text"))).alias("page_numbers"),
        F.count_if(G.ends_sentence(F.col("text"))).alias("end_sentence"), F.count_if(G.starts_upper(F.col("text"))).alias("start_upper"),
        F.sum(G.height()).alias("heights"), F.sum(G.width()).alias("widths"),
    )


def chrome_lines(spark, d):
    return G.chrome(lines_of(spark, d))


def body_lines(spark, d):
    return G.without_chrome(lines_of(spark, d)).select("book", "page", "line", "text")


def column_order(spark, d):
    return G.columns(lines_of(spark, d)).select("book", "page", "line", "col", "pos")


def _paras(spark, d):
    return G.paragraphs(lines_of(spark, d))


def breaks(spark, d):
    return G.marked_breaks(G.columns(lines_of(spark, d))).select("book", "page", "line", "col", "group", "heading")


def paragraph_rows(spark, d):
    return _paras(spark, d).select("book", "para", "page", "text", "n_lines", "size")


def formula_paragraphs(spark, d):
    return _paras(spark, d).where(G.is_formula()).select("book", "para")


def book_sizes(spark, d):
    return lines_of(spark, d).groupBy("book").agg(F.coalesce(G.median_size(F.when(~G.is_blank(), F.col("size"))), F.lit(0.0)).alias("median_size"))


def contents(spark, d):
    return G.broken_contents(_paras(spark, d), entries_of(spark, d))


def contents_sections(spark, d):
    return G.numbered(G.by_contents(_paras(spark, d), entries_of(spark, d))).select("book", "para", "section", "title")


def heading_sections(spark, d):
    return G.numbered(G.by_headings(_paras(spark, d))).select("book", "para", "section", "title")


def marker_sections(spark, d):
    return G.numbered(G.by_markers(_paras(spark, d))).select("book", "para", "section", "title")


def all_sections(spark, d):
    return G.sections(_paras(spark, d), entries_of(spark, d)).groupBy("book", "section", "title", "way").agg(F.count(F.lit(1)).alias("paras"))


def degenerate_books(spark, d):
    return G.degenerate(G.by_headings(_paras(spark, d)))


def block_matches(spark, d):
    """Lines as blocks of one reading, against those of another whose boxes are a little off and whose numbers are one off on odd pages."""
    left = lines_of(spark, d).select("book", "page", F.col("line").alias("block"), "x0", "y0", "x1", "y1")
    off = F.col("block") % 4 * 0.75
    right = left.select("book", "page", (F.col("block") + F.col("page") % 2).alias("block"), F.col("x0") + off, F.col("y0") + off, F.col("x1") - off, F.col("y1") + F.when(F.col("block") % 4 == 3, 3.0).otherwise(0.0)).toDF(*left.columns)
    return G.matched_blocks(left, right).select("book", "page", "block", "other")


QUERIES = {
    "J15_blocks": block_matches, "P8_P13_lines": line_flags, "A11_chrome": chrome_lines, "J13_body": body_lines, "W10_columns": column_order, "W11_breaks": breaks, "T17_T28_paragraphs": paragraph_rows,
    "P7_formulas": formula_paragraphs, "A15_median_size": book_sizes, "A23_contents": contents, "T19_sections": contents_sections, "T20_headings": heading_sections,
    "T21_markers": marker_sections, "A22_degenerate": degenerate_books, "T22_sections": all_sections,
}

# -- SQL twins -------------------------------------------------------------------------------
_FULL = r"regexp_matches(text, '\S')"
_BAND = "(y0 < page_height * CAST(0.08 AS DOUBLE) OR y1 > page_height - page_height * CAST(0.08 AS DOUBLE))"
_PLAIN = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_NUMBER = r"""(regexp_matches(trim({x}, ' ' || chr(9) || chr(10) || chr(13)), '^(\s*(page[.\s]*)?\d{1,4}|[-–—]?\s*\d{1,4}\s*[-–—]|[ivxlcdmIVXLCDM]{1,7}\.?\s*$)') AND NOT regexp_matches({x}, '\p{L}{2}'))"""
_ENDS = r"""regexp_matches({x}, '[.!?]["''”’)\] ]*$')"""
_UPPER = r"""regexp_matches({x}, '^["''“(\[£ ]*\p{Lu}')"""
_KEY = f"CASE WHEN {_FULL} AND {_BAND} THEN lower({_PLAIN.replace('{x}', 'text')}) END"
_CHROME = f"""{_LINES},
seen AS (SELECT book, {_KEY} AS key, count(DISTINCT page) AS on_pages FROM lines WHERE {_KEY} IS NOT NULL GROUP BY 1, 2),
chrome AS (SELECT book, key, on_pages, pages FROM seen JOIN (SELECT book, count(DISTINCT page) AS pages FROM lines GROUP BY 1) USING (book)
  WHERE pages >= 3 AND on_pages >= greatest(2, floor(CAST(0.6 AS DOUBLE) * pages)))"""
_COLUMNS = f"""{_LINES},
b AS (SELECT *, {_FULL} AND x1 > x0 AS body, {_FULL} AS full_ FROM lines),
c1 AS (SELECT *, max(x1) OVER (PARTITION BY book, page, body ORDER BY x0, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
c2 AS (SELECT *, sum(CASE WHEN body AND reach IS NOT NULL AND x0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY book, page, body ORDER BY x0, line ROWS UNBOUNDED PRECEDING) AS col_ FROM c1),
c3 AS (SELECT *, count(*) OVER (PARTITION BY book, page, body, col_) AS nl FROM c2),
c4 AS (SELECT *, count(*) FILTER (body) OVER p >= 4 AND max(col_) OVER p >= 1 AND min(CASE WHEN body THEN nl END) OVER p >= 2 AS columnar FROM c3 WINDOW p AS (PARTITION BY book, page)),
cols AS (SELECT *, CAST(CASE WHEN columnar THEN col_ ELSE 0 END AS INTEGER) AS col,
  CAST(row_number() OVER (PARTITION BY book, page, CASE WHEN columnar THEN col_ ELSE 0 END ORDER BY CASE WHEN columnar THEN y0 END, CASE WHEN columnar THEN x0 END, line) - 1 AS INTEGER) AS pos
  FROM c4 WHERE body OR NOT columnar)"""
_BREAKS = f"""{_COLUMNS},
h1 AS (SELECT *, NOT full_ AS blank, coalesce(median(CASE WHEN full_ AND size <> 0 THEN size END) OVER r, 0) AS med, max(greatest(x1 - x0, 0)) OVER r AS widest,
  greatest(y1 - y0, 1) AS h, greatest(x1 - x0, 0) AS wd FROM cols WINDOW r AS (PARTITION BY book, page, col)),
h2 AS (SELECT *, med > 0 AND size <> 0 AND size >= CAST(1.3 AS DOUBLE) * med AND length(trim(text)) <= 90 AS heading FROM h1),
h3 AS (SELECT *, lag(blank) OVER o AS p_blank, lag(heading) OVER o AS p_heading, lag(x0) OVER o AS p_x0, lag(y1) OVER o AS p_y1, lag(size) OVER o AS p_size, lag(h) OVER o AS p_h,
  lag(wd) OVER o AS p_wd, lag(text) OVER o AS p_text FROM h2 WINDOW o AS (PARTITION BY book, page, col ORDER BY pos)),
grouped AS (SELECT *, CAST(sum(CASE WHEN p_blank IS NULL OR p_blank OR p_heading OR heading OR y0 - p_y1 > CAST(1.4 AS DOUBLE) * ((p_h + h) / 2)
    OR (x0 - p_x0 > CAST(1.2 AS DOUBLE) * greatest(p_size, size, 1) AND y0 > p_y1)
    OR ({_ENDS.replace('{x}', 'p_text')} AND p_wd < CAST(0.85 AS DOUBLE) * widest AND {_UPPER.replace('{x}', 'text')}) THEN 1 ELSE 0 END)
  OVER (PARTITION BY book, page, col ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS "group" FROM h3 WHERE NOT blank)"""
_PARAS = rf"""{_BREAKS},
g1 AS (SELECT book, page, col, "group" AS g, string_agg(trim(text), chr(1) ORDER BY pos) AS t, CAST(count(*) AS INTEGER) AS n_lines, first(size ORDER BY pos) AS size, list(size) AS sizes,
  sum(length(text) * mono) / sum(length(text)) AS mono FROM grouped GROUP BY 1, 2, 3, 4),
g2 AS (SELECT *, {_PLAIN.replace('{x}', "replace(regexp_replace(t, '(^|[^-])-' || chr(1) || '([[:lower:]ßà-öø-ÿœ])', '{a}{b}', 'g'), chr(1), ' ')").replace('{a}', chr(92) + '1').replace('{b}', chr(92) + '2')} AS text FROM g1),
g3 AS (SELECT *, row_number() OVER w AS n, coalesce(lead(page) OVER w = page + 1 AND regexp_matches(text, '(^|[^-])-$') AND regexp_matches(lead(text) OVER w, '^\p{{Ll}}'), false) AS joins,
  lead(text) OVER w AS after FROM g2 WINDOW w AS (PARTITION BY book ORDER BY page, col, g)),
g4 AS (SELECT *, joins AND (n - coalesce(max(CASE WHEN NOT joins THEN n END) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS takes FROM g3),
g5 AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY book ORDER BY n), false) AS gone FROM g4),
paras AS (SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY n) - 1 AS INTEGER) AS para, page, CASE WHEN takes THEN text[:-2] || after ELSE text END AS text, n_lines, size, mono, sizes FROM g5 WHERE NOT gone)"""
_ENTRIES = """entries AS (
  SELECT book, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS n, unnest(ps) AS page, 'Part ' || generate_subscripts(ps, 1) AS title FROM (
    SELECT book, list_concat(generate_series(1, max(page), 2), CASE WHEN book % 5 = 0 THEN [9000, 9001, 9002, 9003] ELSE [] END) AS ps FROM lines WHERE book % 2 = 0 GROUP BY book))"""
_CONTENTS = f"""{_PARAS}, {_ENTRIES},
toc AS (SELECT *, CAST((SELECT count(*) FROM entries e WHERE e.book = p.book AND e.page <= p.page) AS INTEGER) AS cut,
  (SELECT max_by(e.title, e.page * 10000 + e.n) FROM entries e WHERE e.book = p.book AND e.page <= p.page) AS title FROM paras p),
judged AS (SELECT book, entries, coalesce(filled, 0) AS filled, coalesce(filled, 0) / (entries + 1) < 0.5 AS broken
  FROM (SELECT book, count(*) AS entries FROM entries GROUP BY 1) LEFT JOIN (SELECT book, count(DISTINCT cut) AS filled FROM toc GROUP BY 1) USING (book))"""
_HEADINGS = r"""hs AS (SELECT book, coalesce(median(s), 0) AS med FROM (SELECT book, unnest(sizes) AS s FROM paras) WHERE s <> 0 GROUP BY 1),
hh AS (SELECT p.*, CASE WHEN med > 0 AND n_lines = 1 AND size >= CAST(1.3 AS DOUBLE) * med AND length(text) <= 90 AND NOT suffix(text, '.') AND regexp_matches(text, '\p{L}{2}') THEN text END AS t FROM paras p JOIN hs USING (book)),
heads AS (SELECT * EXCLUDE (t) FROM (SELECT *, CAST(count(t) OVER w AS INTEGER) AS cut, last_value(t IGNORE NULLS) OVER w AS title FROM hh WINDOW w AS (PARTITION BY book ORDER BY para ROWS UNBOUNDED PRECEDING)) WHERE t IS NULL)"""
_MARKERS = r"""mk AS (SELECT *, length(trim(text)) <= 40 AND n_lines = 1 AND regexp_matches(trim(text), '^(CHAPTER|Chapter|chapter|PART|Part|UNIT|Unit|LESSON|Lesson)\s+([0-9]+|[IVXLC]{1,6})[.:]?\s*$') AS m FROM paras),
mk2 AS (SELECT *, count(*) FILTER (m) OVER (PARTITION BY book) AS ms, coalesce(lag(m) OVER (PARTITION BY book ORDER BY para), false) AND NOT m AND length(trim(text)) <= 60 AND NOT suffix(trim(text), '.') AND n_lines = 1 AS named FROM mk),
mk3 AS (SELECT *, CASE WHEN m THEN upper(trim(text)[1]) || lower(trim(text)[2:]) || CASE WHEN lead(named) OVER (PARTITION BY book ORDER BY para) THEN ' — ' || trim(lead(text) OVER (PARTITION BY book ORDER BY para)) ELSE '' END END AS t FROM mk2 WHERE ms >= 3),
marks AS (SELECT * EXCLUDE (t, m, ms, named) FROM (SELECT *, CAST(count(t) OVER w AS INTEGER) AS cut, last_value(t IGNORE NULLS) OVER w AS title FROM mk3 WINDOW w AS (PARTITION BY book ORDER BY para ROWS UNBOUNDED PRECEDING)) WHERE t IS NULL AND NOT named)"""
_NUMBERED = "SELECT book, para, CAST(dense_rank() OVER (PARTITION BY book ORDER BY cut) - 1 AS INTEGER) AS section, title FROM "
_DEGENERATE = "SELECT book, CAST(sum(n) AS BIGINT) AS paras, max(n) AS largest, sum(n) > 150 AND max(n) / sum(n) > 0.6 AS degenerate FROM (SELECT book, cut, count(*) AS n FROM {x} GROUP BY 1, 2) GROUP BY 1"
ORACLES = {
    "J15_blocks": f"""WITH {_LINES}, r AS (SELECT book, page, CAST(line + page % 2 AS INTEGER) AS b, x0 + line % 4 * CAST(0.75 AS DOUBLE) AS a0, y0 + line % 4 * CAST(0.75 AS DOUBLE) AS a1, x1 - line % 4 * CAST(0.75 AS DOUBLE) AS a2, y1 + CASE WHEN line % 4 = 3 THEN 3 ELSE 0 END AS a3 FROM lines),
p AS (SELECT l.book, l.page, l.line, r.b, CASE WHEN r.b = l.line AND greatest(abs(x0 - a0), abs(y0 - a1), abs(x1 - a2), abs(y1 - a3)) <= 2 THEN -1 ELSE abs(x0 - a0) + abs(y0 - a1) + abs(x1 - a2) + abs(y1 - a3) END AS dist FROM lines l JOIN r USING (book, page)),
k AS (SELECT *, row_number() OVER (PARTITION BY book, page, line ORDER BY dist, b) AS n FROM p WHERE dist <= 5)
SELECT l.book, l.page, l.line AS block, k.b AS other FROM lines l LEFT JOIN k ON k.book = l.book AND k.page = l.page AND k.line = l.line AND n = 1""",
    "P8_P13_lines": f"""WITH {_LINES} SELECT book, count(*) FILTER ({_BAND}) AS in_band, count(*) FILTER ({_NUMBER.replace('{x}', 'text')}) AS page_numbers, count(*) FILTER ({_ENDS.replace('{x}', 'text')}) AS end_sentence,
  count(*) FILTER ({_UPPER.replace('{x}', 'text')}) AS start_upper, sum(greatest(y1 - y0, 1)) AS heights, sum(greatest(x1 - x0, 0)) AS widths FROM lines WHERE {_FULL} GROUP BY 1""",
    "A11_chrome": f"WITH {_CHROME} SELECT * FROM chrome",
    "J13_body": f"""WITH {_CHROME}, k AS (SELECT *, {_KEY} AS key FROM lines)
SELECT book, page, line, text FROM k WHERE (key IS NULL OR NOT {_NUMBER.replace('{x}', 'text')}) AND NOT EXISTS (SELECT 1 FROM chrome c WHERE c.book = k.book AND c.key = k.key)""",
    "W10_columns": f"WITH {_COLUMNS} SELECT book, page, line, col, pos FROM cols",
    "W11_breaks": f'WITH {_BREAKS} SELECT book, page, line, col, "group", heading FROM grouped',
    "T17_T28_paragraphs": f"WITH {_PARAS} SELECT book, para, page, text, n_lines, size FROM paras",
    "P7_formulas": f"WITH {_PARAS} SELECT book, para FROM paras WHERE {DENSITY_SQL} > 0.25 OR mono > 0.6 OR ({CODE_SQL} >= 2 AND mono > 0.3)",
    "A15_median_size": f"WITH {_LINES} SELECT book, CAST(coalesce(median(CASE WHEN {_FULL} AND size <> 0 THEN size END), 0) AS DOUBLE) AS median_size FROM lines GROUP BY 1",
    "A23_contents": f"WITH {_CONTENTS} SELECT * FROM judged",
    "T19_sections": f"WITH {_CONTENTS} {_NUMBERED} toc",
    "T20_headings": f"WITH {_PARAS}, {_HEADINGS} {_NUMBERED} heads",
    "T21_markers": f"WITH {_PARAS}, {_MARKERS} {_NUMBERED} marks",
    "A22_degenerate": f"WITH {_PARAS}, {_HEADINGS} {_DEGENERATE.replace('{x}', 'heads')}",
    "T22_sections": f"""WITH {_CONTENTS}, {_HEADINGS}, {_MARKERS}, sound AS (SELECT book FROM judged WHERE NOT broken),
cut AS (SELECT book, para, cut, title, 'contents' AS way FROM toc WHERE book IN (FROM sound) UNION ALL SELECT book, para, cut, title, 'headings' FROM heads WHERE book NOT IN (FROM sound)),
failed AS (SELECT book FROM ({_DEGENERATE.replace('{x}', 'cut')}) WHERE degenerate AND book IN (SELECT book FROM marks GROUP BY 1 HAVING count(DISTINCT cut) >= 3)),
final AS (SELECT * FROM cut WHERE book NOT IN (FROM failed) UNION ALL SELECT book, para, cut, title, 'markers' FROM marks WHERE book IN (FROM failed)),
num AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY book ORDER BY cut) - 1 AS INTEGER) AS section FROM final)
SELECT book, section, title, way, count(*) AS paras FROM num GROUP BY 1, 2, 3, 4""",
}
