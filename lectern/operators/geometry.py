"""From lines with geometry to paragraphs and sections: margins, columns, breaks, tables of contents, headings.

Lines: book, page, line (order of reading on the page), text, x0, y0, x1, y1,
size, mono (share of monospaced characters) and page_height. A line of white
space only is blank: it has no place of its own and ends a paragraph. Pages are
worked on by themselves; windows over a book carry one row a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.tables import stored

# -- fixed values that results depend on ---------------------------------------------
BAND, CHROME_SHARE, CHROME_PAGES = 0.08, 0.60, 3
GAP, INDENT, HEADING, SHORT = 1.4, 1.2, 1.3, 0.85
MOST_HEADING, MOST_MARKER, MOST_TITLE = 90, 40, 60
DENSE, MONO, MONO_CODE = 0.25, 0.60, 0.30
PAGE_NUMBER = r"^(\s*(page[.\s]*)?\d{1,4}|[-–—]?\s*\d{1,4}\s*[-–—]|[ivxlcdmIVXLCDM]{1,7}\.?\s*$)"
MARKER = r"^(CHAPTER|Chapter|chapter|PART|Part|UNIT|Unit|LESSON|Lesson)\s+([0-9]+|[IVXLC]{1,6})[.:]?\s*$"
TWO_LETTERS = r"\p{L}{2}"


# -- predicates of lines -----------------------------------------------------------------


def is_blank() -> Column:
    return ~F.col("text").rlike(r"\S")


def in_band() -> Column:
    """Whether a line begins in the top margin or ends in the bottom one."""
    band = F.col("page_height") * BAND
    return (F.col("y0") < band) | (F.col("y1") > F.col("page_height") - band)


def is_page_number(text: Column) -> Column:
    """Begins like a page number and holds no two letters in a row; so a bare year counts, and ``iv`` doesn't."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b")).rlike(PAGE_NUMBER) & ~text.rlike(TWO_LETTERS)


def ends_sentence(text: Column) -> Column:
    return text.rlike("[.!?][\"'”’)\\] ]*$")


def starts_upper(text: Column) -> Column:
    return text.rlike("^[\"'“(\\[£ ]*\\p{Lu}")


def height() -> Column:
    return F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))


def width() -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))


def plain(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def median_size(sizes: Column) -> Column:
    """Median of the sizes that aren't zero; null where there is none."""
    return F.median(F.when(sizes != 0, sizes))


# -- margins -------------------------------------------------------------------------------


def chrome(lines: DataFrame) -> DataFrame:
    """(book, key, on_pages, pages): margin lines that stand on a large share of a book's pages, as lower-case keys.

    Lines are made distinct by page before they are counted; a book needs CHROME_PAGES pages.
    """
    marked = lines.where(~is_blank() & in_band()).select("book", "page", F.lower(plain(F.col("text"))).alias("key")).distinct()
    seen = marked.groupBy("book", "key").agg(F.count(F.lit(1)).alias("on_pages"))
    pages = lines.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    need = F.greatest(F.lit(2), F.floor(F.lit(CHROME_SHARE) * F.col("pages")))
    return seen.join(pages, "book").where((F.col("pages") >= CHROME_PAGES) & (F.col("on_pages") >= need))


def without_chrome(lines: DataFrame) -> DataFrame:
    """Lines but margin lines that are chrome or page numbers; blank ones stay."""
    keyed = lines.withColumn("_key", F.when(~is_blank() & in_band(), F.lower(plain(F.col("text")))))
    known = chrome(lines).select("book", F.col("key").alias("_key"))
    rest = keyed.where(F.col("_key").isNull() | ~is_page_number(F.col("text")))
    return rest.join(known, ["book", "_key"], "left_anti").drop("_key")


# -- reading order and paragraphs ------------------------------------------------------------


def columns(lines: DataFrame) -> DataFrame:
    """Lines with col and pos, the order in the column; on a page that isn't columnar col is 0 and the order that of the lines.

    Sorted by x0, a line begins a new column where it lies right of all before
    it. A page is columnar with four lines at least, two columns, and two lines in each.
    Columnar pages lose their blank lines.
    """
    page = Window.partitionBy("book", "page")
    body = ~is_blank() & (F.col("x1") > F.col("x0"))
    made = lines.withColumn("_body", body)
    across = Window.partitionBy("book", "page", "_body").orderBy("x0", "line").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("x1").over(across)
    made = made.withColumn("_new", (F.col("_body") & reach.isNotNull() & (F.col("x0") >= reach)).cast("int"))
    made = made.withColumn("_col", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    made = made.withColumn("_lines", F.count(F.lit(1)).over(Window.partitionBy("book", "page", "_body", "_col")))
    least = F.min(F.when(F.col("_body"), F.col("_lines"))).over(page)
    columnar = (F.count_if("_body").over(page) >= 4) & (F.max("_col").over(page) >= 1) & (least >= 2)
    made = made.withColumn("_columnar", columnar).where("_body OR NOT _columnar")
    made = made.withColumn("col", F.when(F.col("_columnar"), F.col("_col")).otherwise(F.lit(0)).cast("int"))
    down = Window.partitionBy("book", "page", "col").orderBy(F.when(F.col("_columnar"), F.col("y0")), F.when(F.col("_columnar"), F.col("x0")), "line")
    return made.withColumn("pos", (F.row_number().over(down) - 1).cast("int")).drop("_body", "_new", "_col", "_lines", "_columnar")


def marked_breaks(lines: DataFrame) -> DataFrame:
    """Lines of columns() with group, the number of the paragraph in the column; blank lines go.

    A paragraph ends at a blank line, beside a heading, at a wide gap, at an
    indent, and after a short line that ends a sentence before a capital.
    """
    run = Window.partitionBy("book", "page", "col")
    order = run.orderBy("pos")
    made = lines.withColumn("_blank", is_blank())
    made = made.withColumn("_median", median_size(F.when(~F.col("_blank"), F.col("size"))).over(run)).withColumn("_widest", F.max(width()).over(run))
    made = made.withColumn("heading", (F.coalesce("_median", F.lit(0.0)) > 0) & (F.col("size") != 0) & (F.col("size") >= HEADING * F.col("_median")) & (F.length(F.trim("text")) <= MOST_HEADING))
    now = F.struct("_blank", "heading", "x0", "y1", "size", height().alias("height"), width().alias("width"), "text")
    made = made.withColumn("_prev", F.lag(now).over(order))
    prev = lambda c: F.col(f"_prev.{c}")
    wide = F.col("y0") - prev("y1") > GAP * ((prev("height") + height()) / 2)
    indent = (F.col("x0") - prev("x0") > INDENT * F.greatest(prev("size"), F.col("size"), F.lit(1.0))) & (F.col("y0") > prev("y1"))
    short = ends_sentence(prev("text")) & (prev("width") < SHORT * F.col("_widest")) & starts_upper(F.col("text"))
    breaks = F.col("_prev").isNull() | prev("_blank") | prev("heading") | F.col("heading") | wide | indent | short
    made = made.where("NOT _blank").withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    return made.withColumn("group", F.sum("_break").over(order) - 1).drop("_blank", "_median", "_widest", "_prev", "_break")


def joined_lines(texts: Column) -> Column:
    """Text of an array of lines: a word that a hyphen parts at a line's end is made whole, unless the next line begins with a capital."""
    marked = F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), X.BREAK)
    return plain(F.translate(F.regexp_replace(marked, f"(?<!-)-{X.BREAK}(?=\\p{{Ll}})", ""), X.BREAK, " "))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(book, para, page, text, n_lines, size, mono): paragraphs of all pages in reading order, numbered from 0 in a book.

    size is that of the first line. A word parted by a hyphen at the end of a
    page is made whole where the next paragraph stands on the next page and
    begins in lower case; that paragraph then goes.
    """
    grouped = marked_breaks(columns(lines)).groupBy("book", "page", "col", "group").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "size", F.length("text").alias("n"), "mono"))).alias("l"))
    chars = F.aggregate("l", F.lit(0), lambda a, x: a + x["n"])
    mono = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["n"] * x["mono"]) / chars
    made = grouped.select(
        "book", "page", "col", "group", joined_lines(F.transform("l", lambda x: x["text"])).alias("text"), F.size("l").alias("n_lines"),
        F.col("l")[0]["size"].alias("size"), mono.alias("mono"), F.transform("l", lambda x: x["size"]).alias("sizes"),
    )
    order = Window.partitionBy("book").orderBy("page", "col", "group")
    after = F.lead(F.struct("page", "text")).over(order)
    joins = (after["page"] == F.col("page") + 1) & F.col("text").rlike("(^|[^-])-$") & after["text"].rlike(r"^\p{Ll}")
    made = made.withColumn("_after", after).withColumn("_joins", F.coalesce(joins, F.lit(False)))
    # A paragraph that has been absorbed absorbs none: of a run of such pairs every second one counts.
    made = made.withColumn("_n", F.row_number().over(order))
    since = F.max(F.when(~F.col("_joins"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    made = made.withColumn("_takes", F.col("_joins") & ((F.col("_n") - F.coalesce(since, F.lit(0))) % 2 == 1))
    made = made.withColumn("_gone", F.coalesce(F.lag("_takes").over(order), F.lit(False)))
    made = made.withColumn("text", F.when(F.col("_takes"), F.concat(F.expr("left(text, length(text) - 1)"), F.col("_after.text"))).otherwise(F.col("text")))
    kept = made.where("NOT _gone").withColumn("para", (F.row_number().over(order) - 1).cast("int"))
    return kept.select("book", "para", "page", "text", "n_lines", "size", "mono", "sizes")


def is_formula() -> Column:
    """Of a paragraph: many mathematical symbols, mostly monospaced, or code that is monospaced in part."""
    return (X.symbol_density(F.col("text")) > DENSE) | (F.col("mono") > MONO) | (X.looks_like_code(F.col("text")) & (F.col("mono") > MONO_CODE))


# -- sections ----------------------------------------------------------------------------------


def by_contents(paras: DataFrame, entries: DataFrame) -> DataFrame:
    """paras with cut, the number of entries (book, page, title) on their page or an earlier one, and its title (null before the first).

    Entries of one page follow each other in the order of n; only the last of them gets paragraphs.
    """
    e = entries.select("book", "page", F.lit(0).alias("_side"), F.col("n").alias("para"), F.struct("title").alias("_e"))
    p = paras.select("book", "page", F.lit(1).alias("_side"), "para", F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), F.struct(*paras.columns).alias("_p"))
    w = Window.partitionBy("book").orderBy("page", "_side", "para").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(e, allowMissingColumns=True)
    found = both.withColumn("cut", F.count("_e").over(w).cast("int")).withColumn("_t", F.last("_e", ignorenulls=True).over(w))
    return found.where("_side = 1").select("_p.*", "cut", F.col("_t.title").alias("title"))


def broken_contents(paras: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, entries, filled, broken): a table of contents is broken if less than half of its sections, the one before it too, have paragraphs."""
    filled = by_contents(paras, entries).groupBy("book").agg(F.countDistinct("cut").alias("filled"))
    counts = entries.groupBy("book").agg(F.count(F.lit(1)).alias("entries"))
    joined = counts.join(filled, "book", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return joined.withColumn("broken", F.col("filled") / (F.col("entries") + 1) < 0.5)


def by_headings(paras: DataFrame) -> DataFrame:
    """paras that aren't headings with cut, the number of headings before them, and the last one's text as title.

    A heading is a lone short line, set in HEADING times the book's median size,
    that doesn't end in a full stop and has a word.
    """
    sizes = paras.select("book", F.explode("sizes").alias("size")).groupBy("book").agg(median_size(F.col("size")).alias("_median"))
    made = paras.join(sizes, "book", "left")
    heading = (F.coalesce("_median", F.lit(0.0)) > 0) & (F.col("n_lines") == 1) & (F.col("size") >= HEADING * F.col("_median")) & (F.length("text") <= MOST_HEADING) & ~F.col("text").endswith(".") & F.col("text").rlike(TWO_LETTERS)
    return _cut_at(made.withColumn("_title", F.when(heading, F.col("text"))).drop("_median"))


def by_markers(paras: DataFrame) -> DataFrame:
    """paras of books with three chapter markers or more, but the markers, with cut and title.

    A short lone line right below a marker that doesn't end in a full stop is
    the chapter's title: it joins the marker's and goes.
    """
    order = Window.partitionBy("book").orderBy("para")
    marker = (F.length(F.trim("text")) <= MOST_MARKER) & (F.col("n_lines") == 1) & F.trim("text").rlike(MARKER)
    made = paras.withColumn("_marker", F.coalesce(marker, F.lit(False)))
    made = made.withColumn("_markers", F.count_if("_marker").over(Window.partitionBy("book"))).where("_markers >= 3")
    below = F.coalesce(F.lag("_marker").over(order), F.lit(False)) & ~F.col("_marker")
    named = below & (F.length(F.trim("text")) <= MOST_TITLE) & ~F.trim("text").endswith(".") & (F.col("n_lines") == 1)
    made = made.withColumn("_named", F.coalesce(named, F.lit(False)))
    full = F.when(F.lead("_named").over(order), F.concat(F.initcap(F.trim("text")), F.lit(" — "), F.trim(F.lead("text").over(order)))).otherwise(F.initcap(F.trim("text")))
    return _cut_at(made.withColumn("_title", F.when(F.col("_marker"), full)), "_named").drop("_marker", "_markers", "_named")


def _cut_at(paras: DataFrame, gone: str | None = None) -> DataFrame:
    """paras without those that are titles, with cut (titles before) and title (the last one)."""
    w = Window.partitionBy("book").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    made = paras.withColumn("cut", F.count("_title").over(w).cast("int")).withColumn("title", F.last("_title", ignorenulls=True).over(w))
    return made.where(F.col("_title").isNull() & (~F.col(gone) if gone else F.lit(True))).drop("_title")


def numbered(cut: DataFrame) -> DataFrame:
    """Paragraphs with section, the number of their cut among those that have paragraphs, from 0."""
    return cut.withColumn("section", (F.dense_rank().over(Window.partitionBy("book").orderBy("cut")) - 1).cast("int")).drop("cut")


def degenerate(cut: DataFrame) -> DataFrame:
    """(book, paras, largest, degenerate): more than 150 paragraphs of which one section has over 60%."""
    sizes = cut.groupBy("book", "cut").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy("book").agg(F.sum("n").alias("paras"), F.max("n").alias("largest"))
    return total.withColumn("degenerate", (F.col("paras") > 150) & (F.col("largest") / F.col("paras") > 0.6))


def sections(paras: DataFrame, entries: DataFrame) -> DataFrame:
    """paras with section, title and way: contents, else headings; markers where those leave one section most of a long book.

    Each book goes one way; all are decided at once, by joins with one row a
    book. Paragraphs and both ways' cuts are written to the shared folder, for each is read several times.
    """
    paras = stored(paras)
    sound = broken_contents(paras, entries).where("NOT broken").select("book")
    first = by_contents(paras, entries).join(sound, "book").withColumn("way", F.lit("contents"))
    second = by_headings(paras).join(sound, "book", "left_anti").withColumn("way", F.lit("headings"))
    cut = stored(first.unionByName(second))
    marked = stored(by_markers(paras))
    failed = degenerate(cut).where("degenerate").select("book")
    enough = marked.groupBy("book").agg(F.countDistinct("cut").alias("n")).where("n >= 3").select("book").join(failed, "book")
    chosen = cut.join(enough, "book", "left_anti").unionByName(marked.join(enough, "book").withColumn("way", F.lit("markers")))
    return numbered(chosen)


# -- blocks of two readings ----------------------------------------------------------------------


def matched_blocks(left: DataFrame, right: DataFrame, same: float = 2.0, most: float = 5.0) -> DataFrame:
    """left (book, page, block, x0, y0, x1, y1) with other, the right block at the same box; null where there is none.

    The one of the same number, if no side differs by more than ``same``, else
    the nearest by the sum of differences, up to ``most``; of equally near ones
    the first. Boxes meet by cells of their corner, so only near ones are compared.
    """
    sides = ("x0", "y0", "x1", "y1")
    cell = lambda c: F.floor(F.col(c) / most)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    r = right.select("book", "page", F.col("block").alias("_b"), *(F.col(c).alias(f"_{c}") for c in sides), cell("x0").alias("_cx"), cell("y0").alias("_cy"))
    near = r.withColumn("_dx", around).withColumn("_dy", around).withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")
    pairs = left.withColumn("_cx", cell("x0")).withColumn("_cy", cell("y0")).join(near, ["book", "page", "_cx", "_cy"])
    gaps = [F.abs(F.col(c) - F.col(f"_{c}")) for c in sides]
    hinted = (F.col("block") == F.col("_b")) & (F.greatest(*gaps) <= same)
    distance = F.when(hinted, -1.0).otherwise(sum(gaps[1:], gaps[0]))
    best = pairs.withColumn("_d", distance).where(F.col("_d") <= most).groupBy("book", "page", "block").agg(F.min(F.struct("_d", "_b")).alias("m"))
    return left.join(best.select("book", "page", "block", F.col("m._b").alias("other")), ["book", "page", "block"], "left")
