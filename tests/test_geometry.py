"""Page geometry on small pages set by hand."""

from lectern.operators import geometry as G

LINES = "book int, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, mono double, page_height double"


def page(texts, number=1, book=1, x=60.0, right=500.0, top=100.0, step=14.0, size=10.0, mono=0.0):
    """Lines one below the other; a text may come with its own (x0, x1, extra gap, size)."""
    out, y = [], top
    for i, t in enumerate(texts):
        text, own = t if isinstance(t, tuple) else (t, {})
        y += own.get("gap", 0.0)
        x0, x1, s = own.get("x", x), own.get("right", right), own.get("size", size)
        out.append((book, number, i, text, x0, own.get("y", y), x1, own.get("y", y) + 12.0, s, own.get("mono", mono), 800.0))
        y += step
    return out


def paras(spark, rows):
    return G.paragraphs(spark.createDataFrame(rows, LINES)).orderBy("para")


def test_margin_lines_that_repeat_go_and_page_numbers_too(spark):
    rows = []
    for n in range(1, 6):
        rows += page([("A Running  HEAD" if n % 2 else "a running head", {"y": 20.0}), "Words of the page.", ("1999" if n == 2 else str(n), {"y": 780.0})], n)
    rows += page([("Only here", {"y": 20.0}), "12", "More words."], 6)
    lines = spark.createDataFrame(rows, LINES)
    assert [(r.key, r.on_pages, r.pages) for r in G.chrome(lines).collect()] == [("a running head", 5, 6)]
    left = {r.text for r in G.without_chrome(lines).collect()}
    assert left == {"Words of the page.", "Only here", "12", "More words."}


def test_two_pages_have_no_chrome(spark):
    rows = page([("head", {"y": 20.0}), "x"], 1) + page([("head", {"y": 20.0}), "x"], 2)
    assert G.chrome(spark.createDataFrame(rows, LINES)).count() == 0


def test_columns_are_read_one_after_the_other(spark):
    rows = []
    for i in range(3):
        rows.append((1, 1, 2 * i, f"left {i}", 50.0, 100.0 + 14 * i, 280.0, 112.0 + 14 * i, 10.0, 0.0, 800.0))
        rows.append((1, 1, 2 * i + 1, f"right {i}", 310.0, 100.0 + 14 * i, 540.0, 112.0 + 14 * i, 10.0, 0.0, 800.0))
    order = [r.text for r in G.columns(spark.createDataFrame(rows, LINES)).orderBy("col", "pos").collect()]
    assert order == ["left 0", "left 1", "left 2", "right 0", "right 1", "right 2"]
    # Three lines make no columns, nor does one line beside two.
    for some in (rows[:3], rows[:1] + rows[2:3] + rows[4:6]):
        assert {r.col for r in G.columns(spark.createDataFrame(some, LINES)).collect()} == {0}


def test_paragraphs_end_at_gaps_indents_headings_and_short_last_lines(spark):
    rows = page([
        ("A Title", {"size": 15.0}), "It begins here and runs on", "to the end of this line.",
        ("A wide gap before this.", {"gap": 30.0}), ("Indented, it is new", {"x": 90.0}), "and goes on",
        ("so it ends.", {"right": 200.0}), "Next one starts.", " ", "after a blank line", "",
    ])
    got = [r.text for r in paras(spark, rows).collect()]
    assert got == ["A Title", "It begins here and runs on to the end of this line.", "A wide gap before this.", "Indented, it is new and goes on so it ends.", "Next one starts.", "after a blank line"]


def test_hyphens_at_ends_of_lines_and_pages(spark):
    rows = page(["They asked them-", "selves whether well-", "Known or a dash --", "was meant by com-"], 1) + page(["piled lists of out-"], 2) + page(["puts."], 3) + page(["New page."], 5)
    got = [(r.page, r.text) for r in paras(spark, rows).collect()]
    # The second page's text is absorbed, so it absorbs nothing itself.
    assert got == [(1, "They asked themselves whether well- Known or a dash -- was meant by compiled lists of out-"), (3, "puts."), (5, "New page.")]


def test_formulas(spark):
    rows = page([("∀x ∈ ∅ ⊂ y ∑", {}), ("plain words of text", {"gap": 40.0}), ("mono spaced", {"gap": 40.0, "mono": 0.7}), ("if (a && b) { c; }", {"gap": 40.0, "mono": 0.4}), ("if (a && b) { c; }", {"gap": 40.0})])
    assert [r.para for r in paras(spark, rows).where(G.is_formula()).collect()] == [0, 2, 3]


def para_rows(spark, rows):
    """(book, para, page, text, n_lines, size) with the columns of paragraphs()."""
    return spark.createDataFrame([(*r, 0.0, [r[5]] * r[4]) for r in rows], "book int, para int, page int, text string, n_lines int, size double, mono double, sizes array<double>")


def test_sections_by_contents(spark):
    p = para_rows(spark, [(1, i, page, f"text {i}", 2, 10.0) for i, page in enumerate((1, 2, 2, 4, 7))])
    entries = spark.createDataFrame([(1, 0, 2, "One"), (1, 1, 3, "Two"), (1, 2, 4, "Three")], "book int, n int, page int, title string")
    got = [(r.para, r.section, r.title) for r in G.numbered(G.by_contents(p, entries)).orderBy("para").collect()]
    assert got == [(0, 0, None), (1, 1, "One"), (2, 1, "One"), (3, 2, "Three"), (4, 2, "Three")]
    assert not G.broken_contents(p, entries).first().broken
    late = spark.createDataFrame([(1, k, 90 + k, "x") for k in range(5)], "book int, n int, page int, title string")
    r = G.broken_contents(p, late).first()
    assert (r.entries, r.filled, r.broken) == (5, 1, True)


def test_sections_by_headings(spark):
    p = para_rows(spark, [(1, 0, 1, "lead", 3, 10.0), (1, 1, 1, "First Part", 1, 13.0), (1, 2, 1, "a", 2, 10.0), (1, 3, 2, "Ends with a stop.", 1, 14.0), (1, 4, 2, "12 7", 1, 14.0), (1, 5, 2, "Second", 1, 20.0), (1, 6, 3, "Third", 1, 20.0), (1, 7, 3, "b", 4, 10.0)])
    got = [(r.para, r.section, r.title) for r in G.numbered(G.by_headings(p)).orderBy("para").collect()]
    assert got == [(0, 0, None), (2, 1, "First Part"), (3, 1, "First Part"), (4, 1, "First Part"), (7, 2, "Third")]


def test_sections_by_markers_where_all_else_fails(spark):
    rows = []
    for k in range(4):
        rows += [(1, 100 * k, k, f"CHAPTER {k + 1}", 1, 10.0), (1, 100 * k + 1, k, f"On the matter {k}", 1, 10.0)]
        rows += [(1, 100 * k + 2 + i, k, f"Body {i} of it.", 3, 10.0) for i in range(50)]
    rows += [(2, i, 1, "short book", 2, 10.0) for i in range(3)]
    p = para_rows(spark, rows)
    none = spark.createDataFrame([], "book int, n int, page int, title string")
    assert {(r.book, r.degenerate) for r in G.degenerate(G.by_headings(p)).collect()} == {(1, True), (2, False)}
    got = {(r.book, r.section, r.title, r.way) for r in G.sections(p, none).collect()}
    assert got == {(1, k, f"Chapter {k + 1} — On the matter {k}", "markers") for k in range(4)} | {(2, 0, None, "headings")}
    # Two markers aren't enough.
    assert G.by_markers(para_rows(spark, rows[:104])).count() == 0


def test_no_lines(spark):
    empty = spark.createDataFrame([], LINES)
    assert G.paragraphs(empty).count() == 0 and G.without_chrome(empty).count() == 0
