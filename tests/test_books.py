"""Book files, markup, documents and manifests."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from lectern.sources import books as B
from lectern.sources.markup import blocks_of

CONTAINER = '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/pack%20age.opf"/></rootfiles></container>'.replace("%20", "_")
OPF = """<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title> A Lamp </dc:title><dc:creator>N. Body</dc:creator><meta name="cover" content="pic"/></metadata>
<manifest><item id="a" href="one.xhtml" media-type="x"/><item id="b" href="sub/two%20.xhtml" media-type="x"/><item id="pic" href="c.jpg" media-type="image/jpeg"/><item id="gone" href="gone.xhtml"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/><itemref idref="gone"/><itemref idref="unknown"/></spine></package>"""


def epub(cover=b"\xff\xd8\xff123", container=CONTAINER):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", container)
        z.writestr("OPS/pack_age.opf", OPF)
        z.writestr("OPS/one.xhtml", "<html><head><title>no</title></head><body><h1 id='c1'>Chapter</h1><p>First.</p><ul><li>Item one</li><li>Item <b>two</b></li></ul></body></html>")
        z.writestr("OPS/sub/two .xhtml", "<body><div>Bare text of a div</div><div><img src='x'/>loose<p id='k'>In a p</p></div><p>...</p></body>")
        z.writestr("OPS/c.jpg", cover)
    return out.getvalue()


def test_blocks():
    html = "<p>one<b>bold</b> end</p>loose<h2 id='h'>Head</h2><script>var x='</p>';</script><section><span>a span</span> text <table><tr><td>cell</td></tr></table></section><p>open"
    assert [(k, a, " ".join(t.split())) for k, a, t in blocks_of(html)] == [("para", None, "one bold end"), ("title", "h", "Head"), ("para", None, "a span"), ("para", None, "cell"), ("para", None, "open")]
    assert blocks_of("") == [] and blocks_of("<html><body>only text</body></html>") == []


def test_epub(spark):
    files = spark.createDataFrame([("good", bytearray(epub())), ("bad", bytearray(b"no zip")), ("odd", bytearray(epub(b"GIF89a"))), ("none", bytearray(epub(container="<x/>")))], "path string, content binary")
    docs = B.epub_documents(files).where("path = 'good'").orderBy("ordinal").collect()
    assert [(d.title, d.author, d.ordinal, d.html is None) for d in docs] == [("A Lamp", "N. Body", 1, False), ("A Lamp", "N. Body", 2, False), ("A Lamp", "N. Body", 3, True)]
    assert {r.path for r in B.epub_documents(files).where("error IS NOT NULL").collect()} == {"bad", "none"}
    assert [(r.path, r.kind, bytes(r.image)) for r in B.epub_covers(files).collect()] == [("good", "jpg", b"\xff\xd8\xff123")]
    found = B.blocks(B.epub_documents(files).where("path = 'good'"), ["path", "ordinal"]).withColumn("at", F.col("ordinal") * 1000 + F.col("at"))
    got = [(r.section, r.title, r.para, r.text, r.anchor) for r in B.sections(found, "path").orderBy("section", "para").collect()]
    assert got == [(0, None, 0, "Bare text of a div", None), (0, None, 1, "In a p", "k"), (1, "Chapter", 0, "First.", "c1"), (1, "Chapter", 1, "Item one", None), (1, "Chapter", 2, "Item  two", None)]


def test_a_title_alone_is_a_section(spark):
    rows = [(1, 0, "title", "x", "A"), (1, 1, "title", None, "B"), (1, 2, "para", None, "text")]
    got = B.sections(spark.createDataFrame(rows, "book int, at int, kind string, anchor string, text string"), "book").orderBy("section").collect()
    assert [(r.section, r.title, r.para, r.text) for r in got] == [(0, "A", None, None), (1, "B", 0, "text")]


def test_readable(spark):
    rows = [(1, d, "para", "x" * 250) for d in (1, 2)] + [(2, 1, "para", "x" * 900), (2, 2, "title", "y" * 900), (3, 1, "para", "x" * 150), (3, 2, "para", "x" * 210)]
    got = {r.book: r.readable for r in B.readable(spark.createDataFrame(rows, "book int, doc int, kind string, text string"), "book", "doc").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_scan(spark, tmp_path):
    for name in ("a.epub", "sub/b.PDF", "sub/.hid.pdf", ".hid/c.pdf", "1/2/3/4/d.pdf", "1/2/3/4/5/e.pdf", "note.txt"):
        f = tmp_path / "lib" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    got = sorted((r.name, r.size) for r in B.scan_books(spark, str(tmp_path / "lib")).collect())
    assert got == [("a", 5), ("b", 5), ("d", 5)]
    assert [r.content for r in B.scan_books(spark, str(tmp_path / "lib"), 0, True).collect()] == [bytearray(b"12345")]


def test_a_scan_is_listed_and_read_by_tasks(spark, tmp_path):
    """No plan holds a list of files, and a task reads many of them; a name that only Spark's reader leaves out is found."""
    for k in range(90):
        (tmp_path / "a b" / str(k % 3)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "a b" / str(k % 3) / f"_{k}%20.ePub").write_bytes(b"x" * k)
    files = B.scan_books(spark, str(tmp_path / "a b"), content=True)
    assert sorted((r.name, r.size, bytes(r.content)) for r in files.collect()) == sorted((f"_{k}%20", k, b"x" * k) for k in range(90))
    assert {r.path for r in files.collect()} == {f"file:{tmp_path}/a b/{k % 3}/_{k}%20.ePub" for k in range(90)}
    assert not any(str(tmp_path) in f for f in files.inputFiles()) and files.rdd.getNumPartitions() <= 8
    assert B.scan_books(spark, str(tmp_path / "a b"), depth=0).count() == 0


def test_documents_and_manifests(spark, tmp_path):
    sent = lambda t: {"idx": 0, "text": t, "words": t.split()}
    doc = {"title": "T", "sections": [{"title": "One", "paragraphs": [{"idx": 4, "page": 2, "sentences": [sent("a b."), sent("c.")]}, {"no_tts": True, "sentences": []}]}, {"idx": 7, "paragraphs": [{"no_tts": True, "sentences": [sent("x")]}]}]}
    word = [{"w": 0, "s": 0, "e": 90}]
    man = {"rule_version": 2, "sections": [{"idx": 0, "status": "ready", "chunks": [{"idx": 0, "status": "ready", "words": word}]}, {"idx": 1, "status": "pending", "chunks": [{"idx": 0, "words": word}]}]}
    for book, d in (("b1", doc), ("b2", None)):
        (tmp_path / book).mkdir()
        (tmp_path / book / "document.json").write_text(json.dumps(d) if d else "{broken")
        (tmp_path / book / "manifest.json").write_text(json.dumps(man))
    docs = B.read_json(spark, f"{tmp_path}/*/document.json", B.DOCUMENT)
    assert {(r.book, r._bad is None) for r in docs.collect()} == {("b1", True), ("b2", False)}
    rows = B.paragraph_rows(docs.where("book = 'b1'")).orderBy("section", "para").collect()
    assert [(r.section, r.para, r.page, r.no_tts, r.text, r.words) for r in rows] == [(0, 1, None, True, "", 0), (0, 4, 2, False, "a b. c.", 3), (7, 0, None, True, "x", 1)]
    assert [tuple(r) for r in B.silent_sections(B.paragraph_rows(docs.where("book = 'b1'"))).collect()] == [("b1", 7)]
    manifests = B.read_json(spark, f"{tmp_path}/*/manifest.json", B.MANIFEST)
    assert [(r.idx, r.chunks[0].words is None) for r in B.manifest_sections(manifests.where("book = 'b1'")).orderBy("idx").collect()] == [(0, False), (1, True)]
    assert B.manifest_sections(manifests, 5).count() == 0
    near = B.around(docs.select("book", F.transform("sections", lambda s: s.withField("idx", F.coalesce(s["idx"], F.lit(0)))).alias("sections")), manifests, 0).collect()
    assert [(r.book, r.idx, r.status, r.paragraphs, r.chunks) for r in near] == [("b1", 0, "ready", 2, 1)]
    books = spark.createDataFrame([("i", "/p"), ("j", "/q")], "book_id string, path string")
    assert B.book_of(books, "j").first().path == "/q" and B.book_of(books, path="/p").first().book_id == "i"


def test_written_books_are_read_back(spark, tmp_path):
    """Written by tasks, twice: a task that runs again leaves one file of the same bytes."""
    rows = [("a", "T & <t>", "Au", ["<html><body><p>one &amp; two</p></body></html>", None]), ("b", None, None, []), ("c", "only", "", ["<p>x</p>"])]
    books = spark.createDataFrame(rows, "name string, title string, author string, documents array<string>")
    folder = str(tmp_path / "made")
    first, second = (sorted(map(tuple, B.write_epubs(books, folder).collect())) for _ in range(2))
    assert first == second and len(first) == 3
    files = B.scan_books(spark, folder, content=True)
    assert sorted((r.name, r.size) for r in files.collect()) == sorted((p.rpartition("/")[2][:-5], n) for p, n in first)
    read = sorted((r.path.rpartition("/")[2], r.title, r.author, r.ordinal, r.html) for r in B.epub_documents(files).collect())
    assert read == [("a.epub", "T & <t>", "Au", 1, rows[0][3][0]), ("a.epub", "T & <t>", "Au", 2, None), ("c.epub", "only", None, 1, "<p>x</p>")]
    lines = spark.createDataFrame([(["a < b", "c & d > e"],)], "lines array<string>").select(B.paragraphs_html(F.col("lines"))).first()[0]
    assert [t for _, _, t in blocks_of(lines)] == ["a < b", "c & d > e"]


def test_texts_of_blocks_are_normalised_once(spark):
    pages = spark.createDataFrame([(1, "<p>a b</p><p> </p>")], "page_id int, html string")
    found = B.blocks(pages, ["page_id"])
    assert [(r.page_id, r.text) for r in found.collect()] == [(1, "a b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
