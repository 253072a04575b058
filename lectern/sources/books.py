"""Book files and their JSON documents and manifests as DataFrames."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.markup import blocks_of
from lectern.sources.tables import spread, stored

SENTENCE = "struct<idx:int,text:string,words:array<string>>"
PARAGRAPH = f"struct<idx:int,page:int,anchor:string,no_tts:boolean,sentences:array<{SENTENCE}>>"
DOCUMENT = f"title string, author string, sections array<struct<idx:int,title:string,paragraphs:array<{PARAGRAPH}>>>"
WORD = "struct<w:int,s:long,e:long>"
CHUNK = f"struct<idx:int,para:int,sentence_range:array<int>,text:string,global_start_ms:long,duration_ms:long,status:string,words:array<{WORD}>>"
MANIFEST = f"rule_version int, planner string, alignment string, sections array<struct<idx:int,title:string,status:string,tts:boolean,duration_ms:long,partial_ms:long,chunks:array<{CHUNK}>>>"

#: Characters of documents that a task holds before it hands them on.
MOST_HELD = 1 << 21
#: Ends of the names of book files, and about how many of them, and of how many bytes, a task reads.
BOOKS = (".pdf", ".epub")
FILES, BYTES = 2000, 1 << 27


# -- files ------------------------------------------------------------------------------


def scan_books(spark: SparkSession, root: str, depth: int = 4, content: bool = False) -> DataFrame:
    """(path, name, size) of the book files under a folder, ``depth`` folders down at most; nothing whose name begins with a dot.

    Tasks list the folders, one level after another, and read the files' contents, if asked for:
    the driver holds no file's name. What one folder holds is listed by one task. Stores that pyarrow doesn't
    know are listed by Spark's reader, whose driver holds all names.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(base)
    uri, base = base.toUri().toString(), base.toString().rstrip("/")
    try:
        pa.fs.FileSystem.from_uri(uri)
        made = _listed(spark, uri, base, depth, content)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        made = _listed_by_spark(spark, root, base, depth)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return made.select("path", name.alias("name"), "size", *(["content"] if content else []))


def _listed_by_spark(spark: SparkSession, root: str, base: str, depth: int) -> DataFrame:
    """(path, size, content) of the book files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,epub,PDF,EPUB,Pdf,Epub}").load(root)
    made = found.withColumn("_parts", F.split(F.expr(f"substring(path, {len(base) + 2})"), "/"))
    made = made.where((F.size("_parts") <= depth + 1) & ~F.exists("_parts", lambda p: p.startswith(".")))
    return made.select("path", F.col("length").alias("size"), "content")


def _listed(spark: SparkSession, uri: str, base: str, depth: int, content: bool) -> DataFrame:
    """(path, size, and content if asked for) of the book files under a folder that pyarrow can open; names of a level are stored, not collected."""

    def opened():
        store, top = pa.fs.FileSystem.from_uri(uri)
        return store, top.rstrip("/"), len(base)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top, cut = opened()
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = [i for i in store.get_file_info(pa.fs.FileSelector(top + folder[cut:])) if not i.base_name.startswith(".")]
                for lo in range(0, len(found), 10_000):
                    some = [i for i in found[lo : lo + 10_000] if not i.is_file or i.base_name.lower().endswith(BOOKS)]
                    yield pa.record_batch([pa.array([f"{folder}/{i.base_name}" for i in some], pa.string()), pa.array([i.size if i.is_file else None for i in some], pa.int64())], ["path", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top, cut = opened()
        for batch in batches:
            lo, contents, held = 0, [], 0
            for at, path in enumerate(batch["path"].to_pylist(), 1):
                with store.open_input_stream(top + path[cut:], compression=None) as f:
                    contents.append(f.read())
                held += len(contents[-1])
                if held >= MOST_HELD or at == batch.num_rows:
                    yield pa.record_batch([*batch.slice(lo, at - lo).columns, pa.array(contents, pa.binary())], ["path", "size", "content"])
                    lo, contents, held = at, [], 0

    folders, levels = spark.createDataFrame([(base,)], "path string"), []
    for _ in range(depth + 1):
        level = stored(folders.mapInArrow(look, "path string, size long"))
        levels.append(level.where("size IS NOT NULL"))
        folders = spread(level.where("size IS NULL").select("path"))
        if folders.isEmpty():
            break
    files = reduce(DataFrame.union, levels)
    if not content:
        return files
    n, held = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(spark.sparkContext.defaultParallelism, n // FILES + 1, held // BYTES + 1)
    return files.repartition(parts, "path").mapInArrow(read, "path string, size long, content binary")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one object each, with book, the name of their folder; files that can't be read have nulls and their text in _bad."""
    made = spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path)
    return made.withColumn("book", F.element_at(F.split(F.input_file_name(), "/"), -2))


# -- EPUB --------------------------------------------------------------------------------


def _local(node) -> str:
    return str(node.tag).rpartition("}")[2].lower()


class Package:
    """What an EPUB's package file says: title, author, documents in reading order, and where a cover may be."""

    def __init__(self, archive: zipfile.ZipFile):
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        self.path = next(n.get("full-path") for n in container.iter() if _local(n) in ("rootfile", "resource") and n.get("full-path"))
        base = posixpath.dirname(self.path)
        nodes = list(ElementTree.fromstring(archive.read(self.path)).iter())
        items = {n.get("id"): n for n in nodes if _local(n) == "item" and n.get("id") and n.get("href")}
        self.href = {i: posixpath.normpath(posixpath.join(base, unquote(n.get("href")))) for i, n in items.items()}
        first = lambda kind: next((t for n in nodes if _local(n) == kind and (t := (n.text or "").strip())), None)
        self.title, self.author = first("title"), first("creator")
        self.spine = [self.href[n.get("idref")] for n in nodes if _local(n) == "itemref" and n.get("idref") in self.href]
        named = [n.get("content") for n in nodes if _local(n) == "meta" and n.get("name") == "cover"]
        marked = [i for i, n in items.items() if "cover-image" in (n.get("properties") or "")]
        images = [i for i, n in items.items() if (n.get("media-type") or "").startswith("image/")]
        self.covers = [self.href[i] for i in (*named[-1:], *marked[-1:], *images[:1]) if i in self.href]


def epub_documents(files: DataFrame) -> DataFrame:
    """(path, title, author, ordinal, html, error) of EPUB files (path, content): one row for each document of the spine, from 1.

    A file that can't be read is one row with its error; a document that the archive lacks has null html.
    """
    kinds = {"path": pa.string(), "title": pa.string(), "author": pa.string(), "ordinal": pa.int32(), "html": pa.string(), "error": pa.string()}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held_chars = [], 0
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                        package, held = Package(z), set(z.namelist())
                        found = [(path, package.title, package.author, i, z.read(h).decode("utf-8", "replace") if h in held else None, None) for i, h in enumerate(package.spine, 1)]
                except Exception as e:  # whatever a broken archive raises
                    found = [(path, None, None, None, None, str(e) or type(e).__name__)]
                rows += found
                held_chars += sum(len(r[4] or "") for r in found)
                if held_chars >= MOST_HELD:
                    yield made(rows)
                    rows, held_chars = [], 0
            if rows:
                yield made(rows)

    return files.select("path", "content").mapInArrow(read, "path string, title string, author string, ordinal int, html string, error string")


def paragraphs_html(lines: Column) -> Column:
    """Lines as the paragraphs of an HTML document."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<html><body>"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "\n"), F.lit("</body></html>"))


def _packed(title: str | None, author: str | None, documents: list[str | None]) -> bytes:
    """An EPUB archive; the same arguments give the same bytes."""
    said = "".join(f"<dc:{kind}>{escape(value)}</dc:{kind}>" for kind, value in (("title", title), ("creator", author)) if value)
    numbers = range(1, len(documents) + 1)
    items = "".join(f'<item id="d{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i in numbers)
    spine = "".join(f'<itemref idref="d{i}"/>' for i in numbers)
    package = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{said}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("META-INF/container.xml", container), ("OPS/book.opf", package), *((f"OPS/{i}.xhtml", d) for i, d in zip(numbers, documents) if d is not None)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_epubs(books: DataFrame, folder: str) -> DataFrame:
    """Writes each row of books (name, title, author, documents: array of HTML) as ``name``.epub into a shared folder; (path, size) of the files. A name may hold folders below it.

    Tasks write where an action on the result runs them. A file is written under
    another name and then moved, so a task that is run again, or twice at
    once, leaves one whole file. A null document is named but not there.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made = {root}
        for batch in batches:
            rows = []
            for name, title, author, documents in zip(batch["name"], batch["title"], batch["author"], batch["documents"]):
                content = _packed(title, author, list(documents))
                path = f"{root}/{name}.epub"
                inner, _, own = path.rpartition("/")
                if inner not in made:
                    store.create_dir(inner, recursive=True)
                    made.add(inner)
                part = f"{inner}/.{own}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, path)
                rows.append((path, len(content)))
            yield pd.DataFrame(rows, columns=["path", "size"])

    return books.select("name", "title", "author", "documents").mapInPandas(write, "path string, size long")


def epub_covers(files: DataFrame) -> DataFrame:
    """(path, image, kind) of EPUB files (path, content) whose first cover candidate that exists is a JPEG or PNG by its first bytes."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        held = set(z.namelist())
                        image = next((z.read(h) for h in Package(z).covers if h in held), None)
                except Exception:
                    image = None
                rows.append((path, image))
            yield pd.DataFrame(rows, columns=["path", "image"])

    found = files.select("path", "content").mapInPandas(read, "path string, image binary")
    start = lambda n: F.hex(F.substring("image", 1, n))
    return found.withColumn("kind", F.when(start(3) == "FFD8FF", "jpg").when(start(4) == "89504E47", "png")).where("kind IS NOT NULL")


# -- markup to sections -----------------------------------------------------------------------


def blocks(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """(key, at, kind, anchor, text): titles and paragraphs of markup in order; see markup.blocks_of. Texts are normalised and cleaned."""
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in key)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, page in enumerate(batch[html].to_pylist()):
                found = blocks_of(page or "")
                rows += [(n, *b) for n, b in enumerate(found)]
                at += [i] * len(found)
            if rows:
                keys = batch.select(key).take(pa.array(at))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*keys.columns, *columns], [*key, "at", "kind", "anchor", "text"])

    raw = pages.select(*key, html).mapInArrow(parse, f"{schema}, at int, kind string, anchor string, text string")
    whole = raw.withColumn("text", X.composed(F.coalesce("text", F.lit(""))))
    clean = X.settled(whole, *key, "at", "kind", "anchor", value=F.btrim(X.reduced(F.col("text")), F.lit(" \t\n\r\f\x0b")), name="text")
    return clean.where((F.col("text") != "") & ((F.col("kind") == "title") | F.col("text").rlike(r"[\p{L}\p{N}]")))


def sections(found: DataFrame, key: str) -> DataFrame:
    """(key, section, title, para, text, anchor): blocks (key, at, kind, anchor, text) cut at titles.

    A title's anchor goes to its section's first paragraph, if that has none. A
    section without title and paragraphs isn't numbered; one with a title only has a row without text.
    """
    order = Window.partitionBy(key).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    title = F.col("kind") == "title"
    made = found.withColumn("_cut", F.count(F.when(title, 1)).over(upto)).withColumn("_head", F.last(F.when(title, F.struct("text", "anchor")), ignorenulls=True).over(upto))
    inner = Window.partitionBy(key, "_cut").orderBy("at")
    made = made.withColumn("para", F.count(F.when(~title, 1)).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    made = made.withColumn("_paras", F.count(F.when(~title, 1)).over(Window.partitionBy(key, "_cut")))
    made = made.where(~title | (F.col("_paras") == 0))
    anchor = F.coalesce(F.nullif("anchor", F.lit("")), F.when(F.col("para") == 0, F.col("_head.anchor")))
    numbered = made.withColumn("section", (F.dense_rank().over(Window.partitionBy(key).orderBy("_cut")) - 1).cast("int"))
    return numbered.select(key, "section", F.col("_head.text").alias("title"), F.when(~title, F.col("para")).cast("int").alias("para"), F.when(~title, F.col("text")).alias("text"), F.when(~title, anchor).alias("anchor"))


def readable(found: DataFrame, book: str, document: str, least: int = 400, doc_least: int = 200, docs: int = 2) -> DataFrame:
    """(book, chars, textual, readable): whether a book's paragraphs hold enough characters, white space apart, in enough documents."""
    chars = F.sum(F.when(F.col("kind") == "para", F.length(F.regexp_replace("text", r"\s+", ""))).otherwise(0))
    per = found.groupBy(book, document).agg(chars.alias("n"))
    made = per.groupBy(book).agg(F.sum("n").alias("chars"), F.count_if(F.col("n") >= doc_least).alias("textual"))
    return made.withColumn("readable", (F.col("chars") >= least) & (F.col("textual") >= docs))


# -- documents and manifests -------------------------------------------------------------------


def paragraph_rows(documents: DataFrame) -> DataFrame:
    """(book, section, title, para, page, anchor, no_tts, text, words): paragraphs of documents (book, sections); a missing idx is the place."""
    s = documents.select("book", F.posexplode("sections").alias("_i", "s"))
    p = s.select("book", F.coalesce("s.idx", "_i").alias("section"), F.col("s.title").alias("title"), F.posexplode_outer("s.paragraphs").alias("_j", "p"))
    text = F.array_join(F.transform(F.coalesce("p.sentences", F.array().cast(f"array<{SENTENCE}>")), lambda x: x["text"]), " ")
    words = F.size(F.flatten(F.transform(F.coalesce("p.sentences", F.array().cast(f"array<{SENTENCE}>")), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))))
    return p.where("p IS NOT NULL").select("book", "section", "title", F.coalesce("p.idx", "_j").alias("para"), "p.page", "p.anchor", F.coalesce("p.no_tts", F.lit(False)).alias("no_tts"), text.alias("text"), words.alias("words"))


def silent_sections(paras: DataFrame) -> DataFrame:
    """(book, section) whose every paragraph isn't spoken."""
    return paras.groupBy("book", "section").agg(F.bool_and("no_tts").alias("n")).where("n").select("book", "section")


def manifest_sections(manifests: DataFrame, section: int | None = None) -> DataFrame:
    """Sections of manifests (book, sections), or the one of that number only; words of sections that aren't ready are left out."""
    s = manifests.select("book", F.explode("sections").alias("s")).select("book", "s.*")
    kept = s if section is None else s.where(F.col("idx") == section)
    return kept.withColumn("chunks", F.when(F.col("status") == "ready", F.col("chunks")).otherwise(F.transform("chunks", lambda c: c.withField("words", F.lit(None).cast(f"array<{WORD}>")))))


def around(documents: DataFrame, manifests: DataFrame, current: int, width: int = 1) -> DataFrame:
    """(book, idx, title, status, paragraphs, chunks): sections near the current one that both sides have."""
    d = documents.select("book", F.explode("sections").alias("d")).select("book", F.col("d.idx").alias("idx"), F.col("d.title").alias("title"), F.size("d.paragraphs").alias("paragraphs"))
    m = manifests.select("book", F.explode("sections").alias("m")).select("book", F.col("m.idx").alias("idx"), F.col("m.status").alias("status"), F.size("m.chunks").alias("chunks"))
    near = lambda df: df.where(F.col("idx").between(current - width, current + width))
    return near(d).join(near(m), ["book", "idx"])


def book_of(books: DataFrame, book: str | None = None, path: str | None = None) -> DataFrame:
    """The row of a book, by id or by path."""
    return books.where(F.col("book_id") == book) if book is not None else books.where(F.col("path") == path)
