"""From document texts to paragraphs, sentences, units and chunks; one row in, arrays or exploded rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.tables import spread


def paragraphs(docs: DataFrame, keep: tuple[str, ...] = (), together: bool = False) -> DataFrame:
    """(doc_id, para, text, and the columns in keep): one row per line, numbered from 0, normalised and cleaned.

    With ``together`` whole documents are dealt by doc_id before they are cut, so what is grouped by doc_id afterwards needs no further shuffle.
    """
    # Nothing composes across a newline, so whole texts are composed: a row of each document passes Python, not one of each line.
    whole = spread(docs.select("doc_id", *keep, "text")).withColumn("text", X.composed(F.coalesce("text", F.lit(""))))
    whole = whole.repartition("doc_id") if together else whole
    lines = X.each(whole, "doc_id", *keep, value=F.split("text", "\n"), names=("para", "raw"))
    return X.settled(lines, "doc_id", *keep, "para", value=X.cleaned(X.reduced(F.col("raw"))), name="text")


def sentences(paras: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, para, sent, text, and the columns in keep) of paragraphs."""
    return X.each(paras, "doc_id", *keep, "para", value=X.sentences(F.col("text")), names=("sent", "text"))


def units(paras: DataFrame) -> DataFrame:
    """(doc_id, para, unit, s0, s1, text) of paragraphs."""
    found = paras.select("doc_id", "para", X.sentences(F.col("text")).alias("s"))
    return X.each(found, "doc_id", "para", value=X.units(F.col("s")), names=("unit", "u")).select("doc_id", "para", "unit", "u.*")


def chunks(paras: DataFrame) -> DataFrame:
    """(doc_id, para, n, s0, s1, text): chunks of paragraphs, numbered in each."""
    found = X.settled(paras, "doc_id", "para", value=X.sentences(F.col("text")), name="s")
    with_units = X.settled(found, "doc_id", "para", value=X.units(F.col("s")), name="u")
    return X.each(with_units, "doc_id", "para", value=X.chunks(F.col("u")), names=("n", "c")).select("doc_id", "para", "n", "c.*")


def chunk_lists(paras: DataFrame) -> DataFrame:
    """(doc_id, para, text, c): paragraphs with the array of their chunks (s0, s1, text)."""
    keep = ("doc_id", "para", "text")
    found = X.settled(paras, *keep, value=X.sentences(F.col("text")), name="s")
    return X.settled(X.settled(found, *keep, value=X.units(F.col("s")), name="u"), *keep, value=X.chunks(F.col("u")), name="c")


def plan(paras: DataFrame) -> DataFrame:
    """chunks with idx, the chunk's number in its document; the only shuffle is by document. Paragraphs marked no_tts, if paras has that column, are left out."""
    order = Window.partitionBy("doc_id").orderBy("para", "n")
    spoken = paras.where("NOT coalesce(no_tts, false)") if "no_tts" in paras.columns else paras
    return chunks(spoken).withColumn("idx", F.row_number().over(order) - 1).drop("n")


def stitched(paras: DataFrame) -> DataFrame:
    """(doc_id, para, text, joined): a paragraph that ends without a pause mark absorbs a next one that begins in lower case.

    Only neighbours matter: an absorbed paragraph's own end decides about the
    next. Empty paragraphs join nothing. The first one's number stays.
    """
    order = Window.partitionBy("doc_id").orderBy("para")
    before = F.lag("text").over(order)
    absorbed = (F.col("text") != "") & (before != "") & ~X.ends_terminal(before) & F.col("text").rlike(r"^\p{Ll}")
    groups = paras.withColumn("_new", (~F.coalesce(absorbed, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(order))
    return groups.groupBy("doc_id", "_g").agg(
        F.min("para").alias("para"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.count(F.lit(1)).alias("joined"),
    ).drop("_g")


def presplit(paras: DataFrame, most_words: int = 2500) -> DataFrame:
    """(doc_id, part, title, first_para, paras, words): documents above most_words words cut into parts of whole paragraphs.

    paras: doc_id, para, text, title (of the document). A part's title is the
    document's with the part's number, else the beginning of its first line. A shorter document is one part and keeps its title.
    """
    sizes = paras.where("text <> ''").select("doc_id", "title", "para", F.size(F.split("text", " ")).alias("w"), F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("t"))
    listed = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", "w", "t"))).alias("ps"), F.sum("w").alias("_all"), F.first("title").alias("title"))
    kind = "array<struct<first:int,n:int,w:int,t:string>>"

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.array(F.struct(p["para"].alias("first"), F.lit(1).alias("n"), p["w"].alias("w"), p["t"].alias("t")))
        grown = F.array(F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"), (last["w"] + p["w"]).alias("w"), last["t"].alias("t")))
        full = (F.size(acc) == 0) | ((F.col("_all") > most_words) & (F.coalesce(last["w"], F.lit(0)) + p["w"] > most_words))
        return F.when(full, F.concat(acc, fresh)).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), grown)).cast(kind)

    parts = listed.select("doc_id", "_all", "title", F.posexplode(F.aggregate("ps", F.array().cast(kind), step)).alias("part", "p"))
    number = (F.col("part") + 1).cast("string")
    named = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.concat("title", F.lit(" — part "), number)).otherwise(F.concat(F.when(F.col("p.t") == "", "Text").otherwise(F.col("p.t")), F.lit(" (part "), number, F.lit(")")))
    return parts.select("doc_id", "part", F.when(F.col("_all") > most_words, named).otherwise(F.col("title")).alias("title"), F.col("p.first").alias("first_para"), F.col("p.n").alias("paras"), F.col("p.w").alias("words"))
