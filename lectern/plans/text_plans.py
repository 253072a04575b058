"""Text queries over documents: a line is a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import paragraphs as P, postings as K
from lectern.sources.tables import new_folder, stored, table

NEEDLE = "tion"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _paras(spark, d):
    return P.paragraphs(_docs(spark, d))


# -- SQL twins: common parts -------------------------------------------------------------


def _ligatures(x: str) -> str:
    for odd, plain in X.LIGATURES.items():
        x = f"replace({x}, chr({ord(odd)}), '{plain}')"
    for odd, plain in ((" ", 10), (" ", 10), ("\x0b", 10), ("\t", 32), (" ", 32)):
        x = f"replace({x}, chr({ord(odd)}), chr({plain}))"
    for odd in ("­", "\r"):
        x = f"replace({x}, chr({ord(odd)}), '')"
    return x


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[ \t\x{{a0}}\x{{2000}}-\x{{200b}}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


NORMAL_SQL = f"regexp_replace({_ligatures('nfc_normalize(raw)')}, '[^{X.kept_class()}]', '', 'g')"
TERMINAL_SQL = r"""regexp_matches({x}, '[,.!?—:;][\s"”’'')\]]*$')"""


def terminal(x: str) -> str:
    return TERMINAL_SQL.replace("{x}", x)


PARAS_SQL = f"""paras AS (
  SELECT doc_id, para, {_clean(NORMAL_SQL)} AS text FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
           CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS INTEGER) AS para FROM documents))"""
_CORE = """rtrim(w, '."''’”)]')"""
_BODY = """rtrim(w, '"''”’)]')"""
_ABBREVIATION = f"""({_CORE} IN ('.', '-', '--', '–', '·', '•', '°') OR trim(lower({_CORE}), '.') IN ({", ".join(f"'{a}'" for a in X.ABBREVIATIONS)})
   OR regexp_matches(w, '^([A-Za-z]\\.)+$') OR regexp_matches({_CORE}, '^\\p{{Lu}}$'))"""
SENTS_SQL = f"""ws AS (
  SELECT doc_id, para, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM paras WHERE text <> ''),
marked AS (
  SELECT *, CASE WHEN regexp_matches({_BODY}, '[.!?]$') AND regexp_matches({_BODY}, '[\\p{{L}}\\p{{N}}]') AND NOT {_ABBREVIATION}
                  AND regexp_matches(lead(w) OVER p, '^[“‘''"(\\[\\-\\p{{Lu}}]') THEN 1 ELSE 0 END AS brk
  FROM ws WINDOW p AS (PARTITION BY doc_id, para ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM marked),
sents AS (SELECT doc_id, para, CAST(s AS INTEGER) AS sent, trim(string_agg(w, ' ' ORDER BY i)) AS text FROM numbered GROUP BY doc_id, para, s)"""
UNITS_SQL = f"""uflag AS (
  SELECT *, coalesce(sum(CASE WHEN {terminal("text")} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM sents),
units AS (
  SELECT doc_id, para, CAST(u AS INTEGER) AS unit, CAST(min(sent) AS INTEGER) AS s0, CAST(max(sent) AS INTEGER) AS s1, string_agg(text, ' ' ORDER BY sent) AS text
  FROM uflag GROUP BY doc_id, para, u)"""


#: From units: their pieces, those of units above MOST_SENTENCE characters cut behind clause marks, else at words.
PIECES_SQL = rf"""cutting AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([,;:—–])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '') AS cut FROM units),
pieces AS (SELECT doc_id, para, unit, s0, s1, text, CASE WHEN length(text) <= {X.MOST_SENTENCE} THEN [text]
  WHEN len(cut) < 2 THEN list_reduce(list_transform(string_split(text, ' '), lambda w: [w]), lambda a, x: CASE WHEN length(a[-1]) >= {X.MOST_CHUNK} THEN list_concat(a, x) ELSE list_concat(a[:-2], [a[-1] || ' ' || x[1]]) END)
  ELSE list_filter(list_transform(string_split(array_to_string(list_transform(cut, lambda p: p || CASE WHEN {terminal('p')} THEN chr(1) ELSE ' ' END), ''), chr(1)), lambda p: trim(p)), lambda p: p <> '') END AS ps FROM cutting)"""
#: From pieces: chunks of each paragraph, by a fold over its units.
CHUNK_FOLD_SQL = f"""folded_chunks AS (
  SELECT doc_id, para, list_reduce(list(CASE WHEN len(ps) > 1 THEN list_transform(ps, lambda p: struct_pack(s0 := s0, s1 := s1, text := p, grows := false)) ELSE [struct_pack(s0 := s0, s1 := s1, text := text, grows := true)] END ORDER BY unit),
    lambda a, x: CASE WHEN a[-1].grows AND x[1].grows AND length(a[-1].text) + 1 + length(x[1].text) <= {X.MOST_CHUNK}
      THEN list_concat(a[:-2], [struct_pack(s0 := a[-1].s0, s1 := x[1].s1, text := a[-1].text || ' ' || x[1].text, grows := true)]) ELSE list_concat(a, x) END) AS c
  FROM pieces GROUP BY doc_id, para)"""


# -- queries -------------------------------------------------------------------------------


def normalize(spark, d):
    return _paras(spark, d)


def word_counts(spark, d):
    return _paras(spark, d).select("doc_id", "para", F.size(F.split("text", " ")).alias("n_words"), F.regexp_count("text", F.lit(r"\S+")).alias("n_tokens"))


def terminals(spark, d):
    return _paras(spark, d).groupBy("doc_id").agg(F.count_if(X.ends_terminal(F.col("text"))).alias("terminal"), F.count(F.lit(1)).alias("paragraphs"))


def formulas(spark, d):
    density = X.symbol_density(F.col("text"))
    return _paras(spark, d).select("doc_id", "para", density.alias("density"), (density > 0.25).alias("formula"))


def code_lines(spark, d):
    return _paras(spark, d).where(X.looks_like_code(F.col("text"))).select("doc_id", "para", F.regexp_count("text", F.lit(r"\{|\}|;|->|=>|::|&&")).alias("hints"))


def sentences(spark, d):
    return P.sentences(_paras(spark, d))


def units(spark, d):
    return P.units(_paras(spark, d))


def stitch(spark, d):
    return P.stitched(_paras(spark, d))


def long_units(spark, d):
    return X.each(P.units(_paras(spark, d)).where(F.length("text") > X.MOST_SENTENCE), "doc_id", "para", "unit", value=X.long_pieces(F.col("text")), names=("piece", "text"))


def chunks(spark, d):
    return P.chunks(_paras(spark, d))


def plan(spark, d):
    """Chunks of documents; paragraphs dense with symbols aren't spoken."""
    paras = _paras(spark, d).withColumn("no_tts", X.symbol_density(F.col("text")) > 0.25)
    return P.plan(paras).select("doc_id", "idx", "para", "s0", "s1", F.length("text").alias("n_chars"))


def presplit(spark, d):
    """Documents as sections, every second one without a title, cut into parts of 2,500 words."""
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    return P.presplit(_paras(spark, d).withColumn("title", title))


def book_words(spark, d):
    sents = P.sentences(_paras(spark, d)).withColumn("n", F.size(F.split("text", " ")))
    speakable = ~X.looks_like_code(F.col("text")) & (X.symbol_density(F.col("text")) <= 0.25)
    return sents.groupBy("doc_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(speakable, F.col("n"))), F.lit(0)).alias("speakable"))


def search(spark, d, cap=30):
    """The first cap hits of each document, in order: a report limit, as in the reader's search box."""
    sents = P.sentences(_paras(spark, d))
    hits = sents.withColumn("at", F.instr(F.lower("text"), NEEDLE) - 1).where("at >= 0")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "sent"))
    return hits.withColumn("rank", first).where(F.col("rank") <= cap).select("doc_id", "para", "sent", "at", "rank")


def _needles(spark, d):
    """What is looked for: six characters from the middle and the first two words of the benchmark's items."""
    t = F.col("text")
    return table(spark, d, "benchmark").select(F.explode(F.array(F.substring(t, 9, 6), F.substring_index(t, " ", 2))).alias("needle"))


def many_hits(spark, d):
    """Every sentence that holds one of many needles, through an index of documents by trigrams that is written once."""
    key = ["doc_id", "para", "sent"]
    sents = stored(P.sentences(_paras(spark, d)))
    path = new_folder(spark, "postings")
    K.write_index(sents, ["doc_id"], path)
    return K.find(K.read_index(spark, path), sents, key, _needles(spark, d))


def snippets(spark, d, radius=48):
    sents = P.sentences(_paras(spark, d)).withColumn("at", F.instr(F.lower("text"), NEEDLE) - 1).where("at >= 0")
    end = F.col("at") + len(NEEDLE)
    low, high = F.greatest(F.lit(0), F.col("at") - radius), F.least(F.length("text"), end + radius)
    pre = F.concat(F.when(low > 0, "…").otherwise(""), F.substring("text", low + 1, F.col("at") - low))
    post = F.concat(F.substring("text", end + 1, high - end), F.when(high < F.length("text"), "…").otherwise(""))
    return sents.select("doc_id", "para", "sent", pre.alias("pre"), F.substring("text", F.col("at") + 1, F.lit(len(NEEDLE))).alias("hit"), post.alias("post"))


def fnv(spark, d):
    h = X.fnv32(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", h.alias("hash"), (h % 10).alias("cloth"), (X.fnv32(F.concat(F.lit("="), "c_name")) % 4 + 82).alias("tilt"))


def join_lines(spark, d):
    """Lines of a document made one text, words parted at line ends by a hyphen made whole."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    joined = F.array_join(lines, X.BREAK)
    whole = F.regexp_replace(joined, f"(?<!-)-{X.BREAK}(?=\\p{{Ll}})", "")
    return _docs(spark, d).select("doc_id", F.trim(F.regexp_replace(F.translate(whole, X.BREAK, " "), " +", " ")).alias("text"))


#: Titles that open a chapter (a fixed rule).
CHAPTER = r"(?i)^(chapter|part|book|unit|lesson|section)\b|^\d+[.:]"


def front_matter(spark, d):
    """Sections of a book (line items of an order, titles from flags) before its first chapter-like title, if it has three of those."""
    title = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("PART "), "l_linenumber")).when(F.col("l_returnflag") == "R", F.concat("l_linenumber", F.lit(": notes"))).otherwise(F.concat(F.lit("partly "), F.lower("l_linestatus")))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    secs = table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("idx"), title.rlike(CHAPTER).alias("is_title"))
    found = secs.groupBy("l_orderkey").agg(F.count_if("is_title").alias("titles"), F.min(F.when(F.col("is_title"), F.col("idx"))).alias("first"))
    return found.select("l_orderkey", "titles", F.when((F.col("titles") >= 3) & (F.col("first") > 0), F.col("first")).otherwise(0).alias("front"))


def head_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.substring(F.col("text").cast("binary"), 1, 4096), 256).alias("content_hash"))


def extractable(spark, d):
    """Whether a source's documents, taken as pages, hold enough text; its nearly empty pages as ranges of numbers."""
    pages = table(spark, d, "documents").select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    made = pages.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.avg("n").alias("mean_chars"), F.median("n").alias("median_chars"),
        F.coalesce(F.sum(F.when(F.col("n") >= 600, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("large_share"),
    )
    heavy = (F.col("mean_chars") < 200) | ((F.col("pages") >= 10) & (F.col("median_chars") < 600) & (F.col("large_share") < 0.2))
    sparse = page_ranges(pages.where("n < 20").select("source", F.col("doc_id").alias("page"))).withColumnRenamed("pages", "sparse")
    return made.withColumn("refused", heavy).join(sparse, "source", "left")


def page_ranges(pages: DataFrame) -> DataFrame:
    """(source, pages): distinct page numbers as ranges, islands of neighbours joined by commas."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("source").orderBy("page"))
    runs = pages.distinct().withColumn("island", island).groupBy("source", "island").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat("lo", F.lit("–"), "hi"))
    return runs.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x["t"]), ", ").alias("pages"))


def ranges(spark, d):
    """Numbers of short documents of a source as ranges."""
    return page_ranges(table(spark, d, "documents").where("length(text) < 900").select("source", (F.col("doc_id") / 20).cast("int").alias("page")))


def title_from_url(spark, d):
    last = F.regexp_extract("url", r"([^/?#]+?)(?:\.[A-Za-z0-9]+)?/?(?:[?#].*)?$", 1)
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(last, "[_\\-]+", " ")).alias("title"))


def nested(spark, d):
    """Conversations as nested rows, turns in order without their texts."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("turns"))
    slim = F.transform("turns", lambda t: t.dropFields("n"))
    return turns.select("conv_id", F.size("turns").alias("n_turns"), F.to_json(slim).alias("slim"))


QUERIES = {
    "T1_T2_normalize": normalize, "T3_T4_words": word_counts, "P1_terminal": terminals, "P5_formula": formulas, "P6_code": code_lines,
    "T8_T27_sentences": sentences, "T10_units": units, "T9_stitch": stitch, "T11_long_units": long_units, "T12_chunks": chunks, "T13_plan": plan,
    "T14_presplit": presplit, "A16_words": book_words, "T23_L3_search": search, "T23_postings": many_hits, "T24_snippet": snippets, "T25_T29_hash": fnv, "T16_T17_join_lines": join_lines,
    "T15_front": front_matter, "S13_hash": head_hash, "A12_extractable": extractable, "A14_ranges": ranges,
    "S17_title": title_from_url, "S9_S16_nested": nested,
}

SYMBOL_SQL = rf"regexp_replace(text, '\s+', '', 'g')"
DENSITY_SQL = f"""CASE WHEN {SYMBOL_SQL} = '' THEN 0.0 ELSE CAST(length({SYMBOL_SQL}) - length(regexp_replace({SYMBOL_SQL}, '[{X.MATH}]', '', 'g')) AS DOUBLE) / length({SYMBOL_SQL}) END"""
CODE_SQL = r"len(regexp_extract_all(text, '\{|\}|;|->|=>|::|&&'))"
_HITS = f"hits AS (SELECT *, CAST(instr(lower(text), '{NEEDLE}') - 1 AS INTEGER) AS at_ FROM sents WHERE instr(lower(text), '{NEEDLE}') > 0)"


def _fnv(x: str) -> str:
    return f"""list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"""


ORACLES = {
    "T1_T2_normalize": f"WITH {PARAS_SQL} SELECT * FROM paras",
    "T3_T4_words": rf"WITH {PARAS_SQL} SELECT doc_id, para, len(string_split(text, ' ')) AS n_words, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM paras",
    "P1_terminal": f"WITH {PARAS_SQL} SELECT doc_id, count(*) FILTER ({terminal('text')}) AS terminal, count(*) AS paragraphs FROM paras GROUP BY 1",
    "P5_formula": f"WITH {PARAS_SQL} SELECT doc_id, para, {DENSITY_SQL} AS density, {DENSITY_SQL} > 0.25 AS formula FROM paras",
    "P6_code": f"WITH {PARAS_SQL} SELECT doc_id, para, {CODE_SQL} AS hints FROM paras WHERE {CODE_SQL} >= 2",
    "T8_T27_sentences": f"WITH {PARAS_SQL}, {SENTS_SQL} SELECT * FROM sents",
    "T10_units": f"WITH {PARAS_SQL}, {SENTS_SQL}, {UNITS_SQL} SELECT * FROM units",
    "T9_stitch": f"""WITH {PARAS_SQL}, f AS (
  SELECT *, CASE WHEN text <> '' AND lag(text) OVER p <> '' AND NOT {terminal('lag(text) OVER p')} AND regexp_matches(text, '^\\p{{Ll}}') THEN 0 ELSE 1 END AS fresh
  FROM paras WINDOW p AS (PARTITION BY doc_id ORDER BY para)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY para) AS g FROM f)
SELECT doc_id, min(para) AS para, string_agg(text, ' ' ORDER BY para) AS text, count(*) AS joined FROM g GROUP BY doc_id, g""",
    "T11_long_units": f"""WITH {PARAS_SQL}, {SENTS_SQL}, {UNITS_SQL}, {PIECES_SQL}
SELECT doc_id, para, unit, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS piece, unnest(ps) AS text FROM pieces WHERE length(text) > {X.MOST_SENTENCE}""",
    "T12_chunks": f"""WITH {PARAS_SQL}, {SENTS_SQL}, {UNITS_SQL}, {PIECES_SQL}, {CHUNK_FOLD_SQL},
x AS (SELECT doc_id, para, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS n, unnest(c) AS c FROM folded_chunks) SELECT doc_id, para, n, c.s0 AS s0, c.s1 AS s1, c.text AS text FROM x""",
    "T13_plan": f"""WITH {PARAS_SQL}, {SENTS_SQL}, {UNITS_SQL}, {PIECES_SQL}, {CHUNK_FOLD_SQL},
x AS (SELECT doc_id, para, generate_subscripts(c, 1) AS n, unnest(c) AS c FROM folded_chunks WHERE (doc_id, para) IN (SELECT (doc_id, para) FROM paras WHERE {DENSITY_SQL} <= 0.25))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, n) - 1 AS INTEGER) AS idx, para, c.s0 AS s0, c.s1 AS s1, CAST(length(c.text) AS INTEGER) AS n_chars FROM x""",
    "T14_presplit": f"""WITH {PARAS_SQL}, w AS (SELECT doc_id, para, text, len(string_split(text, ' ')) AS w, sum(len(string_split(text, ' '))) OVER (PARTITION BY doc_id) AS total FROM paras WHERE text <> ''),
f AS (SELECT doc_id, any_value(total) AS total, list_reduce(list([struct_pack(first := para, n := CAST(1 AS BIGINT), w := CAST(w AS BIGINT), t := text)] ORDER BY para), lambda a, x: CASE WHEN a[-1].w + x[1].w > 2500
    THEN list_concat(a, x) ELSE list_concat(a[:-2], [struct_pack(first := a[-1].first, n := a[-1].n + 1, w := a[-1].w + x[1].w, t := a[-1].t)]) END) AS parts, min(para) AS p0, count(*) AS np, min_by(text, para) AS t0 FROM w GROUP BY 1),
e AS (SELECT doc_id, total, unnest(CASE WHEN total > 2500 THEN parts ELSE [struct_pack(first := p0, n := np, w := CAST(total AS BIGINT), t := t0)] END) AS p, CAST(generate_subscripts(CASE WHEN total > 2500 THEN parts ELSE [struct_pack(first := p0, n := np, w := CAST(total AS BIGINT), t := t0)] END, 1) - 1 AS INTEGER) AS part FROM f)
SELECT doc_id, part, CASE WHEN total <= 2500 THEN CASE WHEN doc_id % 2 = 0 THEN 'Document ' || doc_id END WHEN doc_id % 2 = 0 THEN 'Document ' || doc_id || ' — part ' || (part + 1) ELSE p.t[1:40] || ' (part ' || (part + 1) || ')' END AS title,
  p.first AS first_para, CAST(p.n AS INTEGER) AS paras, CAST(p.w AS INTEGER) AS words FROM e""",
    "A16_words": f"""WITH {PARAS_SQL}, {SENTS_SQL}, n AS (SELECT *, len(string_split(text, ' ')) AS n FROM sents)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, CAST(coalesce(sum(n) FILTER (NOT {CODE_SQL} >= 2 AND {DENSITY_SQL} <= 0.25), 0) AS BIGINT) AS speakable FROM n GROUP BY 1""",
    "T23_L3_search": f"""WITH {PARAS_SQL}, {SENTS_SQL}, {_HITS}
SELECT doc_id, para, sent, at_ AS at, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, sent) AS rank FROM hits) WHERE rank <= 30""",
    "T23_postings": f"""WITH {PARAS_SQL}, {SENTS_SQL}, n AS (
  SELECT DISTINCT lower(trim(needle)) AS needle FROM (SELECT unnest([substr(text, 9, 6), split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)]) AS needle FROM benchmark))
SELECT needle, doc_id, para, sent, CAST(instr(lower(text), needle) - 1 AS INTEGER) AS at FROM sents, n WHERE length(needle) >= 2 AND contains(lower(text), needle)""",
    "T24_snippet": f"""WITH {PARAS_SQL}, {SENTS_SQL}, {_HITS}, e AS (
  SELECT *, greatest(0, at_ - 48) AS low, least(length(text), at_ + {len(NEEDLE)} + 48) AS high FROM hits)
SELECT doc_id, para, sent, CASE WHEN low > 0 THEN '…' ELSE '' END || text[low + 1:at_] AS pre, text[at_ + 1:at_ + {len(NEEDLE)}] AS hit,
       text[at_ + {len(NEEDLE)} + 1:high] || CASE WHEN high < length(text) THEN '…' ELSE '' END AS post FROM e""",
    "T25_T29_hash": f"""SELECT c_custkey, {_fnv('c_name')} AS hash, {_fnv('c_name')} % 10 AS cloth, {_fnv("'=' || c_name")} % 4 + 82 AS tilt FROM customer""",
    "T15_front": r"""WITH t AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS idx,
  regexp_matches(CASE l_returnflag WHEN 'A' THEN 'PART ' || l_linenumber WHEN 'R' THEN l_linenumber || ': notes' ELSE 'partly ' || lower(l_linestatus) END, '(?i)^(chapter|part|book|unit|lesson|section)\b|^\d+[.:]') AS is_title FROM lineitem),
g AS (SELECT l_orderkey, count(*) FILTER (is_title) AS titles, min(idx) FILTER (is_title) AS first FROM t GROUP BY 1)
SELECT l_orderkey, titles, CASE WHEN titles >= 3 AND first > 0 THEN first ELSE 0 END AS front FROM g""",
    "S13_hash": "SELECT doc_id, sha256(encode(text)[1:4096]) AS content_hash FROM documents",
    "T16_T17_join_lines": r"""WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), chr(1)) AS t FROM documents),
w AS (SELECT doc_id, regexp_replace(t, '(^|[^-])-\x{01}(\p{Ll})', '\1\2', 'g') AS t FROM l)
SELECT doc_id, trim(regexp_replace(replace(t, chr(1), ' '), ' +', ' ', 'g')) AS text FROM w""",
    "A12_extractable": """WITH p AS (SELECT source, doc_id, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT source, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS island, doc_id FROM p WHERE n < 20),
r AS (SELECT source, min(doc_id) AS lo, max(doc_id) AS hi FROM s GROUP BY source, island),
t AS (SELECT source, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS sparse FROM r GROUP BY 1),
m AS (SELECT source, count(*) AS pages, avg(n) AS mean_chars, CAST(median(n) AS DOUBLE) AS median_chars, coalesce(CAST(sum(CASE WHEN n >= 600 THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(n), 0), 0) AS large_share FROM p GROUP BY 1)
SELECT m.*, mean_chars < 200 OR (pages >= 10 AND median_chars < 600 AND large_share < CAST(0.2 AS DOUBLE)) AS refused, sparse FROM m LEFT JOIN t USING (source)""",
    "A14_ranges": """WITH s AS (SELECT DISTINCT source, CAST(floor(doc_id / 20) AS INTEGER) AS page FROM documents WHERE length(text) < 900),
i AS (SELECT *, page - row_number() OVER (PARTITION BY source ORDER BY page) AS island FROM s),
r AS (SELECT source, island, min(page) AS lo, max(page) AS hi FROM i GROUP BY 1, 2)
SELECT source, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END, ', ' ORDER BY lo) AS pages FROM r GROUP BY 1""",
    "S17_title": r"""SELECT page_id, trim(regexp_replace(regexp_extract(url, '([^/?#]+?)(?:\.[A-Za-z0-9]+)?/?(?:[?#].*)?$', 1), '[_\-]+', ' ', 'g')) AS title FROM pages""",
    "S9_S16_nested": """SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS slim
FROM conversations GROUP BY 1""",
}
