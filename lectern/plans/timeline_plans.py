"""Time-axis queries: orders are books' sections, line items their chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import intervals, timeline as T
from lectern.sources.tables import table


def sections_of(spark, d):
    """A customer's orders are the sections of a book, numbered by order key."""
    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "book", "o_orderkey": "key"})
    n = F.row_number().over(Window.partitionBy("book").orderBy("key")) - 1
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(
        "book", n.alias("section"), status.alias("status"), F.floor("o_totalprice").cast("long").alias("duration_ms"),
        F.when(F.col("key") % 7 == 0, F.lit(500)).otherwise(0).alias("partial_ms"), "key",
    )


def _chunks(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("chunk"), (F.col("l_quantity") * 100).cast("long").alias("duration_ms"),
                     (F.col("l_returnflag") != "R").alias("done"), F.lit(0).alias("book"), F.col("l_partkey").alias("part"))


def axis(spark, d):
    return T.timeline(sections_of(spark, d))


def chunk_starts(spark, d):
    w = Window.partitionBy("section").orderBy("chunk", "part", "duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    return _chunks(spark, d).select("section", "chunk", "part", (F.sum("duration_ms").over(w) - F.col("duration_ms")).alias("start_ms"), "duration_ms")


def prefix(spark, d):
    c = _chunks(spark, d).groupBy("book", "section", "chunk").agg(F.sum("duration_ms").alias("duration_ms"), F.bool_and("done").alias("done"))
    return T.playable_prefix(c).drop("book")


def gaps(spark, d):
    """Ready sections whose next ready section doesn't follow at once."""
    ready = T.timeline(sections_of(spark, d)).where("ready")
    after = F.lead("start_ms").over(Window.partitionBy("book").orderBy("section"))
    return ready.withColumn("next_start", after).where(F.col("next_start") > F.col("end_ms")).select("book", "section", F.col("ready_start").alias("at"), (F.col("next_start") - F.col("end_ms")).alias("gap_ms"))


def nearest_ready(spark, d):
    """For each section the nearest ready one: itself or a later one, else an earlier one."""
    w = Window.partitionBy("book").orderBy("section")
    ahead = F.min(F.when(F.col("status") == "ready", F.col("section"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    back = F.max(F.when(F.col("status") == "ready", F.col("section"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sections_of(spark, d).select("book", "section", F.coalesce(ahead, back).alias("nearest"))


def probes_of(spark, d):
    return table(spark, d, "events").select(F.col("event_id"), F.col("user_id").alias("book"), (F.col("value") * 20000).cast("long").alias("t"))


def position_at(spark, d):
    """Section and offset of a time on a book's axis; times outside are clamped."""
    line = T.timeline(sections_of(spark, d))
    totals = line.groupBy("book").agg(F.max("end_ms").alias("total"))
    probes = probes_of(spark, d).join(totals, "book").withColumn("t", F.greatest(F.lit(0), F.least("t", "total"))).drop("total")
    found = intervals.as_of(probes, line, ["book"], "t", "start_ms", ["section", "start_ms", "len_ms"], "section")
    return found.select("event_id", "book", "section", F.greatest(F.lit(0), F.least(F.col("t") - F.col("start_ms"), F.col("len_ms"))).alias("offset"))


def chunk_at(spark, d):
    """The chunk at an offset, the first one for offsets before all; words light up 90 ms early."""
    starts = chunk_starts(spark, d).withColumn("start_ms", F.col("start_ms") + 200).withColumn("n", F.col("chunk") * 1000000 + F.col("part"))
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("section"), (F.col("o_totalprice") % 9000).cast("long").alias("t")).withColumn("led", F.col("t") + 90)
    return intervals.as_of(probes, starts, ["section"], "led", "start_ms", ["chunk", "part"], "n", or_first=True).select("section", "t", "chunk", "part")


def ready_to_global(spark, d):
    segments = T.timeline(sections_of(spark, d)).where("ready")
    w = Window.partitionBy("book").orderBy("section")
    segments = segments.withColumn("next_start", F.lead("start_ms").over(w))
    total = segments.groupBy("book").agg(F.max(F.col("ready_start") + F.col("len_ms")).alias("ready_total"))
    probes = probes_of(spark, d).join(total, "book").withColumn("r", F.greatest(F.lit(0), F.least("t", "ready_total"))).drop("ready_total")
    found = intervals.as_of(probes, segments, ["book"], "r", "ready_start", ["ready_start", "len_ms", "start_ms", "next_start"], "section")
    inside = F.col("r") <= F.col("ready_start") + F.col("len_ms")
    jump = F.coalesce("next_start", F.col("start_ms") + F.col("len_ms"))
    return found.select("event_id", "book", F.when(inside, F.col("start_ms") + F.col("r") - F.col("ready_start")).otherwise(jump).alias("global_ms"))


def timings(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.greatest(F.lit(300.0), 350.0 * F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))).alias("duration_ms"))
    return T.word_timings(turns)


def pauses(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("w"))
    return tokens.groupBy("doc_id").agg(F.sum(T.pause_ms(F.col("w"))).alias("pause_ms"), F.count(F.lit(1)).alias("words"))


def summary(spark, d):
    return sections_of(spark, d).groupBy("book").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"),
                                                     F.bool_and(F.col("status").isin("ready", "failed")).alias("done"))


def replan(spark, d):
    """New chunks against old ones by (section, chunk, part, quantity); a section with any stale chunk is reset as a whole.

    The old plan is the line items that weren't returned; of equal old keys the last one counts.
    """
    li = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("l_extendedprice"), F.desc("l_suppkey")))
    old = li.where("l_returnflag <> 'R'").withColumn("_n", last).where("_n = 1").select(*key, F.lit(True).alias("known"), (F.col("l_linestatus") == "F").alias("was_ready"))
    new = li.select(*key, "l_suppkey")
    joined = new.join(old, key, "left").withColumn("kept", F.coalesce("was_ready", F.lit(False)))
    whole = Window.partitionBy("l_orderkey")
    marked = joined.withColumn("reset", F.max((~F.col("kept")).cast("int")).over(whole) == 1)
    return marked.groupBy("l_orderkey").agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept") & F.coalesce("known", F.lit(False))).alias("stale"), F.count_if(F.col("known").isNull()).alias("fresh"), F.bool_or("reset").alias("reset")
    )


def overlaps(spark, d):
    """Highlights of a document that overlap: conversations' turns stand for documents' highlight spans."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 97).alias("lo")).withColumn("hi", F.col("lo") + F.col("turn") * 3)
    other = turns.select("conv_id", F.col("turn").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
    return intervals.overlapping(turns, other, ["conv_id"], 16).where("turn < other").select("conv_id", "turn", "other")


def token_marks(spark, d):
    """Tokens under highlights; where several cover a token the later one shows."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 97).alias("lo")).withColumn("hi", F.col("lo") + F.col("turn") * 3)
    return turns.withColumn("ti", F.explode(F.sequence("lo", "hi"))).groupBy("conv_id", "ti").agg(F.max("turn").alias("shown"))


QUERIES = {
    "W1_W2_timeline": axis, "W3_chunk_starts": chunk_starts, "W4_prefix": prefix, "W6_gaps": gaps, "W8_D11_nearest": nearest_ready,
    "J9_D7_position": position_at, "J10_J11_chunk_at": chunk_at, "D7_ready_to_global": ready_to_global, "D1_D3_D4_timings": timings, "D2_pauses": pauses,
    "A8_A21_summary": summary, "J4_A9_A10_replan": replan, "J7_overlaps": overlaps, "J6_tokens": token_marks,
}

SECTIONS_SQL = """sec AS (
  SELECT o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS section,
         CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
         CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE 0 END AS partial_ms, o_orderkey AS key FROM orders)"""
LINE_SQL = f"""{SECTIONS_SQL}, m AS (
  SELECT *, CASE WHEN status <> 'ready' AND partial_ms > 0 THEN partial_ms ELSE duration_ms END AS len_ms, status = 'ready' OR partial_ms > 0 AS ready FROM sec),
tl AS (SELECT book, section, status, len_ms, ready, CAST(sum(len_ms) OVER w AS BIGINT) - len_ms AS start_ms, CAST(sum(len_ms) OVER w AS BIGINT) AS end_ms,
  CAST(sum(CASE WHEN ready THEN len_ms ELSE 0 END) OVER w AS BIGINT) - CASE WHEN ready THEN len_ms ELSE 0 END AS ready_start
  FROM m WINDOW w AS (PARTITION BY book ORDER BY section ROWS UNBOUNDED PRECEDING))"""
_STARTS = """st AS (SELECT l_orderkey AS section, l_linenumber AS chunk, l_partkey AS part,
  CAST(sum(CAST(l_quantity * 100 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity * 100 AS BIGINT) ROWS UNBOUNDED PRECEDING) AS BIGINT) - CAST(l_quantity * 100 AS BIGINT) AS start_ms,
  CAST(l_quantity * 100 AS BIGINT) AS duration_ms FROM lineitem)"""
PROBES_SQL = "pr AS (SELECT event_id, user_id AS book, CAST(trunc(value * 20000) AS BIGINT) AS t FROM events)"
_PAUSE = """CASE WHEN right(rtrim({x}, '"''”’»)]}'), 1) IN ('.', '!', '?') THEN 200 WHEN right(rtrim({x}, '"''”’»)]}'), 1) IN (',', '—', ':') THEN 100 ELSE 0 END"""
_MARKS = "hl AS (SELECT conv_id, turn, length(text) % 97 AS lo, length(text) % 97 + turn * 3 AS hi FROM conversations)"
ORACLES = {
    "W1_W2_timeline": f"WITH {LINE_SQL} SELECT * FROM tl",
    "W3_chunk_starts": f"WITH {_STARTS} SELECT * FROM st",
    "W4_prefix": """WITH c AS (SELECT l_orderkey AS section, l_linenumber AS chunk, sum(CAST(l_quantity * 100 AS BIGINT)) AS dur, bool_and(l_returnflag <> 'R') AS done FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, min(CAST(done AS INTEGER)) OVER (PARTITION BY section ORDER BY chunk ROWS UNBOUNDED PRECEDING) = 1 AS ok FROM c)
SELECT section, count(*) FILTER (ok) AS playable, CAST(coalesce(sum(dur) FILTER (ok), 0) AS BIGINT) AS playable_ms FROM o GROUP BY 1""",
    "W6_gaps": f"""WITH {LINE_SQL}, r AS (SELECT *, lead(start_ms) OVER (PARTITION BY book ORDER BY section) AS nx FROM tl WHERE ready)
SELECT book, section, ready_start AS at, nx - end_ms AS gap_ms FROM r WHERE nx > end_ms""",
    "W8_D11_nearest": f"""WITH {SECTIONS_SQL} SELECT book, section, coalesce(
  min(section) FILTER (status = 'ready') OVER (PARTITION BY book ORDER BY section ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  max(section) FILTER (status = 'ready') OVER (PARTITION BY book ORDER BY section ROWS UNBOUNDED PRECEDING)) AS nearest FROM sec""",
    "J9_D7_position": f"""WITH {LINE_SQL}, {PROBES_SQL}, tot AS (SELECT book, max(end_ms) AS total FROM tl GROUP BY 1),
q AS (SELECT event_id, book, greatest(0, least(t, total)) AS t FROM pr JOIN tot USING (book)),
x AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY section DESC) AS n FROM q JOIN tl USING (book) WHERE start_ms <= t)
SELECT event_id, book, section, greatest(0, least(t - start_ms, len_ms)) AS "offset" FROM x WHERE n = 1""",
    "J10_J11_chunk_at": f"""WITH {_STARTS}, pr AS (SELECT o_orderkey AS section, CAST(trunc(o_totalprice % 9000) AS BIGINT) AS t FROM orders),
x AS (SELECT section, t, chunk, part, row_number() OVER (PARTITION BY section ORDER BY (start_ms + 200 <= t + 90) DESC,
   CASE WHEN start_ms + 200 <= t + 90 THEN start_ms ELSE -start_ms END DESC, CASE WHEN start_ms + 200 <= t + 90 THEN chunk * 1000000 + part ELSE -(chunk * 1000000 + part) END DESC) AS n FROM pr LEFT JOIN st USING (section))
SELECT section, t, chunk, part FROM x WHERE n = 1""",
    "D7_ready_to_global": f"""WITH {LINE_SQL}, {PROBES_SQL}, sg AS (SELECT *, lead(start_ms) OVER (PARTITION BY book ORDER BY section) AS nx FROM tl WHERE ready),
tot AS (SELECT book, max(ready_start + len_ms) AS total FROM sg GROUP BY 1), q AS (SELECT event_id, book, greatest(0, least(t, total)) AS r FROM pr JOIN tot USING (book)),
x AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ready_start DESC, section DESC) AS n FROM q JOIN sg USING (book) WHERE ready_start <= r)
SELECT event_id, book, CASE WHEN r <= ready_start + len_ms THEN start_ms + r - ready_start ELSE coalesce(nx, start_ms + len_ms) END AS global_ms FROM x WHERE n = 1""",
    "D2_pauses": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents)
SELECT doc_id, CAST(sum({_PAUSE.replace('{x}', 'w')}) AS BIGINT) AS pause_ms, count(*) AS words FROM t GROUP BY 1""",
    "D1_D3_D4_timings": f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS ws FROM conversations),
x AS (SELECT conv_id, turn, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS w, len(ws) AS n, CAST(greatest(300.0, 350.0 * len(ws)) AS DOUBLE) AS d FROM t),
p AS (SELECT *, CASE WHEN w < n - 1 THEN {_PAUSE.replace('{x}', 'word')} ELSE 0 END AS p, length(word) + 2 AS k FROM x),
s AS (SELECT *, CAST(sum(p) OVER a AS DOUBLE) AS total, CAST(sum(k) OVER a AS DOUBLE) AS weight, CAST(sum(k) OVER b AS DOUBLE) - k AS ck, CAST(sum(p) OVER b AS DOUBLE) - p AS cp FROM p
  WINDOW a AS (PARTITION BY conv_id, turn), b AS (PARTITION BY conv_id, turn ORDER BY w ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN total >= d THEN d * CAST(0.5 AS DOUBLE) / total ELSE CAST(1 AS DOUBLE) END AS scale FROM s)
SELECT conv_id, turn, w, CAST(round_even((d - total * scale) * ck / weight + cp * scale, 0) AS BIGINT) AS s,
  CAST(CASE WHEN w = n - 1 THEN round_even(d, 0) ELSE round_even(least(d, (d - total * scale) * (ck + k) / weight + cp * scale), 0) END AS BIGINT) AS e FROM c""",
    "A8_A21_summary": f"""WITH {SECTIONS_SQL} SELECT book, count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, bool_and(status IN ('ready', 'failed')) AS done FROM sec GROUP BY 1""",
    "J4_A9_A10_replan": """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_quantity ORDER BY l_extendedprice DESC, l_suppkey DESC) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1),
j AS (SELECT a.l_orderkey, o.n IS NOT NULL AS known, coalesce(o.l_linestatus = 'F', false) AS kept FROM lineitem a LEFT JOIN o USING (l_orderkey, l_linenumber, l_partkey, l_quantity))
SELECT l_orderkey, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept AND known) AS stale, count(*) FILTER (NOT known) AS fresh, bool_or(NOT kept) AS reset FROM j GROUP BY 1""",
    "J7_overlaps": f"WITH {_MARKS} SELECT a.conv_id, a.turn, b.turn AS other FROM hl a JOIN hl b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.lo <= b.hi AND b.lo <= a.hi",
    "J6_tokens": f"WITH {_MARKS}, t AS (SELECT conv_id, turn, unnest(generate_series(lo, hi)) AS ti FROM hl) SELECT conv_id, ti, max(turn) AS shown FROM t GROUP BY 1, 2",
}
