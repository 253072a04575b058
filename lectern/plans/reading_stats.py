"""Library and reading-time statistics: orders stand in for sittings, customers for books, labels for progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import stats
from lectern.sources.tables import table

#: "Now" of all statistics, and days that they look back.
AS_OF, DAYS = "2001-08-01", 30


def _sessions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_totalprice").alias("duration_s"), F.col("o_orderdate").alias("ended_at"), F.col("o_orderkey").alias("id"))


def _books(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("format"))


def _progress(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("book_id"), (F.col("quality") * 100).alias("percent"))


def per_book(spark, d):
    return stats.time_per_book(_sessions(spark, d), _books(spark, d), _progress(spark, d))


def library(spark, d):
    rows = _books(spark, d).join(_progress(spark, d), "book_id", "left")
    return rows.select("book_id", "title", F.coalesce("percent", F.lit(0)).alias("percent"))


def totals(spark, d):
    return _sessions(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 1).alias("sec"))


def daily(spark, d):
    return stats.daily(_sessions(spark, d), AS_OF, DAYS)


def streak(spark, d):
    return stats.streaks(_sessions(spark, d), AS_OF)


def global_streak(spark, d):
    """Days in a row with any reading, over all books."""
    return stats.global_streak(_sessions(spark, d), AS_OF, DAYS)


def by_format(spark, d):
    sums = _sessions(spark, d).groupBy("book_id").agg(F.sum("duration_s").alias("sec"), F.count(F.lit(1)).alias("n"))
    return sums.join(_books(spark, d), "book_id").groupBy("format").agg(F.round(F.sum("sec"), 1).alias("sec"), F.sum("n").alias("n"))


def by_state(spark, d):
    return stats.by_state(_books(spark, d), _progress(spark, d))


def bars(spark, d):
    """Days with their share of the largest day, for scaled bars."""
    days = daily(spark, d)
    most = days.agg(F.max("sec").alias("most"))  # one row, of DAYS days
    return days.join(F.broadcast(most)).select("day", "sec", F.round(F.col("sec") / F.col("most"), 6).alias("share"))


def cleaned_sessions(spark, d):
    s = _sessions(spark, d).withColumn("duration_s", F.col("duration_s") - 1000).withColumn("started_at", F.col("ended_at") + F.expr("interval 1 day"))
    return stats.clean_sessions(s, _books(spark, d), F.lit("2000-01-01").cast("timestamp_ntz")).select("id", "book_id", F.round("duration_s", 2).alias("duration_s"), F.col("started_at").cast("date").alias("start_day"), F.col("ended_at").cast("date").alias("end_day"))


def hero(spark, d):
    """The book to go on with: of those begun, the one read last. One row: the feature itself."""
    last = _sessions(spark, d).groupBy("book_id").agg(F.max("ended_at").alias("last_read"))
    begun = _progress(spark, d).where("percent > 0").join(last, "book_id")
    return begun.agg(F.max_by("book_id", F.struct("last_read", "book_id")).alias("book_id"))


def shelf(spark, d):
    """Books on three shelves, each with its own order, in rows of eight."""
    last = _sessions(spark, d).groupBy("book_id").agg(F.max("ended_at").alias("last_read"), F.count(F.lit(1)).alias("n"))
    b = _books(spark, d).join(_progress(spark, d), "book_id", "left").join(last, "book_id", "left")
    kind = F.when(F.coalesce("percent", F.lit(0)) > 0, "reading").when(F.coalesce("n", F.lit(0)) < 5, "generating").otherwise("unread")
    w = Window.partitionBy("format", "shelf").orderBy(F.desc_nulls_last("key"), "book_id")
    made = b.withColumn("shelf", kind).withColumn("key", F.when(F.col("shelf") == "reading", F.unix_date(F.to_date("last_read"))).otherwise(F.col("n")))
    return made.withColumn("at", F.row_number().over(w)).select("format", "shelf", "book_id", "at", F.floor((F.col("at") - 1) / 8).alias("plank"))


def browse(spark, d, needle="0042"):
    return table(spark, d, "customer").where(F.lower("c_name").contains(needle) | F.lower("c_mktsegment").contains(needle)).select("c_custkey", "c_name")


def upsert(spark, d):
    """Each user's last event, by time and then id."""
    changes = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return stats.latest(changes, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def settings(spark, d):
    """Defaults with a user's own values over them: the key k of the last event, where it is a number."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.from_json("props", "map<string,int>").alias("own"))
    last = stats.latest(e, "user_id", ["ts", "event_id"])
    merged = F.map_zip_with(F.create_map(F.lit("k"), F.lit(-1), F.lit("speed"), F.lit(100)), F.col("own"), lambda k, a, b: F.coalesce(b, a))
    return last.select("user_id", merged["k"].alias("k"), merged["speed"].alias("speed"))


def cascade(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("book_id"))
    left = stats.delete_cascading(gone, {"sessions": _sessions(spark, d), "progress": _progress(spark, d)}, "book_id")
    return left["sessions"].groupBy("book_id").agg(F.count(F.lit(1)).alias("sessions")).join(left["progress"], "book_id", "full").select("book_id", F.coalesce("sessions", F.lit(0)).alias("sessions"), "percent")


def book_upsert(spark, d):
    """Books with a new format where labels give one, and books that only labels know."""
    new = table(spark, d, "labels").select(F.col("doc_id").alias("book_id"), F.lit(None).cast("string").alias("title"), F.when(F.col("toxic") == 1, "BLOCKED").alias("format"))
    return stats.merge_partial(_books(spark, d), new, "book_id")


def toggles(spark, d):
    """Highlights after each new one: what it overlaps goes, and it stays if that had another colour."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 97).alias("lo"), (F.length("text") % 4).alias("color")).withColumn("hi", F.col("lo") + 9)
    newest = turns.groupBy("conv_id").agg(F.max_by(F.struct("turn", "lo", "hi", "color"), "turn").alias("n"))
    j = turns.join(newest, "conv_id").withColumn("hit", (F.col("turn") != F.col("n.turn")) & (F.col("lo") <= F.col("n.hi")) & (F.col("n.lo") <= F.col("hi")))
    j = j.withColumn("off", F.bool_or(F.col("hit") & (F.col("color") == F.col("n.color"))).over(Window.partitionBy("conv_id")))
    return j.where(~F.col("hit") & ~((F.col("turn") == F.col("n.turn")) & F.col("off"))).select("conv_id", "turn", "color")


def hues(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("book"), (F.col("l_partkey") * 37 % 360).cast("double").alias("h"), F.col("l_discount").cast("double").alias("d"), F.col("l_tax").alias("t"))
    return stats.hue_vote(c.select("book", "h", (F.col("d") * 10).alias("s"), (F.col("t") * 12).alias("l")))


def percents(spark, d):
    """Percent read of an order: its shipped share of items, 0 to 100."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity") * 100)), 6).alias("percent"))


def sittings(spark, d):
    """Play (view, click) to pause (anything else) per user: active seconds; a second play closes the first."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").isin("view", "click").alias("plays"))
    after = F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    spans = e.withColumn("next", after).where("plays AND next IS NOT NULL").withColumn("ms", F.floor((F.col("next") - F.col("us")) / 1000))
    return spans.where("ms >= 1000").groupBy("user_id").agg(F.count(F.lit(1)).alias("spans"), F.sum("ms").alias("active_ms"))


def reject_payloads(spark, d):
    """Event payloads that aren't an object with a number k above 50 are refused."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.coalesce(F.col("p.k") > 50, F.lit(False)).alias("accepted"))


def changes_only(spark, d):
    """Events of a user at which the type changes: what a poller would fetch."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    return e.where("before IS NULL OR before <> event_type").select("user_id", "event_id", "event_type")


QUERIES = {
    "J2_A5_per_book": per_book, "J1_library": library, "A1_totals": totals, "A2_A3_daily": daily, "A4_streak": streak, "A4_global_streak": global_streak, "J3_A6_by_format": by_format, "A7_by_state": by_state,
    "A24_bars": bars, "P3_clean": cleaned_sessions, "L2_hero": hero, "L4_L8_shelf": shelf, "P4_browse": browse, "X1_upsert": upsert, "X2_settings": settings, "X3_cascade": cascade,
    "X8_book_upsert": book_upsert, "X5_toggle": toggles, "A17_hue": hues, "A18_percent": percents, "Z4_sittings": sittings, "S15_payloads": reject_payloads, "Z12_changes": changes_only,
}
_DAY = f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '{AS_OF}' - {DAYS - 1}, DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day),
s AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS sec FROM orders GROUP BY 1),
r AS (SELECT day, round(coalesce(sec, 0.0), 2) AS sec FROM d LEFT JOIN s USING (day))"""
_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"
ORACLES = {
    "J2_A5_per_book": """
SELECT o.o_custkey AS book_id, c.c_name AS title, c.c_mktsegment AS format,
       coalesce(l.quality, 0) * 100 AS percent,
       round(sum(o.o_totalprice), 2) AS sec, count(*) AS n
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN labels l ON l.doc_id = o.o_custkey
GROUP BY 1, 2, 3, 4""",
    "J1_library": "SELECT c_custkey AS book_id, c_name AS title, coalesce(quality * 100, 0) AS percent FROM customer LEFT JOIN labels ON doc_id = c_custkey",
    "A1_totals": "SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0.0), 1) AS sec FROM orders",
    "A2_A3_daily": f"{_DAY} SELECT * FROM r",
    "A24_bars": f"{_DAY} SELECT day, sec, round(sec / max(sec) OVER (), 6) AS share FROM r",
    "A4_streak": f"""WITH d AS (SELECT DISTINCT o_custkey AS book_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < DATE '{AS_OF}' + 1),
i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY book_id ORDER BY day) AS INTEGER) AS island FROM d),
r AS (SELECT book_id, island, max(day) AS last, count(*) AS n FROM i GROUP BY 1, 2)
SELECT book_id, coalesce(max(n) FILTER (last >= DATE '{AS_OF}' - 1), 0) AS streak FROM r GROUP BY 1""",
    "A4_global_streak": f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < DATE '{AS_OF}' + 1 AND o_orderdate >= DATE '{AS_OF}' - {DAYS - 1}),
i AS (SELECT day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island, day FROM d),
r AS (SELECT island, max(day) AS last, count(*) AS n FROM i GROUP BY 1)
SELECT coalesce(max(n) FILTER (last >= DATE '{AS_OF}' - 1), 0) AS streak FROM r""",
    "J3_A6_by_format": "SELECT c_mktsegment AS format, round(sum(o_totalprice), 1) AS sec, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1",
    "A7_by_state": """WITH b AS (SELECT coalesce(quality * 100, 0) AS p FROM customer LEFT JOIN labels ON doc_id = c_custkey)
SELECT state, count(p) AS n FROM (VALUES ('finished'), ('reading'), ('unread')) v(state) LEFT JOIN b ON state = CASE WHEN p >= 100 THEN 'finished' WHEN p > 0 THEN 'reading' ELSE 'unread' END GROUP BY 1""",
    "P3_clean": """WITH s AS (SELECT o_orderkey AS id, o_custkey AS book_id, least(greatest(o_totalprice - 1000, 0.0), 43200.0) AS duration_s, o_orderdate + INTERVAL 1 DAY AS st, least(o_orderdate, TIMESTAMP '2000-01-01') AS en FROM orders)
SELECT id, book_id, round(duration_s, 2) AS duration_s, CAST(least(st, en) AS DATE) AS start_day, CAST(en AS DATE) AS end_day FROM s WHERE duration_s >= 1 AND book_id IN (SELECT c_custkey FROM customer)""",
    "L2_hero": """WITH l AS (SELECT o_custkey AS book_id, max(o_orderdate) AS last_read FROM orders GROUP BY 1)
SELECT book_id FROM l JOIN labels ON doc_id = book_id WHERE quality > 0 ORDER BY last_read DESC, book_id DESC LIMIT 1""",
    "L4_L8_shelf": """WITH l AS (SELECT o_custkey AS book_id, max(o_orderdate) AS last_read, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT c_custkey AS book_id, c_mktsegment AS format, CASE WHEN coalesce(quality, 0) > 0 THEN 'reading' WHEN coalesce(n, 0) < 5 THEN 'generating' ELSE 'unread' END AS shelf,
  CASE WHEN coalesce(quality, 0) > 0 THEN date_diff('day', DATE '1970-01-01', CAST(last_read AS DATE)) ELSE n END AS key
  FROM customer LEFT JOIN labels ON doc_id = c_custkey LEFT JOIN l ON l.book_id = c_custkey)
SELECT format, shelf, book_id, at_ AS at, CAST(floor((at_ - 1) / 8) AS BIGINT) AS plank FROM (SELECT *, row_number() OVER (PARTITION BY format, shelf ORDER BY key DESC NULLS LAST, book_id) AS at_ FROM b)""",
    "P4_browse": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '0042') OR contains(lower(c_mktsegment), '0042')",
    "X1_upsert": f"WITH {_LAST} SELECT user_id, event_id, event_type, value FROM l",
    "X2_settings": f"WITH {_LAST} SELECT user_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, 100 AS speed FROM l",
    "X3_cascade": """WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), s AS (SELECT o_custkey AS book_id, count(*) AS sessions FROM orders WHERE o_custkey NOT IN (FROM g) GROUP BY 1),
p AS (SELECT doc_id AS book_id, quality * 100 AS percent FROM labels WHERE doc_id NOT IN (FROM g))
SELECT coalesce(s.book_id, p.book_id) AS book_id, coalesce(sessions, 0) AS sessions, percent FROM s FULL JOIN p ON s.book_id = p.book_id""",
    "X8_book_upsert": """SELECT coalesce(c_custkey, doc_id) AS book_id, c_name AS title, coalesce(CASE WHEN toxic = 1 THEN 'BLOCKED' END, c_mktsegment) AS format FROM customer FULL JOIN labels ON doc_id = c_custkey""",
    "X5_toggle": """WITH t AS (SELECT conv_id, turn, length(text) % 97 AS lo, length(text) % 97 + 9 AS hi, length(text) % 4 AS color FROM conversations),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t) WHERE k = 1),
j AS (SELECT t.*, n.turn AS nt, t.turn <> n.turn AND t.lo <= n.hi AND n.lo <= t.hi AS hit, n.color AS nc FROM t JOIN n USING (conv_id)),
o AS (SELECT *, bool_or(hit AND color = nc) OVER (PARTITION BY conv_id) AS off FROM j)
SELECT conv_id, turn, color FROM o WHERE NOT hit AND NOT (turn = nt AND off)""",
    "A17_hue": """WITH c AS (SELECT l_suppkey AS book, CAST(l_partkey * 37 % 360 AS DOUBLE) AS h, l_discount * 10 AS s, l_tax * 12 AS l FROM lineitem),
w AS (SELECT *, s >= 0.12 AND l > 0.05 AND l < 0.95 AS votes, CASE WHEN s >= 0.12 AND l > 0.05 AND l < 0.95 THEN s * (1 - abs(l - 0.33)) ELSE 0 END AS w FROM c),
x AS (SELECT *, unnest([-1, 0, 1]) AS d FROM w),
g AS (SELECT book, (CAST(floor(h / 15) AS INTEGER) % 24 + d + 24) % 24 AS bin, sum(w * CASE WHEN d = 0 THEN 1.0 ELSE 0.5 END) AS score, count(*) FILTER (votes) AS n, sum(w * sin(radians(h))) AS y, sum(w * cos(radians(h))) AS x FROM x GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY round(score, 6) DESC, bin) AS k FROM g), t AS (SELECT book, count(*) AS total FROM c GROUP BY 1)
SELECT book, CAST(CASE WHEN n >= 0.1 * total AND n > 0 THEN round((degrees(atan2(y, x)) + 360) % 360) END AS INTEGER) AS hue FROM b JOIN t USING (book) WHERE k = 1""",
    "A18_percent": "SELECT l_orderkey, round(least(100.0, greatest(0.0, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100)), 6) AS percent FROM lineitem GROUP BY 1",
    "Z4_sittings": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_type IN ('view', 'click') AS plays, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
s AS (SELECT user_id, CAST(floor((nx - us) / 1000) AS BIGINT) AS ms FROM e WHERE plays AND nx IS NOT NULL)
SELECT user_id, count(*) AS spans, CAST(sum(ms) AS BIGINT) AS active_ms FROM s WHERE ms >= 1000 GROUP BY 1""",
    "S15_payloads": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 50, false) AS accepted FROM events",
    "Z12_changes": """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""",
}
