"""Event operators over the events table as a replayed batch; tests/test_streaming.py runs them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.sources.tables import table
from lectern.streaming import events as S
from lectern.streaming import timers as T


def _events(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, d, "events").select(F.col("user_id").alias("user"), ms.alias("ts"), F.col("event_id").cast("int").alias("seq"), "event_type", "value", (F.col("event_id") % 9).cast("int").alias("n"))


def _narration(spark, d):
    """Events as narration: errors fail a section, purchases make it ready, signups take it through its other states, other events finish a chunk."""
    e = _events(spark, d)
    other = F.element_at(F.array(*(F.lit(x) for x in ("pending", *S.IN_FLIGHT))), (F.col("seq") % 4 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "signup", other)
    return e.select(F.col("user").alias("book"), (F.col("n") % 2).alias("section"), "ts", "seq", F.when(status.isNotNull(), "status").otherwise("chunk").alias("kind"), status.alias("status"), (F.col("seq") % 40).alias("chunk"))


def progress(spark, d):
    return S.section_progress(_narration(spark, d))


def statuses(spark, d):
    return S.latest_status(_narration(spark, d).where("kind = 'status'"))


def chunks_done(spark, d):
    return S.distinct_chunks(_narration(spark, d)).groupBy("book", "section").agg(F.count(F.lit(1)).alias("chunks"))


def all_done(spark, d):
    return S.finished_books(S.latest_status(_narration(spark, d).where("kind = 'status'")))


def stream_sittings(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("n") == 0, "open").when(F.col("n") == 8, "close").when(F.col("event_type").isin("view", "click"), "play").otherwise("pause")
    return S.sittings(e.select("user", (F.col("seq") % 5).cast("long").alias("book"), "ts", "seq", kind.alias("kind")))


def cards(spark, d):
    return T.pause_cards(_events(spark, d).select("user", "ts", "seq", F.when(F.col("event_type").isin("view", "click"), "play").otherwise("pause").alias("kind")))


def parked(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("n") < 3, "park").when(F.col("event_type") == "error", "ready").otherwise("partial")
    return S.resumptions(e.select(F.col("user").alias("book"), F.lit(0).alias("section"), "ts", "seq", kind.alias("kind"), (F.col("value") * 1000).cast("long").alias("partial_ms")))


def polls(spark, d):
    return S.changed(_events(spark, d).select(F.col("user").alias("book"), "ts", "seq", (F.col("n") % 3).alias("ready")))


def moves(spark, d):
    """Queue moves: sections of 30 are queued, taken, or left outside a window of ten; a minute of the table is a second here."""
    e = _events(spark, d)
    kind = F.when(F.col("n") < 5, "queued").when(F.col("n") == 5, "taken").otherwise("window")
    lo = (F.col("seq") % 23).cast("long")
    return T.graced(e.select(F.col("user").alias("book"), F.floor(F.col("ts") / 60).alias("ts"), "seq", kind.alias("kind"), F.when(F.col("n") < 6, F.col("seq") % 30).cast("long").alias("section"), lo.alias("lo"), (lo + 9).alias("hi")))


def results(spark, d):
    """Results of work on six sections of a book: errors and purchases, a few books deleted and added again."""
    e = _events(spark, d)
    kind = F.when((F.col("n") == 8) & (F.col("seq") % 5 == 0), "deleted").when((F.col("n") == 7) & (F.col("seq") % 2 == 0), "added").when(F.col("event_type") == "purchase", "done").otherwise("error")
    return T.retried(e.select(F.col("user").alias("book"), "ts", "seq", kind.alias("kind"), (F.col("seq") % 6).cast("long").alias("section")))


def toggles(spark, d):
    """Every turn of a conversation as a choice of a colour for ten tokens: all changes of the marks that stand."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("long").alias("ts"), F.lit(0).alias("seq"), F.col("turn").cast("long").alias("mark"), (F.length("text") % 97).cast("long").alias("lo"), (F.length("text") % 4).alias("color"))
    return T.toggled(turns.withColumn("hi", F.col("lo") + 9))


def attempts(spark, d):
    """Events as attempts to plan sections: three in five fail."""
    e = _events(spark, d)
    return T.broken_off(e.select(F.col("user").alias("job"), "ts", "seq", F.col("n").cast("long").alias("section"), F.col("event_type").isin("view", "click").alias("ok")))


def connected(spark, d):
    """What a client gets that connects when half of the time has passed: the last statuses by then, and what comes after."""
    na = _narration(spark, d).where("kind = 'status'")
    middle = na.agg(F.floor((F.min("ts") + F.max("ts")) / 2)).first()[0]
    snapshot = S.latest_status(na.where(F.col("ts") <= middle))
    return S.with_snapshot(na.where(F.col("ts") > middle).select(*snapshot.columns), snapshot)


def restarted(spark, d):
    """Sections as a start finds them."""
    return S.recovered(S.latest_status(_narration(spark, d).where("kind = 'status'")))


def praised(spark, d):
    """Sittings to celebrate at each opening of a user's library (after a book was closed)."""
    opened = _events(spark, d).where("n = 8").select("user", "ts")
    return S.celebrated(stream_sittings(spark, d).select("user", "started", "active_ms"), opened)


QUERIES = {
    "Z1_Z2_Z3_progress": progress, "Z1_status": statuses, "Z13_chunks": chunks_done, "A21_done": all_done, "Z4_stream_sittings": stream_sittings, "Z5_Z6_cards": cards, "Z7_grace": moves, "Z8_retries": results, "Z9_recovered": restarted, "M7_breaker": attempts, "S11_snapshot": connected, "X5_sequence": toggles, "Z14_resume": parked, "Z12_stream_changes": polls, "Z10_praise": praised,
}

_E = """e AS (SELECT user_id AS "user", epoch_us(ts) // 1000 AS ts, CAST(event_id AS INTEGER) AS seq, event_type, value, CAST(event_id % 9 AS INTEGER) AS n FROM events),
na AS (SELECT "user" AS book, n % 2 AS section, ts, seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN ['pending', 'synthesizing', 'aligning', 'encoding'][seq % 4 + 1] END AS status, CAST(seq % 40 AS INTEGER) AS chunk FROM e)"""


def _fold(events: str, first: str, step: str) -> str:
    """CTE ``folded`` (k, r): the state of each key k after all its events x, a being the state before; both are structs of one type."""
    return f"listed AS (SELECT k, list(x ORDER BY x.ts, x.seq) AS xs FROM ({events}) GROUP BY k), folded AS (SELECT k, list_reduce(list_prepend({first}, xs), lambda a, x: {step}) AS r FROM listed)"


_NONE = "CAST([] AS STRUCT(ts BIGINT, v BIGINT)[])"
_FIRED = f"(a.waiting >= 0 AND x.ts >= a.waiting + {T.DEBOUNCE_MS})"
_SHOWN = f"({_FIRED} AND a.active >= {T.MIN_CARD_MS} AND (a.shown < 0 OR a.waiting + {T.DEBOUNCE_MS} - a.shown >= {T.COOLDOWN_MS}))"
_CARD = "struct_pack(ts := {ts}, seq := {seq}, plays := {plays}, active := CAST({active} AS BIGINT), since := CAST({since} AS BIGINT), waiting := CAST({waiting} AS BIGINT), shown := CAST({shown} AS BIGINT), found := {found})"
_CARDS = _fold(
    f"SELECT \"user\" AS k, {_CARD.format(ts='ts', seq='seq', plays="event_type IN ('view', 'click')", active=0, since=-1, waiting=-1, shown=-1, found=_NONE)} AS x FROM e",
    _CARD.format(ts="CAST(-1 AS BIGINT)", seq="CAST(0 AS INTEGER)", plays="false", active=0, since=-1, waiting=-1, shown=-1, found=_NONE),
    _CARD.format(
        ts="x.ts", seq="x.seq", plays="x.plays", active="CASE WHEN NOT x.plays AND a.since >= 0 THEN a.active + x.ts - a.since ELSE a.active END",
        since="CASE WHEN x.plays THEN CASE WHEN a.since < 0 THEN x.ts ELSE a.since END ELSE -1 END",
        waiting=f"CASE WHEN x.plays THEN -1 WHEN a.since >= 0 THEN x.ts WHEN {_FIRED} THEN -1 ELSE a.waiting END",
        shown=f"CASE WHEN {_SHOWN} THEN a.waiting + {T.DEBOUNCE_MS} ELSE a.shown END",
        found=f"CASE WHEN {_SHOWN} THEN list_append(a.found, struct_pack(ts := a.waiting + {T.DEBOUNCE_MS}, v := a.active)) ELSE a.found END",
    ),
)
_PARK = "struct_pack(ts := {ts}, seq := {seq}, kind := {kind}, ms := CAST({ms} AS BIGINT), parked := {parked}, base := CAST({base} AS BIGINT), known := CAST({known} AS BIGINT), found := {found})"
_KNOWN = "greatest(a.known, x.ms)"
_GOES = f"(a.parked AND x.kind <> 'park' AND (x.kind = 'ready' OR {_KNOWN} - a.base >= {S.GROWN_MS}))"
_PARKED = _fold(
    f"SELECT \"user\" AS k, {_PARK.format(ts='ts', seq='seq', kind="CASE WHEN n < 3 THEN 'park' WHEN event_type = 'error' THEN 'ready' ELSE 'partial' END", ms='trunc(value * 1000)', parked='false', base=0, known=0, found=_NONE)} AS x FROM e",
    _PARK.format(ts="CAST(-1 AS BIGINT)", seq="CAST(0 AS INTEGER)", kind="''", ms=0, parked="false", base=0, known=0, found=_NONE),
    _PARK.format(
        ts="x.ts", seq="x.seq", kind="x.kind", ms="x.ms", parked=f"CASE WHEN x.kind = 'park' THEN true WHEN {_GOES} THEN false ELSE a.parked END",
        base="CASE WHEN x.kind = 'park' THEN a.known ELSE a.base END", known=f"CASE WHEN x.kind = 'park' THEN a.known ELSE {_KNOWN} END",
        found=f"CASE WHEN {_GOES} THEN list_append(a.found, struct_pack(ts := x.ts, v := {_KNOWN})) ELSE a.found END",
    ),
)
_PROGRESS = "struct_pack(ts := {ts}, seq := {seq}, chunk := {chunk}, status := {status}, done := {done}, marked := CAST({marked} AS INTEGER), found := {found})"
_ROWS = "CAST([] AS STRUCT(ts BIGINT, status VARCHAR, done INTEGER, marked INTEGER)[])"
_MORE = "CASE WHEN list_contains(a.done, x.chunk) THEN a.done ELSE list_append(a.done, x.chunk) END"
_FRESH = f"(x.status IS NULL AND NOT list_contains(a.done, x.chunk) AND (len(a.done) + 1) % {S.EACH} = 0)"
_SECTIONS = _fold(
    f"SELECT (book, section) AS k, {_PROGRESS.format(ts='ts', seq='seq', chunk='chunk', status='status', done='CAST([] AS INTEGER[])', marked=0, found=_ROWS)} AS x FROM na",
    _PROGRESS.format(ts="CAST(-1 AS BIGINT)", seq="CAST(0 AS INTEGER)", chunk="CAST(0 AS INTEGER)", status="'pending'", done="CAST([] AS INTEGER[])", marked=0, found=_ROWS),
    _PROGRESS.format(
        ts="x.ts", seq="x.seq", chunk="x.chunk", status="coalesce(x.status, a.status)", done=f"CASE WHEN x.status IS NULL THEN {_MORE} WHEN x.status IN {S.TERMINAL} THEN CAST([] AS INTEGER[]) ELSE a.done END",
        marked=f"CASE WHEN x.status IN {S.TERMINAL} THEN 0 WHEN {_FRESH} THEN greatest(a.marked, len(a.done) + 1) ELSE a.marked END",
        found=f"""CASE WHEN x.status IN {S.TERMINAL} THEN list_append(a.found, struct_pack(ts := x.ts, status := x.status, done := CAST(0 AS INTEGER), marked := CAST(0 AS INTEGER)))
          WHEN x.status IS NOT NULL THEN list_append(a.found, struct_pack(ts := x.ts, status := x.status, done := CAST(len(a.done) AS INTEGER), marked := CAST(a.marked AS INTEGER)))
          WHEN {_FRESH} THEN list_append(a.found, struct_pack(ts := x.ts, status := a.status, done := CAST(len(a.done) + 1 AS INTEGER), marked := CAST(greatest(a.marked, len(a.done) + 1) AS INTEGER))) ELSE a.found END""",
    ),
)
_SIT = "struct_pack(ts := {ts}, seq := {seq}, kind := {kind}, own := CAST({own} AS BIGINT), book := CAST({book} AS BIGINT), started := CAST({started} AS BIGINT), active := CAST({active} AS BIGINT), since := CAST({since} AS BIGINT), playing := {playing}, found := {found})"
_SAT = "CAST([] AS STRUCT(book BIGINT, started BIGINT, ended BIGINT, active_ms BIGINT)[])"
_TOTAL = "(a.active + CASE WHEN a.since >= 0 THEN x.ts - a.since ELSE 0 END)"
_ENDS = "x.kind IN ('open', 'close')"
_SITTINGS = _fold(
    f"""SELECT "user" AS k, {_SIT.format(ts='ts', seq='seq', kind="CASE WHEN n = 0 THEN 'open' WHEN n = 8 THEN 'close' WHEN event_type IN ('view', 'click') THEN 'play' ELSE 'pause' END", own='seq % 5', book=-1, started=0, active=0, since=-1, playing='false', found=_SAT)} AS x FROM e""",
    _SIT.format(ts="CAST(-1 AS BIGINT)", seq="CAST(0 AS INTEGER)", kind="''", own=0, book=-1, started=0, active=0, since=-1, playing="false", found=_SAT),
    _SIT.format(
        ts="x.ts", seq="x.seq", kind="x.kind", own="x.own", book="CASE x.kind WHEN 'open' THEN x.own WHEN 'close' THEN -1 ELSE a.book END", started="CASE WHEN x.kind = 'open' THEN x.ts ELSE a.started END",
        active=f"CASE WHEN {_ENDS} THEN 0 WHEN x.kind = 'pause' THEN {_TOTAL} ELSE a.active END",
        since=f"CASE WHEN x.kind = 'open' THEN CASE WHEN a.playing THEN x.ts ELSE -1 END WHEN x.kind IN ('close', 'pause') THEN -1 WHEN a.book >= 0 AND a.since < 0 THEN x.ts ELSE a.since END",
        playing="CASE x.kind WHEN 'play' THEN true WHEN 'pause' THEN false ELSE a.playing END",
        found=f"CASE WHEN {_ENDS} AND a.book >= 0 AND {_TOTAL} >= {S.MIN_SITTING_MS} THEN list_append(a.found, struct_pack(book := a.book, started := a.started, ended := x.ts, active_ms := {_TOTAL})) ELSE a.found END",
    ),
)
_GRACE = "struct_pack(ts := CAST({ts} AS BIGINT), seq := {seq}, kind := {kind}, ends := CAST({ends} AS BIGINT), found := {found})"
_MOVES = "CAST([] AS STRUCT(ts BIGINT, action VARCHAR)[])"
# State of a section: ends is -2 where it isn't queued, -1 where it is wanted, else the end of its grace.
_LAPSED = "(a.ends >= 0 AND x.ts > a.ends)"
_ENDS = f"CASE WHEN {_LAPSED} THEN -2 ELSE a.ends END"
_FOUND = f"CASE WHEN {_LAPSED} THEN list_append(a.found, struct_pack(ts := a.ends, action := 'dropped')) ELSE a.found END"
_GRACED = """m AS (SELECT "user" AS book, ts // 60 AS ts, seq, CASE WHEN n < 5 THEN 'queued' WHEN n = 5 THEN 'taken' ELSE 'window' END AS kind, CAST(seq % 30 AS BIGINT) AS section, seq % 23 AS lo FROM e),
s AS (SELECT DISTINCT book, section FROM m WHERE kind = 'queued'),
y AS (SELECT book, section, ts, seq, kind FROM m WHERE kind <> 'window' UNION ALL SELECT book, s.section, ts, seq, CASE WHEN s.section BETWEEN lo AND lo + 9 THEN 'in' ELSE 'out' END FROM m JOIN s USING (book) WHERE kind = 'window'), """ + _fold(
    f"SELECT (book, section) AS k, {_GRACE.format(ts='ts', seq='seq', kind='kind', ends=-2, found=_MOVES)} AS x FROM y",
    _GRACE.format(ts=-1, seq="CAST(0 AS INTEGER)", kind="''", ends=-2, found=_MOVES),
    _GRACE.format(
        ts="x.ts", seq="x.seq", kind="x.kind",
        ends=f"CASE x.kind WHEN 'queued' THEN greatest({_ENDS}, -1) WHEN 'taken' THEN -2 WHEN 'in' THEN least({_ENDS}, -1) ELSE CASE WHEN {_ENDS} > -2 THEN x.ts + {T.GRACE_MS} ELSE -2 END END",
        found=f"CASE WHEN x.kind = 'in' AND {_ENDS} >= 0 THEN list_append({_FOUND}, struct_pack(ts := x.ts, action := 'warmed')) WHEN x.kind = 'out' AND {_ENDS} = -1 THEN list_append({_FOUND}, struct_pack(ts := x.ts, action := 'cooled')) ELSE {_FOUND} END",
    ),
)
_GRACE_END = "CASE WHEN r.ends >= 0 AND (SELECT max(ts) FROM m) > r.ends THEN list_append(r.found, struct_pack(ts := r.ends, action := 'dropped')) ELSE r.found END"
_RETRY = "struct_pack(ts := CAST({ts} AS BIGINT), seq := {seq}, kind := {kind}, section := CAST({section} AS BIGINT), gone := CAST({gone} AS BIGINT), tries := {tries}, found := {found})"
_TRIED = "CAST([] AS STRUCT(section BIGINT, ts BIGINT, action VARCHAR, tries INTEGER)[])"
_ALIVE = f"(x.kind IN ('done', 'error') AND NOT (a.gone >= 0 AND x.ts <= a.gone + {T.GONE_MS}))"
_TRY = "(a.tries[x.section + 1] + 1)"
_RETRIED = _fold(
    f"""SELECT "user" AS k, {_RETRY.format(ts='ts', seq='seq', kind="CASE WHEN n = 8 AND seq % 5 = 0 THEN 'deleted' WHEN n = 7 AND seq % 2 = 0 THEN 'added' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END", section='seq % 6', gone=-1, tries='[0, 0, 0, 0, 0, 0]', found=_TRIED)} AS x FROM e""",
    _RETRY.format(ts=-1, seq="CAST(0 AS INTEGER)", kind="''", section=0, gone=-1, tries="[0, 0, 0, 0, 0, 0]", found=_TRIED),
    _RETRY.format(
        ts="x.ts", seq="x.seq", kind="x.kind", section="x.section", gone=f"CASE WHEN x.kind = 'deleted' THEN x.ts WHEN x.kind = 'added' OR (a.gone >= 0 AND x.ts > a.gone + {T.GONE_MS}) THEN -1 ELSE a.gone END",
        tries=f"CASE WHEN x.kind = 'deleted' THEN [0, 0, 0, 0, 0, 0] WHEN {_ALIVE} THEN list_transform(a.tries, lambda t, i: CASE WHEN i - 1 <> x.section THEN t WHEN x.kind = 'done' OR t >= {T.RETRIES} THEN 0 ELSE t + 1 END) ELSE a.tries END",
        found=f"CASE WHEN {_ALIVE} THEN list_append(a.found, struct_pack(section := x.section, ts := x.ts, action := CASE WHEN x.kind = 'done' THEN 'ready' WHEN {_TRY} <= {T.RETRIES} THEN 'retry' ELSE 'failed' END, tries := CAST({_TRY} AS INTEGER))) ELSE a.found END",
    ),
)
_TOGGLE = "struct_pack(ts := CAST({ts} AS BIGINT), seq := 0, lo := CAST({lo} AS BIGINT), color := CAST({color} AS BIGINT), marks := {marks}, found := {found})"
_MARKS = "CAST([] AS STRUCT(mark BIGINT, lo BIGINT, color BIGINT)[])"
_CHANGES = "CAST([] AS STRUCT(mark BIGINT, ts BIGINT, action VARCHAR)[])"
_HIT = "list_filter(a.marks, lambda m: m.lo <= x.lo + 9 AND x.lo <= m.lo + 9)"
_STANDS = f"(len(list_filter({_HIT}, lambda h: h.color = x.color)) = 0)"
_TOGGLED = _fold(
    f"SELECT conv_id AS k, {_TOGGLE.format(ts='turn', lo='length(text) % 97', color='length(text) % 4', marks=_MARKS, found=_CHANGES)} AS x FROM conversations",
    _TOGGLE.format(ts=-1, lo=0, color=0, marks=_MARKS, found=_CHANGES),
    _TOGGLE.format(
        ts="x.ts", lo="x.lo", color="x.color",
        marks=f"list_filter(a.marks, lambda m: NOT (m.lo <= x.lo + 9 AND x.lo <= m.lo + 9)) || CASE WHEN {_STANDS} THEN [struct_pack(mark := x.ts, lo := x.lo, color := x.color)] ELSE {_MARKS} END",
        found=f"a.found || list_transform({_HIT}, lambda m: struct_pack(mark := m.mark, ts := x.ts, action := 'removed')) || CASE WHEN {_STANDS} THEN [struct_pack(mark := x.ts, ts := x.ts, action := 'added')] ELSE {_CHANGES} END",
    ),
)
ORACLES = {
    "X5_sequence": f"""WITH {_TOGGLED}, u AS (SELECT k, unnest(r.found) AS f FROM folded) SELECT k AS book, f.mark AS mark, f.ts AS ts, f.action AS action FROM u""",
    "M7_breaker": f"""WITH {_E}, a AS (SELECT "user" AS job, ts, seq, n AS section, event_type IN ('view', 'click') AS ok FROM e),
r AS (SELECT *, count(*) FILTER (NOT ok) OVER l = {T.MOST_FAILURES} AS full_ FROM a WINDOW l AS (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN {T.MOST_FAILURES - 1} PRECEDING AND CURRENT ROW)),
b AS (SELECT *, coalesce(bool_or(full_) OVER (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS off FROM r)
SELECT job, CAST(section AS BIGINT) AS section, ts, CASE WHEN off THEN 'breaker' WHEN ok THEN 'model' ELSE 'failed' END AS outcome FROM b""",
    "S11_snapshot": f"""WITH {_E}, s AS (SELECT * FROM na WHERE status IS NOT NULL), m AS (SELECT (min(ts) + max(ts)) // 2 AS middle FROM s),
o AS (SELECT s.*, row_number() OVER (PARTITION BY book, section ORDER BY ts DESC, seq DESC) AS k FROM s, m WHERE ts <= middle)
SELECT book, section, status, ts, 0 AS origin FROM o WHERE k = 1 UNION ALL SELECT book, section, status, ts, 1 FROM s, m WHERE ts > middle""",
    "Z1_status": f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY book, section ORDER BY ts DESC, seq DESC) AS k FROM na WHERE status IS NOT NULL) SELECT book, section, status, ts FROM r WHERE k = 1",
    "Z5_Z6_cards": f"""WITH {_E}, {_CARDS}, z AS (SELECT max(ts) AS ts FROM e), w AS (
SELECT k, CASE WHEN r.waiting >= 0 AND z.ts >= r.waiting + {T.DEBOUNCE_MS} AND r.active >= {T.MIN_CARD_MS} AND (r.shown < 0 OR r.waiting + {T.DEBOUNCE_MS} - r.shown >= {T.COOLDOWN_MS})
  THEN list_append(r.found, struct_pack(ts := r.waiting + {T.DEBOUNCE_MS}, v := r.active)) ELSE r.found END AS found FROM folded, z),
u AS (SELECT k, unnest(found) AS f FROM w) SELECT k AS "user", f.ts AS ts, f.v AS active_ms FROM u""",
    "Z14_resume": f"WITH {_E}, {_PARKED}, u AS (SELECT k, unnest(r.found) AS f FROM folded) SELECT k AS book, 0 AS section, f.ts AS ts, f.v AS partial_ms FROM u",
    "Z1_Z2_Z3_progress": f"WITH {_E}, {_SECTIONS}, u AS (SELECT k, unnest(r.found) AS f FROM folded) SELECT k[1] AS book, k[2] AS section, f.ts AS ts, f.status AS status, f.done AS done, f.marked AS marked FROM u",
    "Z4_stream_sittings": f"""WITH {_E}, {_SITTINGS}, u AS (SELECT k, unnest(r.found) AS f FROM folded) SELECT k AS "user", f.book AS book, f.started AS started, f.ended AS ended, f.active_ms AS active_ms FROM u""",
    "Z10_praise": f"""WITH {_E}, {_SITTINGS}, u AS (SELECT k, unnest(r.found) AS f FROM folded), o AS (SELECT "user", ts FROM e WHERE n = 8),
m AS (SELECT "user", ts, arg_max(f, f.started) AS f FROM o JOIN u ON u.k = o."user" AND f.active_ms >= {T.MIN_CARD_MS} AND f.started <= ts GROUP BY 1, 2)
SELECT "user", ts, f.started AS started, f.active_ms AS active_ms FROM m WHERE ts - (f.started + f.active_ms) <= {S.STALE_MS}""",
    "Z13_chunks": f"""WITH {_E}, r AS (SELECT *, count(*) FILTER (status = 'ready') OVER (PARTITION BY book, section ORDER BY ts, seq) AS made FROM na)
SELECT book, section, count(DISTINCT (made, chunk)) AS chunks FROM r WHERE status IS NULL GROUP BY 1, 2""",
    "A21_done": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY book, section ORDER BY ts DESC, seq DESC) AS k FROM na WHERE status IS NOT NULL)
SELECT book FROM r WHERE k = 1 GROUP BY 1 HAVING bool_and(status IN {S.TERMINAL})""",
    "Z7_grace": f"""WITH {_E}, {_GRACED}, u AS (SELECT k, unnest({_GRACE_END}) AS f FROM folded) SELECT k[1] AS book, k[2] AS section, f.ts AS ts, f.action AS action FROM u""",
    "Z8_retries": f"""WITH {_E}, {_RETRIED}, u AS (SELECT k, unnest(r.found) AS f FROM folded) SELECT k AS book, f.section AS section, f.ts AS ts, f.action AS action, f.tries AS tries FROM u""",
    "Z9_recovered": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY book, section ORDER BY ts DESC, seq DESC) AS k FROM na WHERE status IS NOT NULL)
SELECT book, section, CASE WHEN status = 'ready' THEN 'ready' ELSE 'pending' END AS status, ts, status NOT IN ('ready', 'pending') AS reset FROM r WHERE k = 1""",
    "Z12_stream_changes": f"""WITH {_E}, c AS (SELECT "user" AS book, ts, n % 3 AS ready, lag(n % 3) OVER (PARTITION BY "user" ORDER BY ts, seq) AS p FROM e) SELECT book, ts, ready FROM c WHERE p IS NULL OR p <> ready""",
}
