"""Timers in event time: streams with late and reordered events, ends of grace, retries over a restart, and state that shrinks."""

import random

import pytest

from lectern.streaming import events as S
from lectern.streaming import timers as T

PLAY = "user long, ts long, seq int, kind string"
MOVE = "book long, ts long, seq int, kind string, section long, lo long, hi long"
RESULT = "book long, ts long, seq int, kind string, section long"


#: Event times are counted from here: a stream's watermark begins at 0, and what isn't later than it is late.
START = 1_000_000


def later(rows, at=1):
    return [(*r[:at], r[at] + START, *r[at + 1 :]) for r in rows]


def earlier(rows, at=1):
    return sorted((*r[:at], r[at] - START, *r[at + 1 :]) for r in map(tuple, rows))


def write(spark, folder, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder), mode="append")


def run(spark, tmp_path, schema, batches, operator, **options):
    """Rows of the operator over a stream of one file a batch."""
    write(spark, tmp_path / "in", schema, (later(b, schema.split(", ").index("ts long")) for b in batches))
    name = f"t{random.randrange(10**9)}"
    stream = operator(S.read_events(spark, str(tmp_path / "in"), schema, files=1), **options)
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name).collect(), query


PAUSES = [
    (1, 0, 0, "play"), (1, 70_000, 0, "pause"), (1, 70_500, 0, "play"),  # resumed too soon
    (1, 80_000, 0, "pause"), (1, 90_000, 0, "play"),  # the first card
    (1, 95_000, 0, "pause"), (1, 99_000, 0, "play"),  # within the cooldown
    (1, 145_000, 0, "pause"),  # nothing follows: a timer shows the second card
    (2, 0, 0, "play"), (2, 30_000, 0, "pause"), (2, 90_000, 0, "play"),  # too short
    (3, 0, 0, "play"), (3, 120_000, 0, "pause"),  # nothing follows
]
CARDS = [(1, 81_200, 79_500), (1, 146_200, 130_500), (3, 121_200, 120_000)]


def test_a_pause_with_nothing_after_it_gives_its_card(spark, tmp_path):
    rows = sorted(PAUSES, key=lambda r: r[1])
    clock = (9, 200_000, 0, "pause")  # another reader's event moves the watermark on
    got, _ = run(spark, tmp_path, PLAY, [rows[:5], rows[5:9], rows[9:], [clock]], T.pause_cards)
    assert earlier(got) == CARDS
    batch = spark.createDataFrame([*PAUSES, clock], PLAY)
    assert sorted(map(tuple, T.pause_cards(batch).collect())) == CARDS
    # A batch closes at its last time: one that ends before a timer is due gives no card.
    short = spark.createDataFrame([r for r in PAUSES if r[0] == 3], PLAY)
    assert T.pause_cards(short).collect() == []


def test_reordered_events_give_the_same_cards_and_late_ones_none(spark, tmp_path):
    rows = sorted(PAUSES, key=lambda r: r[1])
    rng = random.Random(5)
    # Up to 60 s out of order, in files of four.
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(60_000))
    batches = [mixed[i : i + 4] for i in range(0, len(mixed), 4)] + [[(9, 400_000, 0, "pause")], [(9, 450_000, 0, "pause")], [(3, 119_000, 0, "pause"), (9, 500_000, 0, "pause")]]
    got, _ = run(spark, tmp_path, PLAY, batches, T.pause_cards, delay="60 seconds")
    assert earlier(got) == CARDS


MOVES = [
    [(1, 0, i, "queued", i, None, None) for i in range(5)] + [(1, 1_000, 0, "window", None, 0, 1)],  # 2, 3 and 4 cool
    [(1, 100_000, 0, "window", None, 1, 2)],  # 0 cools, 2 warms, the grace of 3 and 4 begins anew
    [(1, 200_000, 0, "taken", 3, None, None), (2, 200_000, 0, "queued", 7, None, None), (2, 200_000, 1, "window", None, 8, 9)],
    [(1, 580_000, 0, "taken", 4, None, None), (2, 680_001, 0, "queued", 7, None, None)],  # 4 in time; 7 of book 2 too late
    [(5, 2_000_000, 0, "taken", 1, None, None)],
]
GRACED = [
    (1, 0, 100_000, "cooled"), (1, 0, 580_000, "dropped"), (1, 2, 1_000, "cooled"), (1, 2, 100_000, "warmed"), (1, 3, 1_000, "cooled"),
    (1, 4, 1_000, "cooled"), (2, 7, 200_000, "cooled"), (2, 7, 680_000, "dropped"),
]


def test_work_outside_the_window_is_dropped_when_its_grace_ends(spark, tmp_path):
    got, _ = run(spark, tmp_path, MOVE, MOVES, T.graced)
    assert earlier(got, 2) == GRACED
    batch = spark.createDataFrame([r for b in MOVES for r in b], MOVE)
    assert sorted(map(tuple, T.graced(batch).collect())) == GRACED


RESULTS = [
    [(1, 10, 0, "error", 0), (1, 20, 0, "error", 0), (1, 21, 0, "error", 5), (2, 25, 0, "error", 1)],
    [(1, 30, 0, "error", 0), (1, 35, 0, "done", 5), (2, 40, 0, "deleted", None), (2, 50, 0, "error", 1)],
    [(1, 60, 0, "error", 5), (1, 61, 0, "error", 0), (2, 65, 0, "done", 1)],
    [(2, 70, 0, "added", None), (2, 80, 0, "error", 1), (3, 60_000, 0, "done", 9)],
    [(3, 90_000, 0, "done", 9)],
]
RETRIED = [
    (1, 0, 10, "retry", 1), (1, 0, 20, "retry", 2), (1, 0, 30, "failed", 3), (1, 0, 61, "retry", 1), (1, 5, 21, "retry", 1), (1, 5, 35, "ready", 2), (1, 5, 60, "retry", 1),
    (2, 1, 25, "retry", 1), (2, 1, 80, "retry", 1), (3, 9, 60_000, "ready", 1),
]
OUT = "book long, section long, ts long, action string, tries int"


def test_retries_of_a_batch(spark):
    batch = spark.createDataFrame([r for b in RESULTS for r in b], RESULT)
    assert sorted(map(tuple, T.retried(batch).collect())) == sorted([*RETRIED, (3, 9, 90_000, "ready", 1)])


def test_a_stopped_stream_goes_on_and_gives_each_row_once(spark, tmp_path):
    """The sink fails after it has written a batch; the query starts again from its checkpoint, and once more for later files."""
    folder, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    keep = S.write_once(sink)
    attempts = []

    def breaks_once(batch, number):
        keep(batch, number)
        attempts.append(number)
        if number == 2 and attempts.count(2) == 1:
            raise RuntimeError("the sink stops here")

    def start():
        stream = T.retried(S.read_events(spark, str(folder), RESULT, files=1))
        return stream.writeStream.foreachBatch(breaks_once).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()

    write(spark, folder, RESULT, map(later, RESULTS[:4]))
    with pytest.raises(Exception, match="the sink stops here"):
        start().awaitTermination(240)
    assert start().awaitTermination(240)
    assert attempts.count(2) == 2
    write(spark, folder, RESULT, map(later, RESULTS[4:]))
    assert start().awaitTermination(240)
    assert earlier((tuple(r)[:5] for r in S.read_once(spark, sink, OUT).collect()), 2) == RETRIED


def test_state_of_finished_sections_goes(spark, tmp_path):
    schema = "book long, section int, ts long, seq int, kind string, status string, chunk int"
    making = [[(b, s, 1_000 * b + s, 0, "chunk", None, c) for b in range(4) for s in range(5) for c in (1, 2, 1)]]
    ready = [[(b, s, 10_000 + s, 0, "status", "ready", None) for b in range(3) for s in range(5)]]
    got, query = run(spark, tmp_path, schema, making + ready, S.distinct_chunks)
    assert len(got) == 40
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) == 20 and rows[-1] == 5


def test_chunks_leave_the_state_with_the_watermark(spark, tmp_path):
    schema = "book long, section int, ts long, seq int, kind string, status string, chunk int"
    first = [(1, 0, 1_000 + c, 0, "chunk", None, c % 50) for c in range(100)]
    clock = [[(2, 0, ts, 0, "chunk", None, 1)] for ts in (50_000_000, 60_000_000)]
    again = [(1, 0, 100_000_000, 0, "chunk", None, 3)]
    got, query = run(spark, tmp_path, schema, [first, *clock, again], lambda s: S.chunks_within(s, "1 minute").select("chunk"))
    assert sorted(r.chunk for r in got) == sorted([*range(50), 1, 3])
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 50 and rows[-1] <= 2


CHOICE = "book long, ts long, seq int, mark long, lo long, hi long, color string"
CHOICES = [
    [(1, 1_000, 0, 1, 0, 9, "amber"), (1, 2_000, 0, 2, 10, 19, "sky")],
    [(1, 3_000, 0, 3, 5, 14, "rose"), (2, 3_000, 0, 9, 0, 4, "sky")],  # takes the place of both
    [(1, 4_000, 0, 4, 14, 20, "rose"), (1, 5_000, 0, 5, 14, 20, "rose"), (2, 5_000, 0, 10, 9, 3, "sky")],  # switches 3 off, and stands when chosen again
    [(3, 60_000, 0, 1, 0, 1, "sky")],
    [(3, 90_000, 0, 2, 4, 5, "sky")],
]
TOGGLED = [(1, 1, 1_000, "added"), (1, 1, 3_000, "removed"), (1, 2, 2_000, "added"), (1, 2, 3_000, "removed"), (1, 3, 3_000, "added"), (1, 3, 4_000, "removed"), (1, 5, 5_000, "added"), (2, 9, 3_000, "added"), (3, 1, 60_000, "added")]


def test_choices_are_folded_in_their_order(spark, tmp_path):
    got, _ = run(spark, tmp_path, CHOICE, CHOICES, T.toggled)
    assert earlier(got, 2) == TOGGLED
    batch = spark.createDataFrame([r for b in reversed(CHOICES) for r in b], CHOICE)
    assert sorted(map(tuple, T.toggled(batch).collect())) == sorted([*TOGGLED, (3, 2, 90_000, "added")])


@pytest.mark.parametrize("operator, schema", [(T.pause_cards, PLAY), (T.graced, MOVE), (T.retried, RESULT), (T.toggled, CHOICE)])
def test_no_events(spark, operator, schema):
    assert operator(spark.createDataFrame([], schema)).collect() == []


def test_a_model_isnt_asked_after_failures_in_a_row(spark, tmp_path):
    schema = "job long, ts long, seq int, section long, ok boolean"
    said = {1: [False, False, True, False, False, False, True, False], 2: [True, False], 3: [False] * 4}
    rows = [(j, 1_000 + i, 0, i, ok) for j, oks in said.items() for i, ok in enumerate(oks)]
    want = [(1, i, o) for i, o in enumerate(["failed", "failed", "model", "failed", "failed", "failed", "breaker", "breaker"])]
    want += [(2, 0, "model"), (2, 1, "failed")] + [(3, i, o) for i, o in enumerate(["failed"] * 3 + ["breaker"])]
    batch = spark.createDataFrame(rows, schema)
    assert sorted((r.job, r.section, r.outcome) for r in T.broken_off(batch).collect()) == sorted(want)
    clock = [[(9, 50_000, 0, 0, True)], [(9, 90_000, 0, 0, True)]]
    got, _ = run(spark, tmp_path, schema, [rows[::2], rows[1::2], *clock], T.broken_off)
    assert sorted((r.job, r.section, r.outcome) for r in got if r.job != 9) == sorted(want)


def test_a_client_gets_the_snapshot_before_what_comes(spark, tmp_path):
    snapshot = spark.createDataFrame([(1, "ready"), (2, "pending")], "section int, status string")
    sink = str(tmp_path / "out")
    write(spark, tmp_path / "in", "section int, status string", [[(1, "ready"), (2, "encoding")], [(2, "ready")], [(1, "ready")]])
    stream = S.read_events(spark, str(tmp_path / "in"), "section int, status string", files=1)
    query = stream.writeStream.foreachBatch(S.after_snapshot(snapshot, S.write_once(sink))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = sorted((r.batch, r.origin, r.section, r.status) for r in S.read_once(spark, sink, "section int, status string, origin int").collect())
    assert got == [(0, 0, 1, "ready"), (0, 0, 2, "pending"), (0, 1, 2, "encoding"), (1, 1, 2, "ready"), (2, 1, 1, "ready")]
