"""Streams from files, cut into several micro-batches, against plain folds over the same events."""

import random

import pytest

from lectern.streaming import events as S

SECTION = "book long, section int, ts long, seq int, kind string, status string, chunk int"


def streamed(spark, tmp_path, schema, rows, operator, batches=3):
    """Rows of the operator over a stream of files, in ``batches`` micro-batches."""
    folder, name = tmp_path / "in", f"t{random.randrange(10**9)}"
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(str(folder), mode="append")
    stream = operator(S.read_events(spark, str(folder), schema, files=1))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return [tuple(r) for r in spark.table(name).collect()]


def narration(seed=3):
    rng, rows = random.Random(seed), []
    for ts in range(400):
        book, section = rng.randrange(2), rng.randrange(2)
        if rng.random() < 0.05:
            rows.append((book, section, ts, 0, "status", rng.choice(["synthesizing", "encoding", "ready", "failed"]), None))
        else:
            rows.append((book, section, ts, 0, "chunk", None, rng.randrange(40)))
    return rows


def test_section_progress(spark, tmp_path):
    rows, want, state = narration(), [], {}
    for book, section, ts, _, kind, status, chunk in rows:
        s = state.setdefault((book, section), {"status": "pending", "done": [], "marked": 0})
        if kind == "chunk":
            if chunk in s["done"]:
                continue
            s["done"].append(chunk)
            if len(s["done"]) % 10:
                continue
            s["marked"] = len(s["done"])
        else:
            s["status"] = status
            if status in ("ready", "failed"):
                s["done"], s["marked"] = [], 0
        want.append((book, section, ts, s["status"], len(s["done"]), s["marked"]))
    assert len(want) > 20
    assert sorted(streamed(spark, tmp_path, SECTION, rows, S.section_progress)) == sorted(want)


def test_latest_status_and_distinct_chunks(spark, tmp_path):
    rows = narration(5)
    last = {}
    for r in rows:
        if r[4] == "status":
            last[r[:2]] = (*r[:2], r[5], r[2])
    batch = spark.createDataFrame(rows, SECTION).where("kind = 'status'")
    assert sorted(map(tuple, S.latest_status(batch).collect())) == sorted(last.values())
    want, known = [], {}
    for book, section, ts, _, kind, status, chunk in rows:
        done = known.setdefault((book, section), set())
        if kind == "status":
            done.clear() if status == "ready" else None
        elif chunk not in done:
            done.add(chunk)
            want.append((book, section, chunk, ts))
    assert sorted(streamed(spark, tmp_path / "b", SECTION, rows, S.distinct_chunks)) == sorted(want)


def test_sittings(spark, tmp_path):
    rows = [
        (1, 7, 0, 0, "open"), (1, 7, 1_000, 0, "play"), (1, 7, 5_000, 0, "pause"), (1, 7, 9_000, 0, "play"),
        (1, 8, 12_000, 0, "open"),  # playback runs on into book 8
        (1, 8, 14_000, 0, "pause"), (1, 8, 15_000, 0, "close"), (1, 9, 16_000, 0, "open"), (1, 9, 17_000, 0, "close"),
        (2, 7, 3_000, 0, "open"), (2, 7, 3_100, 0, "play"), (2, 7, 3_200, 0, "close"),
    ]
    got = streamed(spark, tmp_path, "user long, book long, ts long, seq int, kind string", rows, S.sittings, batches=4)
    assert sorted(got) == [(1, 7, 0, 12_000, 7_000), (1, 8, 12_000, 15_000, 2_000)]


def test_resumptions(spark, tmp_path):
    rows = [
        (1, 0, 0, 0, "partial", 2_000), (1, 0, 1, 0, "park", None), (1, 0, 2, 0, "partial", 3_000), (1, 0, 3, 0, "partial", 3_600),
        (1, 0, 4, 0, "park", None), (1, 0, 5, 0, "ready", 9_000), (1, 0, 6, 0, "ready", 9_000), (2, 0, 1, 0, "park", None), (2, 0, 2, 0, "partial", 1_499),
    ]
    got = streamed(spark, tmp_path, "book long, section int, ts long, seq int, kind string, partial_ms long", rows, S.resumptions)
    assert sorted(got) == [(1, 0, 3, 3_600), (1, 0, 5, 9_000)]


def test_changed(spark, tmp_path):
    rows = [(1, t, 0, r) for t, r in enumerate((0, 0, 1, 1, 3, 3, 2))] + [(2, 0, 0, 5)]
    got = streamed(spark, tmp_path, "book long, ts long, seq int, ready int", rows, S.changed)
    assert sorted(got) == [(1, 0, 0), (1, 2, 1), (1, 4, 3), (1, 6, 2), (2, 0, 5)]


def test_celebrations_snapshots_and_finished_books(spark):
    ended = spark.createDataFrame([(1, 0, 90_000), (1, 100_000, 59_000), (2, 0, 60_000)], "user long, started long, active_ms long")
    opened = spark.createDataFrame([(1, 390_000), (2, 400_000)], "user long, ts long")
    assert [tuple(r) for r in S.celebrated(ended, opened).collect()] == [(1, 390_000, 0, 90_000)]
    snapshot = spark.createDataFrame([(1, "ready"), (2, "pending")], "section int, status string")
    live = spark.createDataFrame([(1, "ready"), (2, "ready")], "section int, status string")
    assert sorted(map(tuple, S.with_snapshot(live, snapshot).collect())) == [(1, "ready", 0), (2, "pending", 0), (2, "ready", 1)]
    sections = spark.createDataFrame([(1, "ready"), (1, "failed"), (2, "ready"), (2, "encoding")], "book int, status string")
    assert [r.book for r in S.finished_books(sections).collect()] == [1]


def test_sections_as_a_start_finds_them(spark):
    states = ["pending", "synthesizing", "aligning", "encoding", "ready", "failed", None]
    rows = spark.createDataFrame(list(enumerate(states)), "section int, status string")
    got = {r.section: (r.status, r.reset) for r in S.recovered(rows).collect()}
    assert got == {0: ("pending", False), 1: ("pending", True), 2: ("pending", True), 3: ("pending", True), 4: ("ready", False), 5: ("pending", True), 6: (None, False)}
    books = [(1, "ready"), (1, "failed"), *((2 + i, s) for i, s in enumerate(states[:4])), (9, "ready"), (9, "encoding")]
    assert [r.book for r in S.finished_books(spark.createDataFrame(books, "book int, status string")).collect()] == [1]


@pytest.mark.parametrize("operator", [S.section_progress, S.distinct_chunks])
def test_no_events(spark, tmp_path, operator):
    assert streamed(spark, tmp_path, SECTION, [], operator, batches=1) == []
