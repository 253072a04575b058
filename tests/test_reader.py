"""Positions, queues, search and shelves on small pinned cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import reader as R, timeline as T


@pytest.fixture(scope="module")
def book(spark):
    """Three sections: ready for 20 s, pending for 30 s, ready for 40 s; two chunks of words in the first."""
    axis = T.timeline(spark.createDataFrame([(1, 0, "ready", 20_000, 0), (1, 1, "pending", 30_000, 0), (1, 2, "ready", 40_000, 0)], "book int, section int, status string, duration_ms long, partial_ms long"))
    words = spark.createDataFrame([(1, 0, 0, 0, 100, 900), (1, 0, 0, 1, 1_000, 1_900), (1, 0, 1, 0, 5_000, 5_400), (1, 2, 0, 0, 50, 90)], "book int, section int, chunk int, w int, s long, e long")
    chunks = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 5_000), (1, 1, 0, 0), (1, 2, 0, 0)], "book int, section int, chunk int, start_in_section long")
    return axis, words, chunks


def at(spark, *times):
    return spark.createDataFrame([(1, t) for t in times], "book int, t long")


def test_words_at_times(spark, book):
    axis, words, _ = book
    got = {r.t: (r.section, r.chunk, r.w) for r in R.words_at(at(spark, -5, 0, 950, 1_000, 4_999, 5_000, 19_999, 20_000, 50_000, 999_999), axis, words).collect()}
    assert got == {-5: (0, 0, 0), 0: (0, 0, 0), 950: (0, 0, 0), 1_000: (0, 0, 1), 4_999: (0, 0, 1), 5_000: (0, 1, 0), 19_999: (0, 1, 0), 20_000: (1, None, None), 50_000: (2, 0, 0), 999_999: (2, 0, 0)}


def test_snapshots(spark, book):
    axis, words, chunks = book
    got = {r.t: (r.section, r.offset, r.word_idx, round(r.percent, 3), r.section_start_ms) for r in R.snapshots(at(spark, 1_200, 5_100, 25_000, 90_000), axis, chunks, words).collect()}
    assert got == {1_200: (0, 1_200, 1, 1.333, 0), 5_100: (0, 5_100, 0, 5.667, 0), 25_000: (1, 5_000, 0, 27.778, 20_000), 90_000: (2, 40_000, 0, 100.0, 50_000)}


def test_ready_axis(spark, book):
    got = {r.t: r.ready_ms for r in R.to_ready(at(spark, -1, 5_000, 20_000, 35_000, 50_000, 70_000, 10**9), book[0]).collect()}
    assert got == {-1: 0, 5_000: 5_000, 20_000: 20_000, 35_000: 20_000, 50_000: 20_000, 70_000: 40_000, 10**9: 60_000}


def test_tokens_without_words_have_no_time(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "p int, ti int, token string")
    words = spark.createDataFrame([(1, 1, 0, 30), (1, 0, 0, 10), (1, 0, 1, 20)], "p int, chunk int, w int, s int")
    assert [(r.token, r.s) for r in R.timed_tokens(tokens, words, ["p"]).orderBy("ti").collect()] == [("a", 10), ("b", 20), ("c", 30), ("d", None)]


def test_clamped_words(spark):
    rows = [(1, 0, "one", -20, 300), (1, 1, "", 0, 0), (1, 2, "two", 500, 200), (1, 3, "three", 400, 2_000), (1, 4, "four", 900, 950), (1, 5, "five", 0, 0)]
    df = spark.createDataFrame([(*r, 4, 1_000) for r in rows], "k int, at int, word string, s long, e long, n_words int, duration_ms long")
    assert [(r.w, r.s, r.e) for r in R.aligned_words(df, ["k"]).orderBy("w").collect()] == [(0, 0, 300), (1, 500, 500), (2, 500, 1_000), (3, 900, 1_000)]


def test_search(spark):
    rows = [("b", 0, 0, 0, "The Pond", "A pond lies here."), ("b", 0, 0, 1, "The Pond", "No water."), ("b", 1, 2, 0, "Else", "Ponds, PONDS and a pond.")] + [("c", 0, 0, i, "", f"pond {i}") for i in range(40)]
    items = spark.createDataFrame(rows, "book string, sec int, para int, sent int, title string, text string")
    got = [tuple(r)[1:] for r in R.search(items, " POND ").where("book = 'b'").orderBy("rank").collect()]
    assert got == [(0, 0, -1, 4, 1), (0, 0, 0, 2, 2), (1, 2, 0, 0, 3)]
    assert R.search(items, "pond").where("book = 'c'").count() == 30 and R.search(items, "p ").count() == 0
    chunks = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 0, 1, 1, 4), (1, 2, 0, 1, 2)], "sec int, para int, n int, s0 int, s1 int")
    hits = R.search(items, "pond").where("book = 'b'")
    assert [(r.sec, r.sent, r.n) for r in R.spoken_at(hits, chunks).orderBy("rank").collect()] == [(0, -1, None), (0, 0, 0), (1, 0, None)]


def test_lanes_and_tiers(spark):
    sections = spark.createDataFrame([(1, i, s, 2) for i, s in enumerate(["pending"] * 4 + ["failed", "pending", "ready", "pending"])], "book int, section int, status string, n_chunks int")
    boost = lambda *s: spark.createDataFrame([(1, x) for x in s], "book int, section int")
    lanes = lambda b, n: {(r.section, r.lane) for r in R.targets(sections, b, n).collect()}
    assert lanes(boost(1), 3) == {(1, 1), (2, 1), (3, 2), (5, 2)}
    assert lanes(boost(4), 1) == {(4, 1), (5, 1), (7, 2)} and lanes(boost(3), 1) == {(3, 1), (5, 2)}
    assert lanes(boost(), 5) == {(0, 2), (1, 2), (2, 2)}
    queue = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1), (1, 3, 0), (1, 5, 2)], "book int, section int, pri int")
    live = spark.createDataFrame([(1, 0)], "book int, section int")
    got = {r.section: r.tier for r in R.demoted(queue, R.targets(sections, boost(1), 1), live).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 5: 2}


def test_needs_and_overlay(spark):
    rows = [(1, i, s, f) for i, (s, f) in enumerate([("failed", True), ("failed", False), ("ready", True), ("encoding", False), ("aligning", False), (None, False), ("pending", False)])]
    sections = spark.createDataFrame(rows, "book int, section int, status string, forced boolean")
    live = spark.createDataFrame([(1, 3), (1, 6)], "book int, section int")
    assert {r.section: r.needs for r in R.needed(sections, live).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True, 6: True}
    assert {r.section: r.shown for r in R.overlaid(sections, live).where("section > 4").collect()} == {5: None, 6: "synthesizing"}


def test_boost(spark):
    rows = [(1, 0, "pending", 900), (1, 1, "pending", 20), (1, 2, "pending", 10), (2, 0, "ready", 1), (2, 1, "pending", 1), (3, 0, "pending", 400), (3, 1, "pending", 1), (4, 0, "failed", 1)]
    sections = spark.createDataFrame(rows, "book int, section int, status string, n_chunks int")
    current = spark.createDataFrame([(b, 0) for b in (1, 2, 3, 4)], "book int, section int")
    assert {tuple(r) for r in R.boost(sections, current).collect()} == {(1, 2), (3, 0)}


def test_spines_never_repeat_their_neighbours(spark):
    titles = [f"Title {i % 7}" for i in range(60)]
    books = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(titles)], "shelf string, at int, id int, title string")
    got = sorted(R.spines(books).collect(), key=lambda r: r.id)
    for a, b in zip(got, got[1:]):
        assert a.cloth != b.cloth and a.width != b.width and a.tilt != b.tilt
    assert all(a.cloth != b.cloth for a, b in zip(got, got[2:]))
    first = spark.createDataFrame([(titles[0],)], "t string").select((X.fnv32(F.col("t")) % 10).alias("h")).first().h
    assert got[0].cloth == first


def test_small_rules(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    ms = lambda v: F.lit(v)
    assert [one(R.duration_text(ms(v))) for v in (0, 29_999, 30_000, 3_600_000, 7_500_000)] == ["0m", "0m", "1m", "1h 00m", "2h 05m"]
    assert [one(R.clock(ms(v))) for v in (-10, 499, 500, 61_000, 600_000)] == ["0:00", "0:00", "0:01", "1:01", "10:00"]
    assert [tuple(round(one(c), 4) for c in R.hsl(*map(F.lit, rgb))) for rgb in ((255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (255, 0, 128))] == [(0.0, 1.0, 0.5), (120.0, 1.0, 0.5), (240.0, 1.0, 0.5), (0.0, 0.0, 0.502), (329.8824, 1.0, 0.5)]
    assert [one(R.page_at(F.lit(x), F.lit(s))) for x, s in ((0, 100), (49, 100), (50, 100), (-80, 100), (500, 0))] == [0, 0, 1, 0, 0]
    assert [one(R.page_count(F.lit(x), F.lit(s))) for x, s in ((0, 100), (1, 100), (100, 100), (101, 100), (5, -1))] == [1, 1, 1, 2, 1]
    assert [one(R.alignment_mode(F.lit(v), a)) for v, a in ((None, True), ("AUTO", False), ("Interp", True), ("whisperx", False), ("", True))] == ["whisperx", "interp", "interp", "interp", "whisperx"]
    assert [one(R.time_left(F.lit(e), F.lit(0), F.lit(r))) for e, r in ((900, 2.0), (900, 0.1), (-5, 1.0))] == [450.0, 1800.0, 0.0]
    assert [one(R.is_audio_name(F.lit(v))) for v in ("section-001.mp3", "partial-2.mp3", "cover.mp3", "section-1.wav", "x/section-1.mp3")] == [True, True, False, False, False]
    assert one(R.audio_ms(F.lit(24_012), F.lit(24_000))) == 1_000


def test_migrations_can_run_again(spark):
    df = spark.createDataFrame([(1, 7)], "a int, b int")
    twice = R.with_missing(R.with_missing(df, {"b": F.lit(0), "c": F.lit("x")}), {"b": F.lit(1), "c": F.lit("y")})
    assert [tuple(r) for r in twice.collect()] == [(1, 7, "x")]


def test_only_paragraphs_of_hits_are_cut_into_chunks(spark, monkeypatch):
    from lectern.plans import reader_plans as plans

    d, seen, whole = "/root/testdata/sf0.001", [], plans.P.chunks
    monkeypatch.setattr(plans.P, "chunks", lambda paras: seen.append(paras.count()) or whole(paras))
    rows = plans.hit_chunks(spark, d).collect()
    assert rows and seen[0] <= len({(r.sec, r.para) for r in rows})


def test_tokens_are_timed_within_their_row(spark):
    from lectern.plans import reader_plans as plans

    rows = spark.createDataFrame([(["a", "b", "c"], [("a", 0), ("x", 350)]), ([], [("a", 0)])], "t array<string>, w array<struct<word:string,s:long>>")
    got = [[tuple(x) for x in r.z] for r in rows.select(R.timed_in_place(F.col("t"), F.col("w")).alias("z")).collect()]
    assert got == [[("a", "a", 0), ("b", "x", 350), ("c", None, None)], []]
    plan = plans.token_times(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
