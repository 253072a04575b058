"""Orders, positions and looks of keys that are far larger than a task's share."""

import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import fnv32
from lectern.operators import intervals, ordered, reader as R, timeline as T


def test_one_book_of_a_million_probes_is_dealt_to_many_tasks(spark):
    # All probes of book 1, a third of them at one time; 500 sections.
    probes = spark.range(1_000_000).select(F.lit(1).alias("book"), F.when(F.col("id") % 3 == 0, 7_777).otherwise(F.col("id") * 37 % 500_003).alias("t"), "id")
    starts = spark.range(500).select(F.lit(1).alias("book"), (F.col("id") * 1_000).alias("start"), F.col("id").alias("section"))
    found = intervals.as_of(probes, starts, ["book"], "t", "start", ["section"], "section", pieces=16)
    wrong = found.where(F.col("section") != F.least(F.lit(499), F.floor(F.col("t") / 1_000)))
    assert found.count() == 1_000_000 and wrong.isEmpty()
    cut = ordered.in_pieces(probes.withColumn("order", F.xxhash64("id")), ["book"], ["t", "order"], 16)
    sizes = [r["count"] for r in cut.groupBy("piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 150_000


@pytest.mark.parametrize("or_first", [False, True])
def test_as_of_matches_a_search(spark, or_first):
    rng = random.Random(7)
    right = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(100), i) for i in range(60)] + [(5, 10, 99)]
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(-5, 110), i) for i in range(400)] + [(1, 50, 1000)] * 3
    found = intervals.as_of(
        spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, s int, n int"), ["k"], "t", "s", ["n", "s"], "n", or_first, pieces=9
    ).collect()

    def plain(k, t):
        own = sorted((s, n) for key, s, n in right if key == k)
        at = bisect_right(own, (t, 10**9)) - 1
        if at >= 0:
            return own[at][::-1]
        return own[0][::-1] if own and or_first else (None, None)

    assert sorted(map(str, map(tuple, found))) == sorted(str((k, t, i, *plain(k, t))) for k, t, i in left)
    assert intervals.as_of(spark.createDataFrame([], "k int, t int"), spark.createDataFrame([], "k int, s int, n int"), ["k"], "t", "s", ["n"], "n").count() == 0


def test_sums_of_a_hot_key_go_over_borders(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, 1, 2, 50])) for i in range(3_000)]
    made = ordered.running_sums(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], ["at"], {"total": F.col("v"), "rows": F.lit(1)}, pieces=13).collect()
    sums = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        t, n = sums.get(k, (0, 0))
        sums[k] = (t + (v or 0), n + 1)
        sums[k, at] = sums[k]
    assert len(made) == 3_000 and all((r["total"], r["rows"]) == sums[r.k, r["at"]] for r in made)


def test_one_long_book_on_its_axis(spark):
    sections = spark.range(200_000).select(F.lit(1).alias("book"), F.col("id").cast("int").alias("section"), F.when(F.col("id") % 2 == 0, "ready").otherwise("pending").alias("status"), F.lit(10).alias("duration_ms"), F.lit(0).alias("partial_ms"))
    line = T.timeline(sections)
    assert line.where("start_ms <> section * 10 OR end_ms <> section * 10 + 10 OR ready_start <> ceil(section / 2) * 10").isEmpty() and line.count() == 200_000


def test_overlaps_of_short_and_long_intervals(spark):
    rng = random.Random(6)

    def some(n):
        out = []
        for i in range(n):
            lo = rng.randrange(-1_000_000, 1_000_000)
            out.append((rng.choice([1, 2]), i, lo, lo + rng.choice([-3, 0, 1, 15, 16, 17, 300, 5_000, 1_000_000])))
        return out

    a, b = some(150), some(150)
    left = spark.createDataFrame(a, "k int, i int, lo long, hi long")
    right = spark.createDataFrame(b, "k int, j int, other_lo long, other_hi long")
    pairs = sorted((r.i, r.j) for r in intervals.overlapping(left, right, ["k"], 16).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert pairs == want and len(want) > 500
    assert intervals.overlapping(left, right.limit(0), ["k"], 16).isEmpty()


def test_long_intervals_are_dealt_to_few_cells(spark):
    long_ = spark.range(50).select(F.lit(1).alias("k"), (F.col("id") * 2_000_000).alias("lo"), (F.col("id") * 2_000_000 + 1_000_000).alias("hi"))
    other = long_.select("k", F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
    found = intervals.overlapping(long_, other, ["k"], 16)
    assert found.count() == 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 4
    sides = [n for n in (1, 8, 64, 512, 4_096, 32_768, 262_144) if 16 * n < 1_000_001]
    assert len(sides) <= 7  # levels below a million; two cells each at most


def plain_shelf(books):
    """Looks one after another; books: (at, id, hashes)."""
    out, one, two = {}, None, None
    for *_, i, h in sorted(books, key=lambda b: (b[0], b[1])):
        def first(base, n, seed, bad):
            return base if not bad(base) else next(x for x in ((base + (seed + k) % (n - 1) + 1) % n for k in range(n - 1)) if not bad(x))

        cloth = first(h[0], R.CLOTHS, h[1], lambda x: x in [s[0] for s in (one, two) if s])
        width = first(h[2], len(R.WIDTHS), h[3], lambda x: bool(one) and R.WIDTHS[x] == R.WIDTHS[one[1]])
        tilt = first(h[4], R.TILTS, h[5], lambda x: bool(one) and x == one[2])
        one, two = (cloth, width, tilt), one
        out[i] = (cloth, R.WIDTHS[width], tilt + 82)
    return out


def test_a_shelf_in_many_pieces_looks_like_one_fold(spark):
    books = spark.range(1_200).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 1_100, "b").otherwise(None).alias("shelf"), (F.col("id") % 700).alias("at"), "id", F.concat(F.lit("t"), (F.col("id") % 13).cast("string")).alias("title"))
    got = {r.id: (r.cloth, r.width, r.tilt) for r in R.spines(books, pieces=11).collect()}
    h = lambda mark, n: (fnv32(F.concat(F.lit(mark), F.col("title"))) % n).cast("int")
    hashed = books.select("shelf", "at", "id", F.array(h("", R.CLOTHS), h("#", R.CLOTHS - 1), h("|", len(R.WIDTHS)), h("w#", len(R.WIDTHS) - 1), h("=", R.TILTS), h("t#", R.TILTS - 1)).alias("h")).collect()
    want = {}
    for shelf in ("hot", "b", None):
        want |= plain_shelf([(r["at"], r.id, r.h) for r in hashed if r.shelf == shelf])
    assert got == want
    assert R.spines(books.limit(0)).count() == 0


def test_titles_are_hashed_as_the_column_rule_does_and_runs_are_composed_at_once(spark):
    from pyspark.sql import functions as F

    from lectern.functions import text as X

    titles = ["", "a", "Café", "\U0001f600 x", "n" * 70, "Customer#000000001/BUILDING"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    want = rows.select("i", *(X.fnv32(F.concat(F.lit(m), "t")).alias(f"h{k}") for k, m in enumerate(R.MARKS))).orderBy("i").collect()
    assert X.fnv32_marked(titles, R.MARKS).T.tolist() == [list(r)[1:] for r in want]
    assert X.fnv32_marked([], R.MARKS).shape == (len(R.MARKS), 0)
    maps = np.random.default_rng(1).integers(0, 9, (23, 9))
    for n in (1, 2, 7, 23):
        now = np.arange(9)
        for m in maps[:n]:
            now = m[now]
        assert R._composed(maps[:n]).tolist() == now.tolist()
