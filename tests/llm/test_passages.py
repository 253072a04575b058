import random

import numpy as np
import pytest

from lectern.llm import passages as P


def test_chains_equal_a_plain_search():
    """The best chain's score, against all predecessors tried one by one."""

    def score_of(x, y):
        n, best = len(x), []
        for i in range(n):
            own = float(P.SEED)
            for j in range(i):
                dx, dy = x[i] - x[j], y[i] - y[j]
                if dy > 0 and 0 < dx <= P.MOST_GAP and dy <= P.MOST_GAP:
                    own = max(own, best[j] + min(P.SEED, dx, dy) - P.GAP_COST * (dx + dy))
            best.append(own)
        return max(best)

    x = np.arange(0, 90, 3)
    for shift in (0, 7, 40):
        found = P.chains(x, x + shift)
        assert found[0] == list(range(30))
        assert score_of(x.tolist(), (x + shift).tolist()) > P.SEED
    # Two diagonals far apart are two chains.
    y = np.concatenate((x[:15], x[15:] + 500))
    assert [len(c) for c in P.chains(x, y)] == [15, 15]


def planted(seed=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=70)
    texts = {i: rng.choices(words, k=rng.randint(0, 150)) for i in range(40)}
    spots = {}
    for i in (3, 11, 27):
        own = list(passage)
        if i == 27:  # a fuzzy copy: six words of 70 changed, one dropped
            for at in (8, 17, 29, 38, 50, 61):
                own[at] = "other"
            del own[33]
        at = rng.randint(0, len(texts[i]))
        texts[i][at:at] = own
        spots[i] = (at, at + len(own))
    return {i: " ".join(t) for i, t in texts.items()}, spots


def test_planted_passages_are_found_and_others_left_alone(spark):
    texts, spots = planted()
    rows = P.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    # Of three places one is the first; the other two repeat it.
    assert {r.doc_id for r in rows} | {r.match_doc_id for r in rows} == set(spots)
    assert len({r.doc_id for r in rows}) == 2
    for r in rows:
        lo, hi = spots[r.doc_id]
        assert abs(r.start_word - lo) <= 3 and abs(r.end_word - hi) <= 3


def test_cut_texts_have_no_passage_left(spark):
    texts, spots = planted(4)
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, lang string")
    cut = P.without_passages(docs)
    assert cut.columns == docs.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    assert len(left) == len(texts) and all(left[i] == t for i, t in texts.items() if i not in spots)
    # Of the two equal passages one goes. A fuzzy one is found if it shares a seed with an earlier place: 27 and 3 share none here.
    assert (left[3] != texts[3]) != (left[11] != texts[11])
    assert P.repeated_passages(cut).count() == 0


def test_edge_cases(spark):
    own = " ".join(f"x{i}" for i in range(60))
    long = " ".join(f"y{i}" for i in range(40_000))
    given = [(1, None), (2, ""), (3, "short text"), (4, own), (5, own), (5, own), (6, "start " + own + " " + own), (7, long), (None, "a b c")]
    docs = spark.createDataFrame([(*g, 1) for g in given], "doc_id long, text string, start_word int")
    got = P.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} in ({5, 6}, {4, 5, 6})
    assert P.repeated_passages(docs.limit(0)).count() == 0
    assert P.without_passages(docs).count() == len(given)


@pytest.mark.parametrize("spans, left", [([], "a  b\nc d"), ([(0, 1)], "b\nc d"), ([(1, 3)], "a  d"), ([(0, 4)], ""), ([(3, 4)], "a  b\nc ")])
def test_cut_words(spans, left):
    assert P.cut_words("a  b\nc d", spans) == left


def test_two_passages_with_unlike_words_between(spark):
    rng = random.Random(6)
    new = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    one, two = new(55), new(55)
    docs = spark.createDataFrame([(i, " ".join(new(20) + one + new(35) + two + new(20))) for i in range(2)], "doc_id long, text string")
    rows = P.repeated_passages(docs).collect()
    assert sorted((r.start_word, r.end_word) for r in rows) == [(20, 75), (110, 165)]


def brute(texts: dict[int, list[str]], least=P.LEAST_WORDS) -> dict[int, set[int]]:
    """For each text, the places whose ``least`` words another text holds too."""
    seen: dict[tuple, set[int]] = {}
    for i, t in texts.items():
        for at in range(len(t) - least + 1):
            seen.setdefault(tuple(t[at : at + least]), set()).add(i)
    return {i: {at for at in range(len(t) - least + 1) if len(seen[tuple(t[at : at + least])]) > 1} for i, t in texts.items()}


def left_over(spark, texts):
    """Runs of words that still stand in two texts after the cut."""
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    left = {r.doc_id: r.text.split() for r in P.without_passages(docs).collect()}
    return sum(map(len, brute(left).values())), left


def test_passages_of_frequent_lines_against_brute_force(spark):
    """Lines that stand in many texts, in pairs that only two texts share: no seed's first place tells of the pair."""
    rng = random.Random(12)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    lines = [new(30) for _ in range(12)]
    texts = {}
    for i in range(60):  # each line alone in 5 texts
        texts[i] = new(20) + lines[i % 12] + new(20)
    for k in range(6):
        for i in (100 + 2 * k, 101 + 2 * k):
            texts[i] = new(25) + lines[2 * k] + lines[2 * k + 1] + new(25)
    assert sum(map(len, brute(texts).values())) == 12 * 11
    over, left = left_over(spark, texts)
    assert over == 0
    assert all(left[i] == texts[i] for i in range(60))


def test_a_fuzzy_copy_is_cut_too(spark):
    texts, spots = planted(4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id: r.text for r in P.without_passages(docs).collect()}
    assert sum(left[i] != texts[i] for i in spots) == 2


@pytest.mark.parametrize("changed, least", [(0.1, 0.98), (0.15, 0.95), (0.2, 0.9)])
def test_recall_of_fuzzy_copies(spark, changed, least):
    """Copies of 60 words with a share of them changed, against what alignment word by word accepts."""
    rng = random.Random(31)
    new = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for k in range(150):
        own = new(60)
        copy = list(own)
        for at in rng.sample(range(2, 58), round(60 * changed)):
            copy[at] = new(1)[0]
        assert sum(x == y for x, y in zip(own, copy)) >= P.LIKE * 60
        texts[2 * k], texts[2 * k + 1] = new(30) + own + new(30), new(30) + copy + new(30)
    rows = P.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    found = {(r.doc_id // 2, r.match_doc_id // 2) for r in rows}
    assert all(a == b for a, b in found)
    print("recall", changed, len(found) / 150)
    assert len(found) >= least * 150


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    new = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    copied, shared, clean = new(60), new(60), new(80)
    text = " ".join
    given = [
        (1, text(copied)), (None, text(copied)), (None, text(copied)),  # copies without an id
        (2, text(new(10) + shared + new(10))), (7, text(new(5) + shared + new(5))), (7, text(clean)),  # two texts of one id
        (None, text(new(5) + shared)), (None, text(new(70))), (4, text(clean[::-1])), (4, text(clean[::-1])),
    ]
    docs = spark.createDataFrame([(*g, k) for k, g in enumerate(given)], "doc_id long, text string, k int")
    rows = P.repeated_passages(docs).collect()
    assert sorted((r.doc_id or 0) for r in rows if (r.start_word, r.end_word) in ((0, 60), (0, 80))) == [0, 0, 4]
    left = {r.k: (r.text or "").split() for r in P.without_passages(docs).collect()}
    assert len(left) == len(given)
    own = {k: len(t.split()) for k, (_, t) in enumerate(given)}
    assert len(left[0]) == 60 and not left[1] and not left[2]
    assert len(left[5]) == 80 and len(left[7]) == 70
    assert sorted((len(left[8]), len(left[9]))) == [0, 80]
    assert sorted(own[k] - len(left[k]) for k in (3, 4, 6)) == [0, 60, 60]


@pytest.mark.parametrize("changed, least", [(4, 0.99), (6, 0.98), (8, 0.95)])
def test_recall_of_families(spark, changed, least):
    """Ten unlike copies of a passage of 80 words: all but the first repeat an earlier one."""
    rng = random.Random(41)
    new = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for k in range(40):
        base = new(80)
        for i in range(10):
            own = list(base)
            for at in rng.sample(range(80), changed):
                own[at] = new(1)[0]
            texts[10 * k + i] = new(30) + own + new(30)
    rows = P.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert all(r.doc_id // 10 == r.match_doc_id // 10 for r in rows)
    found = len({r.doc_id for r in rows})
    print("recall", changed, found / 360)
    assert found >= least * 360


def test_ids_tell_texts_apart_that_share_bits(spark):
    """With 12 bits most of 600 texts share theirs with another one; ids are distinct all the same, and equal for equal texts."""
    texts = [f"text {i % 600}" for i in range(900)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = P.with_text_ids(docs, "id", digits=3).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.text or "", set()).add(r.id)
    assert all(len(v) == 1 for v in ids.values()) and len(set.union(*ids.values())) == 601
    assert any(r.id < 0 for r in rows)


def test_passages_whose_seeds_all_lead_elsewhere(spark):
    """Pairs of frequent lines with one word between them that differs: no long seed, and each line's first place and the one before are other texts."""
    rng = random.Random(17)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    lines = [new(26) for _ in range(12)]
    texts = {i: new(60) + lines[i % 12] + new(60) for i in range(12 * 80)}
    for k in range(6):
        for i in (1000 + 2 * k, 1001 + 2 * k):
            texts[i] = new(60) + lines[2 * k] + new(1) + lines[2 * k + 1] + new(60)
    rows = P.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert all(r.doc_id // 2 == r.match_doc_id // 2 and r.doc_id >= 1000 for r in rows)
    assert len(rows) == 6 and all(r.aligned_words == 52 for r in rows)


@pytest.mark.parametrize("vocabulary, shared", [(10**6, 30), (10**6, 12), (12, 0)])
def test_alike_misses_no_pair(vocabulary, shared):
    """Against all pairs: bags with a common line, with values that are said over and over, and of few values."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, vocabulary, shared)
    bags = [np.concatenate((rng.integers(0, vocabulary, 60), common)) for _ in range(90)]
    for k in range(0, 90, 9):
        bags[k] = np.concatenate((bags[k][:20], bags[k + 1][20:]))
    counted = [dict(zip(*np.unique(b, return_counts=True))) for b in bags]
    truth = {(i, j) for i in range(90) for j in range(i + 1, 90) if sum(min(n, counted[j].get(v, 0)) for v, n in counted[i].items()) >= P.SHARED}
    found = [(i, j) for a, b in P._alike(np.concatenate(bags).astype(np.uint32), np.array([len(b) for b in bags])) for i, j in zip(a.tolist(), b.tolist())]
    assert len(found) == len(set(found)) and truth and truth <= set(found)
    assert shared != 12 or set(found) == truth


def test_open_places_meet_all_others_once_and_others_are_not_copied(spark, monkeypatch):
    """Rows grow with places, and with open places by the blocks of their seed: one open place among many others doesn't make copies of those."""
    monkeypatch.setattr(P, "BLOCK", 50)
    given = [(1, i, 0, i < 3) for i in range(1003)] + [(2, i, 5, i < 300) for i in range(400)] + [(3, i, 1, False) for i in range(200)]
    rows = P._in_blocks(spark.createDataFrame(given, "seed long, id long, place int, open boolean")).collect()
    assert sum(r.seed == 1 for r in rows) == 1000 + 3 * 21 and not any(r.seed == 3 for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault((r.seed, r.bi, r.bj), []).append(r)
    met = [(a.seed, *sorted((a.id, b.id))) for (_, bi, bj), g in groups.items() for a in g for b in g if a.id != b.id and a.open and (a.id < b.id or not b.open) and (bi == bj or a.side != b.side)]
    wanted = {(s, *sorted((a, b))) for s, a, _, o in given if o for t, b, _, _ in given if s == t and a != b}
    assert len(met) == len(set(met)) and set(met) == wanted


def _meetings(rows):
    """(rows that are dealt, pairs of ids whose later one is open and that meet)."""
    groups = {}
    for r in rows:
        groups.setdefault((r.seed, r.bi, r.bj), []).append(r)
    return [(a.seed, a.id, b.id) for (_, bi, bj), g in groups.items() if any(r.asks for r in g) for a in g for b in g if a.id > b.id and a.open and (a.asks or b.asks) and (bi == bj or a.side != b.side)]


def test_seeds_of_one_frequent_line_are_compared_in_full_once(spark, monkeypatch):
    """Three seeds of a line that is open in 400 texts, the line altered before its second seed in five of them: pairs that the first seed's list has don't make copies at the others. A list that fits a block isn't parted."""
    monkeypatch.setattr(P, "BLOCK", 50)
    altered = {7, 70, 171, 272, 399}
    given = [(4, i, 10, i % 10 > 0) for i in range(400) if i not in altered] + [(8, i, 11, i % 10 > 0) for i in range(400)] + [(12, i, 15, i % 10 > 0) for i in range(400)]
    given += [(16, i, 30, i < 20) for i in range(40)]
    rows = P._in_blocks(spark.createDataFrame(given, "seed long, id long, place int, open boolean")).collect()
    assert sum(r.seed == 16 for r in rows) == 40
    assert sum(r.seed == 8 for r in rows) <= 395 + 5 * 9 and sum(r.seed == 12 for r in rows) == 400
    met = _meetings(rows)
    assert len(met) == len(set(met))
    opened = {(s, i) for s, i, _, o in given if o}
    wanted = {(4, a, b) for a in range(400) for b in range(a) if not {a, b} & altered and (4, a) in opened}
    wanted |= {(8, a, b) for a in range(400) for b in range(a) if {a, b} & altered and (8, a) in opened} | {(16, a, b) for a in range(20) for b in range(a)}
    assert wanted <= set(met) and {m for m in set(met) - wanted if m[0] != 8} == set()


def test_bounds_of_aligned_words_miss_nothing():
    """Against the longest common subsequence, word by word; windows that a text's end cuts hold zeros."""
    rng = np.random.default_rng(3)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y and x else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    a, b = rng.integers(1, 9, (20, 50)).astype(np.uint32), rng.integers(1, 9, (20, 50)).astype(np.uint32)
    a[:5, 30:], b[3:9, 20:] = 0, 0
    found = P._in_order(a, b)
    assert all(found[i, k] == longest(a[i, :k], b[i]) for i in range(20) for k in range(0, 51, 10))
    one = rng.integers(1, 2**32, (4, 104), dtype=np.uint64).astype(np.uint32)
    other = rng.integers(1, 2**32, (4, 104), dtype=np.uint64).astype(np.uint32)
    other[0, 40:90] = one[0, 40:90]
    other[0, [41, 45, 60, 63, 66, 70, 75, 80, 85, 89]] = 1  # 40 of 50 words left
    other[1, 40:90] = one[1, 40:90]
    other[1, [41, 45, 48, 60, 63, 66, 70, 75, 80, 85, 89]] = 1  # 39
    other[2, 20:70] = one[2, 23:73]  # 47 words, three places apart, but for those before the seed
    other[3, :54] = one[3, :54]
    other[3, 54:] = one[3, 54:] = 0  # cut behind the seed: 54 words
    assert P._may_hold(one, other, 50, 40).tolist()[:2] == [True, False] and P._may_hold(one, other, 50, 40)[3]
