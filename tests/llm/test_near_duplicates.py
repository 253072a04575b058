import random

import numpy as np
from brute import classes_of

from lectern.llm import order_minhash as O
from lectern.llm.order_minhash import near_duplicates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_plain_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert O.aligned_length(a, b, 40) == lcs(a, b)


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.integers(0, 400, 300, dtype=np.uint64)
        b = a.copy()
        b[rng.integers(0, 300, 20)] = rng.integers(400, 800, 20, dtype=np.uint64)
        x, y = O.labelled(a), O.labelled(b)
        bits = int(np.bitwise_count(O.odd_sketch(a) ^ O.odd_sketch(b)).sum())
        assert bits <= len(np.setxor1d(x, y))


def corpus(seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for base in range(25):
        own = rng.choices(words, k=rng.randint(60, 200))
        texts[len(texts)] = " ".join(own)
        for _ in range(rng.randint(0, 6)):
            new = list(own)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(new))
                new[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            texts[len(texts)] = " ".join(new)
    # Texts that share half their words with many others, below the threshold.
    common = rng.choices(words, k=60)
    for _ in range(30):
        texts[len(texts)] = " ".join(common + rng.choices(words, k=60))
    return texts


def test_classes_match_brute_force(spark):
    texts = corpus()
    words = {k: t.split() for k, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and lcs(words[a], words[b]) >= O.SIMILAR * max(len(words[a]), len(words[b]))]
    want = classes_of(texts, links)
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_a_large_group_is_one_class(spark):
    rng = random.Random(1)
    base = [f"v{i}" for i in range(150)]
    texts = []
    for i in range(2500):
        new = list(base)
        for _ in range(2):
            new[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(new)))
    rows = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).select("class_id").distinct().collect()
    assert [r.class_id for r in rows] == [0]


def test_edge_cases(spark):
    long = " ".join(f"z{i}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, long + " end")]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, kept string, key int")
    got = sorted(((r.doc_id, r.class_id, r.kept, r.key) for r in near_duplicates(docs).collect()), key=str)
    want = [(1, 1, True, 1), (2, 1, False, 1), (3, 3, True, 1), (4, 4, True, 1), (5, 4, False, 1), (5, 4, False, 1), (None, 4, False, 1), (6, 6, True, 1), (7, 6, False, 1)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_recall_of_planted_near_copies(spark):
    """Pairs with a share of their words changed: edit similarity 0.97 to 0.8, the threshold."""
    rng = random.Random(15)
    words = [f"u{i}" for i in range(20_000)]
    for changed, least in ((0.03, 0.99), (0.07, 0.97), (0.1, 0.95), (0.13, 0.9), (0.16, 0.9), (0.19, 0.9)):
        texts = []
        for k in range(150):
            own = rng.choices(words, k=rng.randint(40, 300))
            copy = list(own)
            for at in rng.sample(range(len(own)), round(changed * len(own))):
                copy[at] = rng.choice(words)
            texts += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        caught = sum(got[2 * k + 1] == 2 * k for k in range(150))
        print("recall", changed, caught / 150)
        assert caught >= least * 150 and all(v // 2 == k // 2 for k, v in got.items())


def test_unlike_texts_of_one_list_are_aligned_without_a_row_for_each_pair(spark, monkeypatch):
    """The same sentences in other orders: shingles and words agree, alignments don't, so every pair must be looked at."""
    rng = random.Random(3)
    sentences = [" ".join(f"s{i}w{j}" for j in range(10)) for i in range(40)]
    texts = [(k, ". ".join(rng.sample(sentences, 40))) for k in range(400)]
    texts += [(1000 + k, f"{texts[k][1]} end") for k in range(0, 400, 40)]
    whole, seen = O._aligned_tiles, []

    def counted(tiles, *rest):
        seen.append((tiles.count(), sum(len(r.partners) for r in tiles.select("partners").collect())))
        return whole(tiles, *rest)

    monkeypatch.setattr(O, "_aligned_tiles", counted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {k: (k % 1000, int(k % 40 == 0)) for k, _ in texts}
    rows, pairs = seen[0]
    assert pairs > 60_000 and rows < pairs / 6


def test_tiles_hold_each_pair_once():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sizes = [1, 300, 2, 40]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n = int(starts[-1])
    table = pa.table({"list": np.repeat(np.arange(4), sizes), "bi": np.zeros(n, np.int32), "bj": np.zeros(n, np.int32), "key": [str(k).encode() for k in range(n)]})
    pairs = {(int(lo + i), int(lo + j)) for lo, size in zip(starts, sizes) for i, j in np.argwhere(np.triu(rng.random((size, size)) < 0.1, 1))}
    i, j = np.array(sorted(pairs, key=lambda p: rng.random())).T
    rows = [r for b in O._tiles(table, starts[:-1].tolist(), i, j) for r in b.to_pylist()]
    held = {(r["list"], r["ti"], r["tj"], r["nth"]): int(r["key"]) for r in rows}
    assert len(held) == len(rows)
    got = [(int(r["key"]), held[r["list"], r["ti"], r["tj"], p]) for r in rows for p in r["partners"]]
    assert len(got) == len(pairs) and set(got) == pairs
