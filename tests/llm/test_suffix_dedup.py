import random

import numpy as np
from brute import suffix_dedup as plain

from lectern.llm import suffix_dedup


def test_two_stage_sorts_all_suffixes():
    rng = random.Random(3)
    for _ in range(300):
        x = np.array([rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 60))], np.uint8)
        assert suffix_dedup.two_stage(x, 70).tolist() == sorted(range(len(x)), key=lambda i: bytes(x[i:]))


def check(spark, texts, **options):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(rows, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = plain(texts, options.get("window", 400))
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(texts)


def test_random_passages_match_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    passage = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    texts = {}
    for i in range(60):
        parts = [rng.choice(passage) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 8))]
        texts[i] = " ".join(parts)
        if rng.random() < 0.3 and texts[i]:
            at = rng.randrange(len(texts[i]))
            texts[i + 100] = texts[i][:at] + "#" + texts[i][at:]
    check(spark, texts, window=48, gram=16, ranges=4)


def test_edge_cases(spark):
    check(spark, {1: None, 2: "", 3: "short", 4: "a" * 3000, 5: "a" * 400, 6: "ab" * 500, 7: "xy" + "ab" * 200, 8: "é" * 700, 9: "z" * 401, 10: "q" * 400})
    check(spark, {1: "one line of text " * 40, 2: "one line of text " * 40})
    empty = spark.createDataFrame([], "doc_id long, text string, kept string, spans int")
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_cores_with_many_margins_match_brute_force(spark):
    """With ``most`` small the strings of every core meet under longer cores."""
    rng = random.Random(8)
    core = "".join(rng.choices("abcdefgh", k=60))
    texts = {i: "".join(rng.choices("xyz", k=rng.randint(0, 30))) + core + "".join(rng.choices("xyz", k=rng.randint(0, 30))) for i in range(60)}
    for most in (1, 3, 8_000):
        check(spark, texts, window=48, gram=16, ranges=4, most=most)


def test_frequent_cores_of_the_given_size(spark):
    """Margins of 92 bytes, halved down to none, with ties among what is left of them."""
    rng = random.Random(9)
    core = "".join(rng.choices("abcdefgh", k=330))
    ends = ["".join(rng.choices("xyz", k=50)) for _ in range(4)]
    texts = {i: "".join(rng.choices("xyz", k=rng.randint(0, 60))) + rng.choice(ends) + core + rng.choice(ends) + "".join(rng.choices("xyz", k=rng.randint(0, 60))) for i in range(50)}
    for most in (1, 5):
        check(spark, texts, most=most)


def test_null_and_shared_ids(spark):
    rng = random.Random(10)
    own = ["".join(rng.choices("abcdef", k=500)) for _ in range(3)]
    texts = [own[0], own[0], own[1], own[1] + own[2], own[2]]
    rows = spark.createDataFrame(list(zip([None, None, 5, 5, 5], texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(rows, most=1).select("doc_id", "n_bytes", "n_removed").collect()
    want = plain(dict(enumerate(texts)), 400)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == sorted((d or 0, *want[i][:2]) for i, d in enumerate([None, None, 5, 5, 5]))


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    rng = random.Random(11)
    data = np.array([rng.choice([1, 2]) for _ in range(300)], np.uint8)
    sure = {w: [i for i in range(293) if bytes(data[i : i + 8]) == w] for w in {bytes(data[i : i + 8]) for i in range(293)}}
    for blur in (False, True):
        if blur:
            hashes = suffix_dedup.window_hashes
            monkeypatch.setattr(suffix_dedup, "window_hashes", lambda d, w: hashes(d, w) % np.uint64(5))
        order, same = suffix_dedup.equal_windows(data, 8)
        groups = np.split(order, np.flatnonzero(~same)[1:])
        assert sorted(g.tolist() for g in groups) == sorted(sure.values())


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, {r.doc_id: r.text for r in docs})
