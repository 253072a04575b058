"""Language identification and the quality model: held-out accuracy and edge cases."""

import numpy as np

from lectern.llm import language_id, quality_gam
from lectern.llm.common import crc32_mod4

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = language_id.learn(docs.where(crc32_mod4("doc_id") != 2))
    rows = language_id.identify(docs.where(crc32_mod4("doc_id") == 2), filters).where("lang IS NOT NULL").collect()
    right = np.mean([r.lang == r.lang_pred for r in rows if r.lang_pred != "und"])
    assert len(rows) > 150 and right > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    learned = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "more of the words", None)], "doc_id long, text string, lang string")
    filters = language_id.learn(learned)
    given = [(1, None), (2, ""), (3, "123 !?"), (4, "the the the"), (4, "the the the"), (5, "und die " * 100_000), (6, "漢字")]
    docs = spark.createDataFrame([(*g, "x") for g in given], "doc_id long, text string, score string")
    rows = language_id.identify(docs, filters).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "de", filters.langs[filters.usual]]
    assert language_id.identify(docs.limit(0), filters).count() == 0
    none = language_id.learn(learned.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_bloom_filters_hold_all_their_ngrams():
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(3)]
    filters = language_id.Filters.of(["a", "b", "c"], own)
    for i, g in enumerate(own):
        assert (filters.masks(g) >> np.uint64(i) & np.uint64(1)).all()
    other = filters.masks(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    for i in range(3):
        assert abs(np.mean(other >> np.uint64(i) & np.uint64(1)) - filters.false_rate[i]) < 0.01


def test_quality_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.learn(docs.where(crc32_mod4("doc_id") != 2), labels)
    rows = quality_gam.scored(docs.where(crc32_mod4("doc_id") == 2), model).join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    ranked = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(rows) > 50 and ranked > 0.85


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=30, pair_rounds=60, most_pairs=2)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "word " * 300_000, 9), (4, "😀", 9), (4, "😀", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality_gam.scored(docs, quality_gam.learn(docs, known)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality_gam.scored(docs.limit(0), quality_gam.learn(docs, labels)).count() == 0


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(4)
    words = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(30)] for k in range(70)}
    rows = [(f"{k}", " ".join(rng.choice(w, 40)), k) for k, w in words.items()]
    filters = language_id.learn(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    assert filters.langs == sorted(words)
    langs, scores = filters.identify([t for _, t, _ in rows])
    assert langs == [k for _, _, k in rows] and min(scores) > 0.5
