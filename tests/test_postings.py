"""Search through postings against a plain search."""

import random

from pyspark.sql import functions as F

from lectern.operators import postings as K


def test_many_needles_find_what_a_plain_search_finds(spark, tmp_path):
    rng = random.Random(9)
    words = ["lamp", "Lantern", "OAK", "é", "ab", "a", "  ", "river's", "漢字"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "", "x", "xy", "ab", "the end ab"]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    needles = ["lamp", " LAMP ", "p L", "ab", "é ", "漢字", "oak é", "nothing like it", "lan", "x", "", None, "xy", "rive", "tern  ", "a a a"]
    path = str(tmp_path / "index")
    K.write_index(items, ["id"], path)
    index = K.read_index(spark, path)
    found = K.find(index, items, ["id"], spark.createDataFrame([(n,) for n in needles], "needle string"))
    asked = {n.strip(" ").lower() for n in needles if n is not None}
    want = sorted((n, i, (t or "").lower().find(n)) for n in asked if len(n) >= 2 for i, t in enumerate(texts) if n in (t or "").lower())
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    # Texts without a needle's trigrams aren't looked at.
    assert index.where(F.col("gram") == "nothing"[:3]).isEmpty()
    none = spark.createDataFrame([], "needle string")
    assert K.find(index, items, ["id"], none).isEmpty()


def test_an_index_by_document_is_smaller_than_its_texts_and_finds_the_same(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = [(doc, sent, " ".join(rng.choice(words) for _ in range(12))) for doc in range(120) for sent in range(30)]
    items = spark.createDataFrame(rows, "doc int, sent int, text string").coalesce(2)
    path = str(tmp_path / "index")
    K.write_index(items, ["doc"], path)
    needles = [words[0], f"{words[1]} {words[2]}"[:6].strip(), "ae", "zz", rows[7][2]]
    found = K.find(K.read_index(spark, path), items, ["doc", "sent"], spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted(map(tuple, found.collect())) == sorted((n, d, s, t.find(n)) for n in set(needles) for d, s, t in rows if n in t)
    # A posting for each gram of each sentence took several times the text.
    size = sum(f.stat().st_size for f in (tmp_path / "index").rglob("*.parquet"))
    assert size < sum(len(t) for _, _, t in rows)
