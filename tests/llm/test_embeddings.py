import numpy as np
from brute import classes_of

from lectern.llm import pivot_index


def check(spark, ids, vectors, least_recall=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= pivot_index.LINK
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(rows).collect()}
    assert len(got) == len(ids)
    counts = dict(zip(ids, near.sum(1).tolist()))
    assert all(got[i].n_links <= counts[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= least_recall * sum(counts.values())
    want = classes_of(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))])
    same = sum(got[i].component_id == want[i] for i in ids)
    assert same >= least_recall * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    near = np.repeat(centres, 8, 0) + rng.normal(size=(480, 32)) * 0.12
    check(spark, list(range(1, 781)), np.concatenate((near, rng.normal(size=(300, 32)))))


def test_a_hot_group(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=(1, 24)) + rng.normal(size=(1500, 24)) * 0.02
    check(spark, list(range(2300)), np.concatenate((hot, rng.normal(size=(800, 24)))))


def test_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check(spark, [r.vec_id for r in rows], np.array([r.embedding for r in rows], float))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, -0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*x, "l", 5) for x in given], "vec_id long, embedding array<double>, label string, n_links int")
    got = pivot_index.near_duplicates(vectors).collect()
    assert len(got) == len(given)
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id in (1, 2, 3, 4, 5, 6, 10))
    assert {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in (7, 8, 9)} == {(7, 3, 7), (8, 3, 7), (9, 3, 7)}
    assert pivot_index.near_duplicates(vectors.limit(0)).count() == 0


def test_rows_of_null_and_shared_ids(spark):
    """One row out for each row in, with the links of its own vector, as a brute force over rows has them."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 16))
    vectors = [base[i % 12] + rng.normal(size=16) * 0.01 * (i // 12) for i in range(48)] + [base[0], base[0], base[1]]
    ids = [None if i % 7 == 3 else i % 20 for i in range(len(vectors))]
    ids[:3] = [5, 5, None]  # two unlike vectors of one id, and none
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors)] + [(None, None), (5, None), (None, [0.0] * 16)]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= pivot_index.LINK
    np.fill_diagonal(near, False)
    same = near | np.array([[a is not None and a == b for b in ids] for a in ids])
    places = list(range(len(ids)))
    group = classes_of(places, [(i, j) for i, j in zip(*np.nonzero(same))])
    least = {}
    for i in places:
        if ids[i] is not None:
            least[group[i]] = min(ids[i], least.get(group[i], ids[i]))
    want = [(ids[i], int(near[i].sum()), least.get(group[i])) for i in places] + [(None, 0, None), (5, 0, 5), (None, 0, None)]
    assert sorted(map(str, [(r.vec_id, r.n_links, r.component_id) for r in got])) == sorted(map(str, want))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    three = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (1, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in pivot_index.near_duplicates(three).collect()) == ["(1, 1, 1)", "(None, 0, None)", "(None, 1, 1)"]
    shared = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in pivot_index.near_duplicates(shared).collect()) == [(5, 0, 5), (5, 1, 5), (7, 1, 5)]


def test_lengths_are_compared_each_for_itself(spark):
    rng = np.random.default_rng(7)
    given = [(0, rng.normal(size=5))]  # an odd length at the least vec_id
    for width, at in ((16, 1), (24, 101)):
        centres = np.repeat(rng.normal(size=(10, width)), 3, 0)
        given += [(at + i, v) for i, v in enumerate(centres + rng.normal(size=centres.shape) * 0.01)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in given], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_duplicates(rows).collect()}
    assert got == {0: (0, 0)} | {at + i: (2, at + i - i % 3) for at in (1, 101) for i in range(30)}


def test_recall_of_planted_pairs(spark):
    """Pairs of cosine 0.95 to 0.97 among many unlike vectors."""
    rng = np.random.default_rng(21)
    for width in (64, 256):
        base = rng.normal(size=(300, width))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        other = rng.normal(size=base.shape)
        other -= (other * base).sum(1, keepdims=True) * base
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        cosine = rng.uniform(0.951, 0.97, (300, 1))
        noise = rng.normal(size=(2400, width))
        vectors = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * other, noise))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.component_id for r in pivot_index.near_duplicates(rows).collect()}
        found = sum(got[300 + i] == i for i in range(300))
        print("recall", width, found / 300)
        assert found >= 0.95 * 300
        assert all(got[i] == i for i in range(600, 3000))


def test_lists_use_the_order_of_pivots():
    keys = pivot_index.list_keys(np.array([[3, 1, 4, 0, 5, 2], [2, 5, 0, 4, 1, 3]]), 6)
    assert keys.shape == (2, 11) and all(len(set(k)) == 11 for k in keys.tolist())
    # The same six pivots in reverse order share fewer lists than there are.
    assert 0 < len(set(keys[0]) & set(keys[1])) < 11
