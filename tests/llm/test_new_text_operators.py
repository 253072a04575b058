"""Fill-in-middle, exact duplicates and filter audits against plain versions and SQL, and their edge rows."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from lectern.llm import exact_dedup, fill_middle, filter_audit
from lectern.llm.common import text_slices
from lectern.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NASTY = ["", None, " ", "a", "é", "漢字 ab😀cd", "x<P>y", "<S", "<P", "<<S>", "ab\ncd\t\x0b ef", "  two  spaces ", "one two two", "A#b", "UPPER CASE", "z" * 5000 + " " + "y" * 5000, "w " * 300_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- fill in the middle ---------------------------------------------------------------------


def plain_cut(doc_id, text):
    text = text or ""
    s = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(s[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, t = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{t}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{t}<M>{m}"


def test_cuts_match_the_plain_version(spark):
    rng = random.Random(4)
    texts = NASTY + ["".join(rng.choice("ab <PSM>é漢\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    given = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "some words here", "x", 1), (5, "some words", "y", 2), (5, "some words", "y", 2)]
    docs = spark.createDataFrame(given, "doc_id long, text string, output string, n int")
    rows = fill_middle.restored(fill_middle.fill_in_middle(docs)).collect()
    want = sorted((str(i), *map(str, plain_cut(i, t)), t or "") for i, t, *_ in given)
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.restored) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.restored(fill_middle.fill_in_middle(docs.limit(0))).count() == 0


def test_outputs_without_their_marks_are_refused(spark):
    made = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="lacks the marks"):
        fill_middle.restored(made).collect()
    none = spark.createDataFrame([(None, "psm", 1), ("a", None, 2), ("b", "plain", 3)], "output string, form string, restored int")
    assert [r.restored for r in fill_middle.restored(none).collect()] == [None, None, "b"]


def test_slices_hold_whole_texts():
    import pyarrow as pa

    texts = ["ab", None, "", "é" * 50, "c"]
    batch = pa.record_batch([pa.array(texts)], ["text"]).slice(1)
    got = []
    for some, data, offsets in text_slices(batch, "text", 3):
        got += [bytes(data[a:b]).decode() for a, b in zip(offsets, offsets[1:])]
        assert len(offsets) == some.num_rows + 1
    assert got == ["", "", "é" * 50, "c"]


# -- exact duplicates -----------------------------------------------------------------------


def plain_groups(given):
    groups = {}
    for i, (doc_id, text, *_) in enumerate(given):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc_id is None, doc_id or 0, i))
    out = []
    for text, rows in groups.items():
        keep = min(rows)
        out += [(str(given[i][0]), str(given[keep[2]][0]), len(rows), sha(text)) for *_, i in rows]
    return sorted(out), len(groups)


def copies():
    rng = random.Random(8)
    base = [" ".join(rng.choice(["ab", "cd", "e", "é"]) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    long_ = "same beginning " * 40
    given = [(i, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\t", " \n"]))) for i in range(500)]
    given += [(600, long_ + "a"), (601, long_ + "b"), (602, long_ + "a"), (603, "q" * 300), (604, "r" * 300)]
    given += [(1000 + i, t) for i, t in enumerate(NASTY)] + [(None, "ab"), (None, None), (None, "only null ids"), (None, "only null ids"), (7, "ties"), (7, "ties")]
    return given + [(2000 + i, "hot text\n") for i in range(300)]


def test_groups_match_the_plain_version(spark):
    given = copies()
    docs = spark.createDataFrame([(*g, 1, "t") for g in given], "doc_id long, text string, keep_id int, start string")
    rows = exact_dedup.exact_duplicates(docs, hash_all=True).collect()
    want, groups = plain_groups(given)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_hash) for r in rows) == want
    assert sum(r.kept for r in rows) == groups
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    # A set of bits that is far too small only lets more texts be hashed.
    small = exact_dedup.exact_duplicates(docs, hash_all=True, bits=6, prefix=1).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_hash) for r in small) == want
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_texts_that_are_alone_have_no_hash(spark):
    docs = spark.createDataFrame([(1, "a", "u"), (2, "a ", "v"), (3, "a\t", "w"), (4, "b ", "x")], "doc_id long, text string, note string")
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, carry=("note",)).collect()}
    assert {i: (r.keep_id, r.kept, r.text_hash is None, r.note) for i, r in rows.items()} == {1: (1, True, True, "u"), 2: (2, True, False, "v"), 3: (2, False, False, "w"), 4: (4, True, True, "x")}


def test_rows_that_stay_have_all_their_columns(spark):
    docs = spark.createDataFrame([(2, "x y", 1, None), (1, "x  y", 2, "k"), (3, "z", 3, "l"), (3, "z", 3, "l")], "doc_id long, text string, row int, kept string")
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "x  y", 2, "k"), (3, "z", 3, "l")]


# -- audits of filters ----------------------------------------------------------------------


def plain_audit(given, labels):
    texts = [(i, t or "", s or "") for i, t, s, *_ in given]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = []
    for i, t, part in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((part, {k for k, v in f.items() if v}, *labels.get(i, (0, 0))))
    out, shapley = [], {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in orders:
            for k, x in enumerate(order):
                here = [f for f in own if x in f[1] and not f[1] & set(order[:k])]
                shapley[part, x] = shapley.get((part, x), 0) + len(here)
                out.append([part, order, k + 1, sum(not f[1] & set(order[: k + 1]) for f in own), len(here), sum(bool(x in f[1] and f[1] & set(order[:k])) for f in own), sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)])
    return sorted(tuple(r) + (shapley[r[0], r[1][r[2] - 1]],) for r in out)


def test_audit_matches_the_plain_version(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "漢字"]
    given = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))), rng.choice(["s", "t", "", None]), 1, "m") for i in range(120)]
    given += [(300 + i, given[i][1], "t", 1, "m") for i in range(30)] + [(500 + i, t, rng.choice(["s", None]), 0, "m") for i, t in enumerate(NASTY)]
    given += [(None, "null id", "s", 0, "m"), (None, "null id", "s", 0, "m"), (9000, "null id", "s", 0, "m"), (700, "tie", "s", 0, "m"), (700, "tie", "s", 0, "m")]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, own int, mask string")
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 520, 2)}
    said = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.mask_counts(filter_audit.document_masks(docs), said))
    assert sorted(map(tuple, found.collect())) == plain_audit(given, labels)
    empty = filter_audit.audit(filter_audit.mask_counts(filter_audit.document_masks(docs.limit(0)), said))
    assert empty.count() == 0


def test_distinct_words_are_verified():
    data = np.frombuffer(b"ab cd ab ef" + b"ab ab gh", np.uint8)
    offsets = np.array([0, 11, 11, 19])
    starts, ends, counts = filter_audit.words_of(data, offsets)
    assert counts.tolist() == [4, 0, 3]
    assert filter_audit.distinct_words(data, starts, ends, counts).tolist() == [3, 0, 2]
    # All words have one hash: the texts are counted from their words.
    same = np.zeros(len(starts), np.uint64)
    assert filter_audit.distinct_words(data, starts, ends, counts, same).tolist() == [3, 0, 2]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = b" ".join(bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in [*rng.integers(1, 9, 4000), 6000])
    data = np.frombuffer(text, np.uint8)
    starts, ends, counts = filter_audit.words_of(data, np.array([0, len(data)]))
    whole = filter_audit.hashes(data, starts, ends)
    assert filter_audit.distinct_words(data, starts, ends, counts).tolist() == [len(set(text.split()))]
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    assert (filter_audit.hashes(data, starts, ends) == whole).all()
    assert filter_audit.distinct_words(data, starts, ends, counts).tolist() == [len(set(text.split()))]


# -- queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_exact_dedup", "op13_filter_audit"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    said = con.execute(ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(str, said.fetchall()))
