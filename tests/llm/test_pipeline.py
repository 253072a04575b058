"""The pipeline's stages, each judged on what it got."""

import pytest

import corpus_pipeline as C
from lectern.llm import passages, quality_gam
from lectern.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append((name, docs))
    return out


def test_columns_and_names(spark, stages):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "passages", "mixing", "sentencepiece"]
    for _, df in stages[:-1]:
        assert df.columns == C.COLUMNS
    assert {"doc_id", "token_ids", "round_trip"} <= set(stages[-1][1].columns)


def test_each_stage_takes_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = dict(stages)
    model = quality_gam.learn(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_gam.scored(docs, model).where("score >= 0.7").collect()}
    assert {r.doc_id for r in by["quality"].collect()} == good
    kept = by["near_duplicates"].collect()
    assert len({r.text for r in kept}) == len(kept) and {r.doc_id for r in kept} <= good
    assert passages.repeated_passages(by["passages"]).count() == 0
    assert all(r.n_chars == len(r.text) for r in by["passages"].collect())
    assert {r.doc_id for r in by["mixing"].collect()} <= {r.doc_id for r in by["passages"].collect()}
    assert by["sentencepiece"].count() == by["mixing"].count() and by["sentencepiece"].where("NOT round_trip OR NOT parity").count() == 0


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "word " * 20_000, "en", "s", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {name: sorted((r.doc_id or 0) for r in stage(spark, docs, SF).collect()) for name, stage in C.STAGES}
    assert set(got["quality"]) <= {0, 1, 2, 3}
    assert got["near_duplicates"] == [0, 1, 3]  # null and empty texts are alike
    assert got["passages"] == [0, 1, 2, 2, 3] and got["sentencepiece"] == [0, 1, 2, 2, 3]
    assert set(got["mixing"]) == {0, 3}  # rows without words aren't taken
    cut = {r.doc_id: r.text for r in C.cut_passages(spark, docs, SF).collect()}
    assert cut[None] == "a b c" and cut[1] is None and 0 < len(cut[3].split()) < 200
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_unlike_texts_of_one_doc_id_or_none_stay(spark):
    new = lambda k: " ".join(f"t{k}_{i}" for i in range(60))
    given = [(None, new(0)), (None, new(1)), (None, new(1)), (None, new(2)), (5, new(3)), (5, new(4)), (5, new(4)), (6, new(4)), (7, new(5)), (None, new(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0), r.text) for r in C.one_of_each(spark, docs, SF).collect())
    assert got == sorted([(0, new(0)), (0, new(1)), (0, new(2)), (5, new(3)), (5, new(4)), (7, new(5))])
