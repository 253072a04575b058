"""Answers, masks, folds and chunks on small pinned cases."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import planning as M


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', '{"a": 1}'), ('<think>{"a": 2}</think> {"b": "}{"}', '{"b": "}{"}'), ('first {"a": 1} last {"b": {"c": 2}} end', '{"b": {"c": 2}}'),
    ('```json\n{"a": "q\\"}"}\n```', '{"a": "q\\"}"}'), ('{"a": 1} and {not json}', '{"a": 1}'), ("[1, 2]", None), ('{"open": 1', None), ("", None), (None, None), ("}} {\"a\": 0} {{", '{"a": 0}'),
])
def test_last_object(text, want):
    assert M.last_object(text) == want


def test_answers(spark):
    rows = spark.createDataFrame([(1, "  ", '{"breaks": {"0": "10"}}'), (2, '{"groups": [{"para": 1, "from": 0, "to": 3}]}', "x"), (3, None, " ")], "k int, content string, reasoning string")
    made = rows.select("k", M.json_object(M.answer_text(F.col("content"), F.col("reasoning"))).alias("a"))
    got = {r.k: (r.b, r.g) for r in made.select("k", M.breaks_of(F.col("a")).alias("b"), M.legacy_groups(F.col("a")).alias("g")).collect()}
    assert got[1] == ({"0": "10"}, None) and [tuple(g) for g in got[2][1]] == [(1, 0, 3)] and got[3] == (None, None)


def groups(spark, sents, mask):
    df = spark.createDataFrame([(1, 0, sents, mask)], "doc_id int, para int, sents array<string>, mask string")
    r = M.grouped(df).first()
    return r.by_mask, [(g["from"], g["to"]) for g in r.groups]


def test_masks_are_repaired(spark):
    s = [f"Sentence {i} is here." for i in range(5)]
    assert groups(spark, s, "10100") == (True, [(0, 1), (2, 4)])
    assert groups(spark, s, "00000") == (True, [(0, 4)])  # the first always begins one
    assert groups(spark, s, "11") == (True, [(0, 0), (1, 4)])
    assert groups(spark, s, "1001011111") == (True, [(0, 2), (3, 4)])
    assert groups(spark, s, "1000000002")[0] and not groups(spark, s, "1002")[0]
    for mask in (None, "", "abc"):
        by_mask, packed = groups(spark, s, mask)
        assert not by_mask and packed == [(0, 4)]
    assert groups(spark, [], "1") == (False, [])


def test_cover(spark):
    def ok(pairs, n):
        df = spark.createDataFrame([(pairs, n)], "g array<struct<from:int,to:int>>, n int")
        return df.select(M.covers(F.col("g"), F.col("n")).alias("ok")).first().ok

    assert ok([(0, 1), (2, 4)], 5) and ok([(2, 4), (0, 1)], 5)
    assert not any((ok([(0, 1), (3, 4)], 5), ok([(0, 2), (2, 4)], 5), ok([(0, 3)], 5), ok([(0, 5)], 5), ok([(1, 4)], 5), ok([], 0), ok([(2, 1)], 2)))


def plain_fold(groups, sents, least=40, most=300):
    """The rule as it reads: again and again the first small group joins a neighbour."""
    spans, size = list(groups), lambda a, b: len(" ".join(sents[a : b + 1]))
    again = True
    while again:
        again = False
        for i, (a, b) in enumerate(spans):
            if size(a, b) >= least:
                continue
            if i and size(spans[i - 1][0], b) <= most:
                spans[i - 1 : i + 1] = [(spans[i - 1][0], b)]
            elif i + 1 < len(spans) and size(a, spans[i + 1][1]) <= most:
                spans[i : i + 2] = [(a, spans[i + 1][1])]
            else:
                continue
            again = True
            break
    return spans


def test_folds_equal_the_rule_as_it_reads(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for k in range(200):
        sents = ["x" * rng.choice([5, 20, 38, 45, 120, 250, 290]) for _ in range(rng.randint(1, 12))]
        cuts = sorted({0, *(rng.randrange(len(sents)) for _ in range(rng.randint(0, 8)))})
        g = [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(sents)])]
        rows.append((k, sents, g))
        want[k] = plain_fold(g, sents)
    df = spark.createDataFrame(rows, "k int, sents array<string>, g array<struct<from:int,to:int>>")
    got = {r.k: [(x["from"], x["to"]) for x in r.f] for r in df.select("k", M.folded(F.col("g"), F.col("sents")).alias("f")).collect()}
    assert got == want


def test_long_groups_are_cut_again(spark):
    sents = [f"This is sentence number {i} of a long paragraph, and it ends here." for i in range(9)]
    df = spark.createDataFrame([(1, 0, sents, [(0, 7), (8, 8)])], "doc_id int, para int, sents array<string>, groups array<struct<from:int,to:int>>")
    got = M.chunks_of_groups(df).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(got))) and all(len(r.text) <= 300 for r in got)
    assert " ".join(r.text for r in got) == " ".join(sents) and got[-1].s1 == 8


def test_prompt_and_report(spark):
    s = spark.createDataFrame([(1, 0, 0, "One."), (1, 0, 1, "Two\nhere."), (1, 3, 0, "Three.")], "doc_id int, para int, sent int, text string")
    assert M.prompts(s, "Rules").first().prompt == "Rules\nparagraph 0:\n0 (4) One.\n1 (9) Two here.\n\nparagraph 3:\n0 (6) Three.\n"
    docs = spark.createDataFrame([(1, True, None), (2, False, "bad_json"), (3, False, "timeout"), (4, False, "bad_json")], "doc_id int, used boolean, reason string")
    assert tuple(M.planner_report(docs, "m").first()) == ("llm:m", 1, 3, "bad_json=2,timeout=1")
    assert tuple(M.planner_report(docs.where("NOT used"), "m").first())[:3] == ("heuristic", 0, 3)


def test_a_report_works_out_its_documents_once(spark):
    docs = spark.createDataFrame([(1, True, None), (2, False, "bad_json"), (3, False, "bad_json"), (4, False, None), (5, None, "odd")], "doc_id int, used boolean, reason string")
    said = M.planner_report(docs, "stub")
    assert said._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert tuple(said.first()) == ("llm:stub", 1, 3, "bad_json=2") and tuple(M.planner_report(docs.limit(0), "stub").first()) == ("heuristic", 0, 0, "")
