"""Every query of the library against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    said = duck.execute(registry.ORACLES[name])
    said_names = [d[0] for d in said.description]
    assert sorted(said_names) == names
    want = sorted([plain(r[said_names.index(c)]) for c in names] for r in said.fetchall())
    assert sorted([plain(r[c]) for c in names] for r in found.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_twin(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_window_shuffles_documents_and_sections_once(spark):
    """Of what is shuffled only texts before they are cut, and lists of whole sections, are long: no sentences, words or JSON."""
    plan = registry.QUERIES["J5_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    collected = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line and "collect_list" in below]
    assert len(collected) == 1 and "book" in collected[0] and "words" not in collected[0].replace("n_words", "")
