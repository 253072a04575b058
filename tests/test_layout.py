"""What the layout promises: import without a session, and nothing outside depends on the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_llm_package():
    for path in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lectern.llm" not in path.read_text(), path


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
