"""The driver's entry, with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 10 and [r.score for r in rows] == sorted(r.score for r in rows)


def test_queries_and_sql_agree_on_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_operators():
    """The search queries stay when the optional package cannot be imported."""
    code = (
        "import sys; sys.modules['lodestone.llm'] = None; import __spark_entry__ as e;"
        "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
