import importlib
import subprocess
import sys

from .conftest import ROOT

ALONE = """
import sys
sys.modules["framewright.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 20 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_text_operators():
    subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, check=True, timeout=120)


def test_entry_query_has_rows(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
