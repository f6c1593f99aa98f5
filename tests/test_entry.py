"""The entry without the optional subpackage, or without a library that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as entry
named = entry.queries()
print(sum(not n.startswith("op") and n != "pipeline" for n in named), len(named), len(set(entry.oracle_sql()) - set(named)))
"""


@pytest.mark.parametrize("blocked", ["zstandard", "tokenizers", "wardloom.llm", "corpus_pipeline"])
def test_core_queries_without(blocked):
    out = subprocess.run([sys.executable, "-c", COUNT, blocked], cwd=ROOT, capture_output=True, text=True, check=True)
    core, known, strange = map(int, out.stdout.split())
    assert core >= 66 and strange == 0
    assert known == core or blocked == "tokenizers"  # imported by the workers only
