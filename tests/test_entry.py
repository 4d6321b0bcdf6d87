"""The entry works without the training-data operators, or without a package that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}: raise ModuleNotFoundError("blocked", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q = e.queries()
assert "strategy_ranking" in q and not any(n.startswith("op1_") for n in q) and "pipeline" not in e.oracle_sql()
"""


@pytest.mark.parametrize("name", ["quarry.llm", "corpus_pipeline", "zstandard", "public_tokenizers"])
def test_core_queries_stay(name):
    subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("name", ["quarry.llm.bpe", "quarry.storage", "pyarrow"])
def test_a_broken_module_is_not_swallowed(name):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=ROOT, capture_output=True, timeout=120, check=False)
    assert done.returncode and b"ImportError" in done.stderr.replace(b"ModuleNotFoundError", b"ImportError")
