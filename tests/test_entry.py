import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent

GONE = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("bytegrain.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, ".")
import __spark_entry__ as e
assert "intel_documents" in e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"], list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_training_data_package():
    assert subprocess.run([sys.executable, "-c", GONE], cwd=ROOT, capture_output=True, text=True).returncode == 0


def test_nothing_else_imports_it():
    for p in (ROOT / "bytegrain").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "bytegrain.llm" not in p.read_text()


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 200 and set(e.oracle_sql()) <= set(e.queries())
