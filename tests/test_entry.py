"""The entry module, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("coppice.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") and n[2].isdigit() for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_imports_without_corpus_operators():
    n, corpus, known = run(BLOCKED)
    assert int(n) > 100 and corpus == "False" and known == "True"


def test_a_broken_corpus_operator_is_an_error(tmp_path):
    """Only their absence is let pass: a module that fails to import shows."""
    code = BLOCKED.replace('if name == "corpus_pipeline" or name.startswith("coppice.llm"):', 'if name == "xxhash":')
    with pytest.raises(subprocess.CalledProcessError):
        run(code)


def test_without_their_folders(tmp_path):
    """As the driver deletes them: the folder of the operators and the pipeline."""
    shutil.copytree(ROOT / "coppice", tmp_path / "coppice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) == set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}).stdout.split()
    assert int(out[0]) > 100 and out[1] == "True"


def test_nothing_else_imports_them():
    for p in (ROOT / "coppice").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["id", "prediction"] and out.count() == 1500
