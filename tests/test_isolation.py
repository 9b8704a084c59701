"""The tree without the training-data subpackage and its tests: the entry works and the other tests are found."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_training_data_operators(tmp_path):
    to = tmp_path / "tree"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "spark-warehouse"))
    for folder in ("sunlattice/llm", "tests/llm"):
        shutil.rmtree(to / folder, ignore_errors=True)

    def outcome(*args):
        return subprocess.run([sys.executable, *args], cwd=to, capture_output=True, text=True, timeout=300, check=False)

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q) > 100, set(s) <= set(q), any(k.startswith('op1') or k == 'pipeline' for k in q))"
    for _ in range(2):  # the second time without the pipeline's module
        found = outcome("-c", code)
        assert found.stdout.split() == ["True", "True", "False"], found.stderr
        (to / "corpus_pipeline.py").unlink(missing_ok=True)
    collected = outcome("-m", "pytest", "--collect-only", "-q", "tests")
    assert collected.returncode == 0, collected.stdout[-2000:]
