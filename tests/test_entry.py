"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LOAD = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def load(folder):
    return subprocess.run([sys.executable, "-c", LOAD], cwd=folder, capture_output=True, text=True, timeout=120, check=True).stdout.split()


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    """Whether or not the pipeline's file stays behind."""
    for kept in (True, False):
        copy = tmp_path / str(kept)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py" if not kept else "-"))
        n, oracles, corpus = load(copy)
        assert int(n) > 20 and int(oracles) > 20 and corpus == "False"
