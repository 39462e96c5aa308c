"""Nothing outside the corpus subpackage may need it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_import_of_the_corpus_operators():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_the_rest_works_without_them(tmp_path):
    """A copy without the corpus folders still registers all other queries."""
    import shutil
    import subprocess
    import sys

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=120)
