import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') or q == 'pipeline' for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def listed(folder: Path) -> list[str]:
    run = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return run.stdout.split()


def test_queries_without_the_corpus_operators(tmp_path):
    for name in ("engrama", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "engrama/llm", ignore_errors=True)
    alone = listed(tmp_path)  # with the pipeline's module left behind
    assert int(alone[0]) > 50 and alone[1:] == ["0", "True"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(tmp_path) == alone
