"""The driver's entry file, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [(), ("siftstone/llm", "corpus_pipeline.py"), ("siftstone/llm",), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_removable_parts(tmp_path, gone):
    for name in ("siftstone", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name)
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr
    count, corpus = run.stdout.split()
    assert int(count) > 40
    if "siftstone/llm" in gone:
        assert corpus == "False"
