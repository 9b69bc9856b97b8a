"""The rest works without the subpackage llm and the pipeline, whose files may be gone."""

import shutil
import subprocess
import sys
from pathlib import Path

from quaestor.plans import registry

ROOT = Path(__file__).parent.parent
PROBE = """
import __spark_entry__ as entry
print(" ".join(sorted(entry.queries())))
print(" ".join(sorted(entry.oracle_sql())))
"""


def names(folder: Path) -> list[set[str]]:
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    return [set(line.split()) for line in out.stdout.splitlines()]


def test_without_llm(tmp_path):
    for gone in (["quaestor/llm", "tests/llm"], ["quaestor/llm", "tests/llm", "corpus_pipeline.py"]):
        folder = tmp_path / str(len(gone))
        shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__"))
        for name in gone:
            path = folder / name
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
        assert names(folder) == [set(registry.QUERIES), set(registry.ORACLES)]
