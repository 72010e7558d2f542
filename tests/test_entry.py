"""The entry module where the training-data subpackage has been taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "pixelloom", tmp_path / "pixelloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"
