"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_training_data_part(tmp_path):
    """With the subpackage gone the catalogue still loads, whether or not the pipeline file is there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "docloom", copy / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'txt1_ranked' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 150, out.stderr
