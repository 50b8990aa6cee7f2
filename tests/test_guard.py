"""The library without its optional parts: the entry still imports, and nothing of the rest needs them."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "evidentia", tmp_path / "evidentia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'vocabulary_df' in n and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": os.environ["PATH"], "HOME": str(tmp_path)})


def test_nothing_else_names_the_subpackage():
    for f in (ROOT / "evidentia").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "evidentia").parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
