"""The driver's contract, and independence from the training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["chunk_id", "score"] and df.count() == 10


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    for path in (ROOT / "seekmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_works_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(ROOT / "seekmill", tmp_path / "seekmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
