"""The driver contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

REPO = Path(__file__).parent.parent


def run(where, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=where, env=env, capture_output=True, text=True, timeout=120)


def test_every_query_has_sql_or_a_brute_force_test():
    import __spark_entry__ as entry

    brute = {"op1_simhash", "op3_token_counts", "op6_quality", "op7_toxicity", "op10_secrets", "pipeline"}
    assert set(entry.queries()) - set(entry.oracle_sql()) <= brute and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "bytetree"):
        src = REPO / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "bytetree/llm", ignore_errors=True)
    got = run(tmp_path, "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))")
    assert got.returncode == 0, got.stderr
    n, same, optional = got.stdout.split()
    assert int(n) > 80 and same == "True" and optional == "False"


def test_nothing_else_imports_the_optional_parts():
    for path in (REPO / "bytetree").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            text = path.read_text()
            assert "import llm" not in text and ".llm" not in text and "corpus_pipeline" not in text, path


def test_ship_sends_the_whole_package(spark):
    from bytetree import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "bytetree/session.py" in names and "bytetree/decode/vectors.py" in names
