"""The entry module with and without what may be left out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def said(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/terralens", tmp_path / "terralens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    count = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') for n in q))"
    got = said(tmp_path, count)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout.split()[0]) > 90 and got.stdout.split()[1] == "False"


def test_a_broken_import_shows(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/terralens", tmp_path / "terralens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "terralens" / "llm").mkdir()
    (tmp_path / "terralens" / "llm" / "__init__.py").write_text("")
    (tmp_path / "terralens" / "llm" / "queries.py").write_text("import nothing_like_it\n")
    got = said(tmp_path, "import __spark_entry__")
    assert got.returncode != 0 and "nothing_like_it" in got.stderr
