from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "quotes_topk" in entry.queries()


def test_the_rest_works_without_the_training_data_part(tmp_path):
    for name in ("bidloom", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "bidloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k.startswith('op') and k[2].isdigit() or k == 'pipeline'), len(e.queries()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip() == "[] True", done.stderr


def test_a_missing_library_of_the_training_data_part_leaves_the_rest():
    code = "import sys; sys.modules['zstandard'] = None; sys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e; print(sorted(k for k in e.queries() if k.startswith('op') and k[2].isdigit() or k == 'pipeline'), len(e.queries()) > 50)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.stdout.strip() == "[] True", done.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "bidloom")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert "bidloom.llm" not in f.read(), n
