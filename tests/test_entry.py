"""The driver entry: what it lists, and that it works without the text operators and hides no error of theirs."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "sql_query" in entry.queries()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_totalprice"] and df.count() > 0


def run(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)


def test_without_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    done = run(copy, "import __spark_entry__ as e; n = set(e.queries()); assert 'sql_query' in n and 'pipeline' not in n and not any(x.startswith('op') and x[2].isdigit() for x in n); e.oracle_sql()")
    assert done.returncode == 0, done.stderr
    (copy / "larderlake/llm").mkdir()
    (copy / "larderlake/llm/__init__.py").write_text("")
    (copy / "larderlake/llm/queries.py").write_text("import not_there_at_all")
    done = run(copy, "import __spark_entry__ as e; e.queries()")
    assert done.returncode and "not_there_at_all" in done.stderr
