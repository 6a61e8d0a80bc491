"""The entry module works with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__


def test_sql_has_a_query_each():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).columns == ["parent_id", "position", "id", "name", "has_children"]


def test_imports_without_the_optional_folders(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith(('canopy.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']\n"
    )
    root = __spark_entry__.__file__.rpartition("/")[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
