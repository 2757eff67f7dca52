import ast
import os

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).limit(3).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/tagveil"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    tree = ast.parse(open(f"{folder}/{f}").read())
                    names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                    assert not any(n.startswith("tagveil.llm") for n in names)
