from __future__ import annotations

import ast
import os

import oracle
import pytest
from conftest import ROOT

from docstrata import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, sf_dir, name):
    oracle.check(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_without_sql_is_repeatable(spark, sf_dir, name):
    one, two = (sorted(map(repr, catalog.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert one and one == two


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_llm_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "docstrata")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    tree = ast.parse(f.read())
                for node in ast.walk(tree):
                    used = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in u.split(".") for u in used), name
