import subprocess
import sys
from pathlib import Path

import pytest
from oracle import SF, difference

import __spark_entry__ as entry_module
from lexigrain.queries import ORACLE_SQL, QUERIES

GOLDEN = {"term_lookup": 122, "bool_and": 25, "bool_or": 39, "bool_and_not": 3, "bool_not": 78, "bigram_phrase": 42, "proximity_k": 62, "phrase_pairwise": 35, "phrase_strict": 3, "wildcard_prefix": 712, "wildcard_suffix": 505, "wildcard_trigram": 24, "wildcard_docs": 45, "bm25_stop": 26, "bm25_skip": 53}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF) == ""


@pytest.mark.skipif(not SF.endswith("sf0.001"), reason="counts of the smallest tables")
@pytest.mark.parametrize("name", GOLDEN)
def test_golden_counts(spark, name):
    assert QUERIES[name](spark, SF).count() == GOLDEN[name]


def test_entry(spark):
    top = entry_module.entry(spark).limit(3).collect()
    assert [(r.doc_id, r.rating) for r in top] == [(168, 9.304729), (71, 9.301721), (135, 9.283506)]
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_without_the_optional_folders(tmp_path):
    root = Path(__file__).resolve().parents[1]
    import shutil

    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "lexigrain", tmp_path / "lexigrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, check=True).stdout
    assert out.split(" ", 1) == [str(len(QUERIES)), "[]\n"]
