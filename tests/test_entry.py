"""The driver's contract, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 150; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 150


def test_the_rest_works_without_the_training_data_operators():
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('seqspark.llm', 'corpus_pipeline') else f(n, *a)\nimport __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "seqspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "seqspark.llm" not in p.read_text()


def test_entry_runs(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
