import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"doc_id", "text"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_other_subpackage():
    code = "import sys; sys.modules['umbra.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    for p in (ROOT / "umbra").rglob("*.py"):
        if "llm" not in p.parts:
            assert "umbra.llm" not in p.read_text()
