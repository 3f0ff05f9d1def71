"""The entry points, with and without the training-data package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_package():
    code = (
        "import sys; sys.modules['quillon.llm'] = None; sys.modules['quillon.llm.queries'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries()\n"
        "assert 'vector_search_topk' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q)\n"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_sql_has_queries():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.count() > 0 and got.columns == ["id", "path", "score", "distance"]
