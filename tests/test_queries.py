"""Every query with SQL against DuckDB, and the rest for rows."""

import oracle
import pytest

from tilecask.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE:
        assert oracle.differences(df, catalogue.ORACLE[name], duck) == []
    else:
        assert df.count() > 0


def test_entry_without_training_data(spark):
    """The registry stands without the training-data folders."""
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    code = "import sys\nclass No:\n  def find_spec(self, n, *a):\n    if n.startswith('tilecask.llm') or n == 'corpus_pipeline': raise ImportError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, timeout=120)
