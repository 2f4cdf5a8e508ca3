"""Every query of the core against its SQL, and the driver's entry points."""

import subprocess
import sys
from pathlib import Path

import pytest

from freshet.plans import carriers, flows, problems
from tests.oracle import database, same

Q = {**flows.queries(), **problems.queries(), **carriers.queries()}
SQL = {**flows.oracle_sql(), **problems.oracle_sql(), **carriers.oracle_sql()}
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, sf, name):
    same(spark, db, Q[name], SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert "key" in df.columns and df.count() >= 0
    assert set(Q) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_alone():
    """Nothing of the core imports the llm folder, and the entry works where it can't be imported."""
    for p in [*(ROOT / "freshet").glob("*.py"), *(q for q in (ROOT / "freshet").rglob("*.py") if "llm" not in q.parts)]:
        assert "freshet.llm" not in p.read_text(), p
    code = "import sys; sys.modules['freshet.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
