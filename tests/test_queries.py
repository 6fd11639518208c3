import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from pairforge.plans import catalog  # noqa: E402
from verify import bag  # noqa: E402

#: Queries without SQL, which tests/test_whole_tables.py compares with plain Python.
ELSEWHERE = set(catalog.QUERIES) - set(catalog.SQL)


@pytest.fixture(scope="module")
def db(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


@pytest.mark.parametrize("name", sorted(set(catalog.SQL)))
def test_query(spark, sf_dir, db, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = bag(df.columns, df.collect())
    rel = db.sql(catalog.SQL[name])
    assert got == bag(rel.columns, rel.fetchall())


def test_every_query_is_compared_somewhere():
    other = (Path(__file__).parent / "test_whole_tables.py").read_text(encoding="utf-8")
    assert [name for name in ELSEWHERE if f'"{name}"' not in other] == []


def test_nothing_outside_imports_the_llm_package():
    root = Path(__file__).resolve().parents[1] / "pairforge"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "pairforge.llm" not in path.read_text(encoding="utf-8"), path
