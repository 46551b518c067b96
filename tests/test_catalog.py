import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


def test_every_query_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test data")
    sys.path.insert(0, str(Path(__file__).parent / "tools"))
    import run

    from loamweave.plans import catalog

    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    wrong = []
    for name, query in catalog.queries().items():
        df = query(spark, DATA)
        got = run.rows(df.columns, [tuple(r) for r in df.collect()])
        if sql := catalog.oracle_sql().get(name):
            rel = con.sql(sql)
            if sorted(rel.columns) != sorted(df.columns) or run.rows(rel.columns, rel.fetchall()) != got:
                wrong.append(name)
    assert not wrong


def test_nothing_outside_imports_the_optional_part():
    root = Path(__file__).resolve().parents[1] / "loamweave"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "loamweave.llm" in p.read_text()]
