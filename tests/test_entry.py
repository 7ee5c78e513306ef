import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("hushframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "hushframe.llm", None)
    assert "mask_documents" in entry.queries() and not any(n.startswith("op") for n in entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    made = entry.queries()[name](spark, SMALL)
    columns = sorted(made.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in made.collect()))) == sorted(map(str, want.select(*(f'"{c}"' for c in columns)).fetchall()))
