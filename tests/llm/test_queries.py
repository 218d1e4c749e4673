"""Queries of this folder against their SQL on the smallest tables, where both exist."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p7_holds"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from cellmend.llm import queries

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries.QUERIES[name](spark, str(DATA))
    rel = con.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(rel.select(*names).fetchall(), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_classes_and_pairs_of_look_alikes_agree(spark):
    from cellmend.llm import queries

    pairs = [tuple(r) for r in queries.p8_found(spark, str(DATA)).collect()]
    links = {r.doc_id: r.links for r in queries.p8_classes(spark, str(DATA)).collect()}
    met: dict[int, int] = {}
    for a, b in pairs:
        assert a < b
        met[a], met[b] = met.get(a, 0) + 1, met.get(b, 0) + 1
    assert links == met and len(set(pairs)) == len(pairs)
