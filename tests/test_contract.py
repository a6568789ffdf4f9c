"""Every query of the library's own operators against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cutgrove.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    r = con.execute(ORACLE[name])
    cols = [c[0] for c in r.description]
    want = sorted((tuple(plain(v) for _, v in sorted(zip(cols, row))) for row in r.fetchall()), key=repr)
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in sorted(cols)) for row in df.collect()), key=repr)
    assert got == want


def test_solvers_never_lose_to_contraction(spark):
    from cutgrove.operators import multicut
    from cutgrove.plans.graph_queries import costs

    rows = [(r.u, r.v, r.cost) for r in costs(spark, DATA).collect()]
    energy = {n: multicut.cut_energy(rows, {r.node: r.label for r in QUERIES[n](spark, DATA).collect()}) for n in ("mc6_gaec", "mc7_kernighan_lin", "mc12_fusion")}
    assert energy["mc7_kernighan_lin"] <= energy["mc6_gaec"] + 1e-9 and energy["mc12_fusion"] <= energy["mc7_kernighan_lin"] + 1e-9
