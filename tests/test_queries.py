"""Every registered query of the plain registries against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from folioscope.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
SLOW = {"CTL1_CTL2_CTL4_DAT1_stored_run", "GEO1_GEO3_graphics_in_zones", "GEO2_inside_zone", "GEO7_AGG11_accepted_captions", "GEO8_SET3_figure_boxes", "JN3_figures_of_papers", "WIN9_first_figure"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


@pytest.mark.parametrize("name", [n for n in SQL if os.environ.get("ALL_QUERIES") or n not in SLOW])
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(plain(r)) for r in cursor.fetchall())
    got = sorted(str(plain([r[c] for c in columns])) for r in df.collect())
    assert got == want and got


def test_every_query_has_sql():
    assert set(SQL) == set(registry.queries())
