"""Every query of the engine on the small tables, against its SQL in DuckDB where there is one."""

import math

import duckdb
import pytest

from tarnflow.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_small, db):
    df = QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    rows = ordered([r[c] for c in columns] for r in df.collect())
    assert rows
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert rows == ordered([r[names.index(c)] for c in columns] for r in found.fetchall())
