"""Every registered query runs; those with SQL give its rows on the smallest tables."""

from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from plantwatch.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(columns: list[str], rows: list) -> list:
    """Rows with their columns by name, as text; read as Python values, so that a null makes no number of another kind."""

    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, dict):
            return str({str(k): one(x) for k, x in sorted(v.items())})
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        if isinstance(v, Decimal):
            v = float(v) if v.as_tuple().exponent < 0 else int(v)
        if isinstance(v, float):
            return f"{v:.4f}".replace("-0.0000", "0.0000")
        return str(datetime(v.year, v.month, v.day)) if type(v) is date else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(one(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    got = found.collect()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found.columns, got) == plain(want.columns, want.fetchall())


def test_places_are_those_of_the_sql(spark, duck):
    values = [k / 1e7 for k in range(-1000005, 1000005, 110)] + [0.0654095, -0.0633145, 1234.0654095, 12345678901.2345675, 1e15 + 0.3, 1e305, -1e305, 4.9999999999999995e-7, 0.0, -0.0, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    want = duck.execute("SELECT round(unnest(?::DOUBLE[]), 6) + 0.0", [values]).fetchall()
    got = {i: v for i, v in catalog.rounded(df).collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(values))] == [v for v, in want]
    assert str(got[values.index(0.0)]) == "0.0"


def test_score_rows_to_the_last_place(spark):
    """On the tables where two rounded doubles lay one place beside the SQL's."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.sql(catalog.ORACLES["s32_score_rows"])
    found = catalog.QUERIES["s32_score_rows"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
