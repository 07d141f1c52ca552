import duckdb
import pytest

import __spark_entry__ as entry
from canopy.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    made = db.execute(registry.ORACLES[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    want = sorted(tuple(_plain(row[names.index(c)]) for c in columns) for row in made.fetchall())
    assert got == want
