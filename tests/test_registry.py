import duckdb
import pytest

from runfold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "part")


def same(rows, other):
    norm = lambda r: tuple(None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    return sorted(map(norm, rows), key=repr) == sorted(map(norm, other), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, name):
    out = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = sorted(out.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({registry.SQL[name]})").fetchall()
    assert same([tuple(r) for r in out.select(*names).collect()], want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
