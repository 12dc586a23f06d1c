"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from readgrain.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(rows, names):
    def say(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{float(v):.5g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(say(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    found = c.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert plain([r.asDict() for r in got.collect()], sorted(names)) == plain(want, sorted(names))
