"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, oracle, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    relation = oracle.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in relation.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())


def test_both_forms_of_the_biome_rules_agree(spark):
    a, b = (catalog.queries()[n](spark, str(DATA)) for n in ("biome_classify", "biome_classify_join"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
