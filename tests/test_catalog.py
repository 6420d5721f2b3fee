"""Every registered query against its DuckDB oracle on the smallest tables,
the same check the driver runs at sf0.01."""

import os
import sys

import pytest

from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from rfmlens.plans import catalog  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402



@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert {r["RFM_Tier"] for r in rows} <= {"High Value", "Mid Value", "Low Value"}
    assert sum(r["customers"] for r in rows) == 150


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
              "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(catalog.oracle_sql()[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        t = types[f.name]
        assert DUCK_TYPES.get(t, t.lower().replace(" ", "")) == f.dataType.simpleString(), (f.name, t)
    res = duck.execute(catalog.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_no_row_caps_or_subsets_in_oracles():
    """Whole tables only: a LIMIT appears only where it is the feature."""
    import re
    limited = {name for name, sql in catalog.oracle_sql().items() if re.search(r"\bLIMIT\b", sql)}
    assert limited <= {"preview_lines", "nearest_peers", "customer_profile", "random_customer", "profile_defaults", "peer_table"}, limited
    for name, sql in catalog.oracle_sql().items():
        # sampling, or a modulo on an id/key column (an id subset)
        assert not re.search(r"\bUSING\s+SAMPLE\b|\bTABLESAMPLE\b|\w*(key|id)\s*%", sql, re.I), name


def test_no_row_caps_in_queries():
    import inspect
    import re
    from rfmlens.plans import catalog, ml_queries
    src = inspect.getsource(catalog) + inspect.getsource(ml_queries)
    for m in re.finditer(r"def (q_\w+)\(spark, sf\):(.*?)(?=\n@query|\ndef |\Z)", src, re.S):
        body = m.group(2)
        if m.group(1) not in {"q_preview", "q_peers", "q_random"}:
            assert ".limit(" not in body and ".sample(" not in body, m.group(1)
