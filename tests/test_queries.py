"""Every query of the core against its SQL twin on the smallest tables, and the shape of those without one."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.compare import frame  # noqa: E402
from tracegrid.plans import queries as plans  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    got = plans.queries()[name](spark, SF)
    if name not in SQL:
        rows = got.toPandas()
        # What SQL cannot say is held to what must be true of it: a key names one row, shares lie within 0 and 1, and only
        # queries whose subject the test tables lack are empty.
        keys = {
            "recommendation_risk": ["feature"], "best_of_detectors": ["capture_id"], "own_addresses": ["record_id"], "exclusive_groups": ["feature"], "p5_found": ["feed_id", "batch_no", "field_path", "change_kind", "new_path"],
            "p5_unified": ["raw_id"], "p4_bridges": ["owner_table", "owner_id", "child_path", "parent_key", "item_no"], "p4_nodes": ["node_hash"],
        }
        assert len(rows) > 0 or name in ("technology_fits", "script_extract", "meta_extract", "header_signals", "exclusive_groups")
        assert name not in keys or not rows.duplicated(keys[name]).any()
        for c in ("confidence", "score", "share"):
            assert c not in rows or rows[c].dtype == object or rows[c].dropna().between(0, 1).all()
        if name == "p4_bridges":
            assert set(rows["parent_hash"].dropna()) <= set(rows["node_hash"])
        return
    a, b = frame(got.toPandas()), frame(db.execute(SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head().to_string()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(plans.queries())
