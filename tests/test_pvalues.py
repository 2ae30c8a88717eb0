"""Family-wise p of values so small that the query's rounding hides them."""

import os

import duckdb
import pytest

from regionframe import catalog

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["regress_tfce_p", "regress_vba_mask"])
def test_p_is_of_the_value_before_it_is_rounded(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    r = db.sql(catalog.ORACLES[name])
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(x[c] for c in r.columns) for x in df.collect())
    assert got == sorted(r.fetchall())
    if name == "regress_tfce_p":
        assert any(tfce == 0 and p < 1 for *_, tfce, p in got)


def test_tfce_map_counts_the_maxima_above_the_value(spark, monkeypatch):
    """Enhanced t² a million times smaller: all round to 0, and no p changes."""
    from regionframe.jobs import inference

    whole, of = inference.enhanced, lambda: {(r.i, r.j, r.k): r.p for r in inference.tfce_map(spark, "/root/testdata/sf0.001").collect()}
    want = of()
    monkeypatch.setattr(inference, "enhanced", lambda images: whole(images).withColumn("tfce", inference.F.col("tfce") * 1e-12))
    assert of() == want and len(set(want.values())) > 1
