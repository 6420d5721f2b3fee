"""Properties from the survey's test strategy on the supplied tables."""

from pyspark.sql import functions as F

from conftest import SF01
from rfmlens.operators.rfm import compute_rfm
from rfmlens.operators.transform import fit_transform
from rfmlens.plans import base as B


def test_monetary_sums_to_line_totals(spark):
    lines = B.lines(spark, SF01)
    rfm = compute_rfm(lines)
    a = rfm.agg(F.sum("Monetary")).first()[0]
    b = lines.agg(F.sum("line_total")).first()[0]
    assert abs(a - b) <= 1e-9 * abs(b)
    assert rfm.count() == lines.select("customer_id").distinct().count()


def test_transform_monotone_and_bounded(spark):
    out, _ = fit_transform(B.rfm(spark, SF01))
    for f in ("Recency", "Frequency", "Monetary"):
        rows = sorted((r[0], r[1]) for r in out.select(f, f"{f}_s").collect())
        vals = [s for _, s in rows]
        assert all(0.0 <= v <= 1.0 for v in vals)
        assert all(a <= b for a, b in zip(vals, vals[1:])), f
        assert vals[0] == 0.0 and vals[-1] == 1.0


def test_unknown_customer_gives_no_rows(spark):
    from conftest import SF001
    from rfmlens.operators.lookup import customer_profile, nearest_peers
    sc = B.scored(spark, SF001)
    assert customer_profile(sc, B.cluster_map(spark, SF001), "no-such-id").count() == 0
    assert nearest_peers(sc, "no-such-id").count() == 0
