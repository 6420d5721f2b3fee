from rfmlens.operators.labels import apply_labels, assign_segment_labels


def test_segment_label_golden(spark):
    # FIXTURES section 6: cluster means (R, F, M) -> names, n = 3
    rows = [(0, 10.0, 9, 900.0), (1, 60.0, 4, 300.0), (2, 200.0, 1, 50.0)]
    df = spark.createDataFrame(rows, "Cluster INT, Recency DOUBLE, Frequency LONG, Monetary DOUBLE")
    m = {r["Cluster"]: (r["Score"], r["Segment"]) for r in assign_segment_labels(df, 3).collect()}
    assert m == {0: (5.0, "Champions"), 1: (2.0, "Loyal Customers"), 2: (-1.0, "At-Risk Customers")}


def test_wraparound_and_default(spark):
    rows = [(c, float(100 - c * 10), c, float(c * 100)) for c in range(8)]
    df = spark.createDataFrame(rows, "Cluster INT, Recency DOUBLE, Frequency LONG, Monetary DOUBLE")
    cmap = assign_segment_labels(df, 8)
    names = [r["Segment"] for r in cmap.orderBy("order_pos").collect()]
    assert names[:6] == ["Champions", "Loyal Customers", "At-Risk Customers", "Lost / Inactive",
                         "New Customers", "Potential Loyalists"]
    assert names[6:] == names[:2]                       # rank % 6 repeats names (Q11)
    extra = spark.createDataFrame([(99, 1.0, 1, 1.0)], "Cluster INT, Recency DOUBLE, Frequency LONG, Monetary DOUBLE")
    got = apply_labels(extra, cmap).first()
    assert (got["Segment"], got["SegmentEmoji"], got["SegmentColor"]) == ("Segment 99", "📦", "#94a3b8")


def test_select_k_ignores_undefined_metrics(spark):
    from rfmlens.operators.cluster import select_k
    rows = [(3, 10.0, 0.5, 100.0, 0.8), (4, 8.0, 0.6, 120.0, 0.7), (5, 7.0, float("nan"), 90.0, 0.9)]
    m = spark.createDataFrame(rows, "k INT, inertia DOUBLE, silhouette_sq_euclidean DOUBLE, calinski_harabasz DOUBLE, "
                                    "davies_bouldin DOUBLE")
    best = [r["k"] for r in select_k(m).where("best").collect()]
    assert best == [4]
