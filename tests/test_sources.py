import os
import tempfile

import numpy as np

from conftest import SF001
from rfmlens.sources.readers import NA_TOKENS, load_meta, read_transactions, source_profile, try_read_transactions
from rfmlens.sources.writers import write_meta


def test_csv_reader_all_text_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="rfmlens-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("Customer ID,InvoiceNo,Quantity\n1,A,3\nNA,B,N/A\n3,,2\n")
    df = read_transactions(spark, path)
    assert [t for _, t in df.dtypes] == ["string"] * 3
    rows = df.collect()
    assert rows[1]["Customer ID"] is None and rows[1]["Quantity"] is None and rows[2]["InvoiceNo"] is None
    assert "NA" in NA_TOKENS and "None" in NA_TOKENS
    prof = source_profile(df.withColumnRenamed("Customer ID", "customer_id")).first()
    assert (prof["n_rows"], prof["n_columns"], prof["n_customers"]) == (3, 3, 2)


def test_missing_file_message(spark):
    df, msg = try_read_transactions(spark, "/nonexistent/file.csv")
    assert df is None and "not found" in msg


def test_meta_roundtrip_and_defaults(spark):
    d = tempfile.mkdtemp(prefix="rfmlens-meta-")
    write_meta(spark, {"currency_code": "INR", "n_clusters": 4, "cap_values": {"Recency": 300.0}}, d + "/m")
    m = load_meta(spark, d + "/m").first()
    assert m["currency_code"] == "INR" and m["n_clusters"] == 4 and m["cap_values"]["Recency"] == 300.0
    dflt = load_meta(spark, None).first()
    assert (dflt["currency_code"], dflt["currency_symbol"], dflt["n_clusters"]) == ("USD", "$", 5)


def test_pca_matches_numpy(spark):
    from rfmlens.operators.cluster import SCALED, assemble, explained_variance, fit_pca, pca_coordinates
    from rfmlens.operators.transform import fit_transform
    from rfmlens.plans import base as B
    fitted, _ = fit_transform(B.rfm(spark, SF001))
    feats = assemble(fitted)
    scaler, pca, signs = fit_pca(feats)
    out = pca_coordinates(feats, scaler, pca, signs).select("customer_id", *SCALED, "PCA1", "PCA2").collect()
    x = np.array([[r[c] for c in SCALED] for r in out])
    xc = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    ratio = (s ** 2) / (s ** 2).sum()
    assert np.allclose(explained_variance(pca), ratio[:2], atol=1e-9)
    for j in range(2):
        v = vt[j] * (1 if vt[j][np.argmax(np.abs(vt[j]))] > 0 else -1)
        ref = xc @ v
        got = np.array([r["PCA1" if j == 0 else "PCA2"] for r in out])
        assert np.allclose(got, ref, atol=1e-9)
    assert abs(np.mean([r["PCA1"] for r in out])) < 1e-9
