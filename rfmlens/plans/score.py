"""Batch scoring plan (M17): a new transactions file through the saved model,
no refit except (optionally) the display-only PCA, as the reference does."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rfmlens.operators.clean import clean_transactions
from rfmlens.operators.cluster import assemble, fit_pca, pca_coordinates, predict
from rfmlens.operators.labels import apply_labels
from rfmlens.operators.rfm import compute_rfm
from rfmlens.operators.transform import transform
from rfmlens.plans.train import SegmentModel

SCORED_OUT = ("customer_id STRING, Recency BIGINT, Frequency BIGINT, Monetary DOUBLE, Cluster INT, "
              "PCA1 DOUBLE, PCA2 DOUBLE, Segment STRING, SegmentEmoji STRING, SegmentColor STRING")


def score(df: DataFrame, model: SegmentModel, clean: bool = True, refit_pca: bool = True,
          row_id_col: str | None = None, snapshot=None) -> tuple[DataFrame, DataFrame | None]:
    """Returns (scored customers, cleaning report or None).

    Recency is measured from this file's own last purchase (+1 day) unless a
    ``snapshot`` is given. ``refit_pca`` reproduces the per-file PCA (Q14);
    otherwise the training PCA is reused so coordinates are comparable.
    """
    spark = df.sparkSession
    report = None
    if clean:
        df, report = clean_transactions(df, row_id_col=row_id_col)
    rfm = compute_rfm(df, snapshot)
    if rfm.isEmpty():                      # C13: nothing to score, and nothing to fit PCA on
        return spark.createDataFrame([], SCORED_OUT), report
    feats = assemble(transform(rfm, model.transform))
    pred = predict(model.kmeans, feats)
    if refit_pca or model.pca is None:
        kept = feats.select("features").cache()     # PCA passes over it twice
        scaler, pca, signs = fit_pca(kept)
        kept.unpersist()
    else:
        scaler, pca, signs = model.pca
    out = apply_labels(pca_coordinates(pred, scaler, pca, signs), model.cluster_map_df(spark))
    return out.select("customer_id", "Recency", "Frequency", "Monetary", "Cluster", "PCA1", "PCA2",
                      "Segment", "SegmentEmoji", "SegmentColor"), report


def score_upload(spark, path: str, model: SegmentModel, fmt: str = "csv"):
    """S2 + P2 + C0 + C13 + M17 as one call, the way an uploaded file is
    handled: returns (scored, report, message). An unreadable file or a
    file with no usable customer gives (None, None, message); otherwise the
    message lists the roles that were synthesised ('' when none)."""
    from rfmlens.operators.clean import require_rows
    from rfmlens.operators.schema import schema_messages
    from rfmlens.sources.readers import try_read_transactions
    place = "_place" if fmt == "csv" else None
    df, err = try_read_transactions(spark, path, fmt, place)
    if df is None:
        return None, None, err
    note = schema_messages([c for c in df.columns if c != place])
    scored, report = score(df, model, row_id_col=place)
    empty = require_rows(scored)
    if empty:
        return None, report, empty
    return scored, report, note
