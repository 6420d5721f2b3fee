"""Command line: ``python -m rfmlens train|score ...`` (spark-submit works too).

    python -m rfmlens train --data sales.csv --out runs/r1 [--clusters 5] [--currency INR]
    python -m rfmlens score --data new.csv --model runs/r1/model --out runs/r1/new
"""

from __future__ import annotations

import argparse
import json

from rfmlens import dims
from rfmlens.operators.cluster import FINAL_WORK, SEARCH_WORK


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="rfmlens", description="RFM segmentation on Spark")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train", help="clean, build RFM, choose k, fit, label and save")
    t.add_argument("--data", required=True, help="transactions (CSV with header, or parquet)")
    t.add_argument("--format", default="csv", choices=["csv", "parquet"])
    t.add_argument("--out", required=True, help="folder for scored customers, model and metadata")
    t.add_argument("--clusters", type=int, default=None, help="force k (skip the search)")
    t.add_argument("--currency", default=dims.DEFAULT_CURRENCY)
    t.add_argument("--search-restarts", type=int, default=SEARCH_WORK[0])
    t.add_argument("--final-restarts", type=int, default=FINAL_WORK[0])
    s = sub.add_parser("score", help="score a transactions file with a saved model")
    s.add_argument("--data", required=True)
    s.add_argument("--format", default="csv", choices=["csv", "parquet"])
    s.add_argument("--model", required=True)
    s.add_argument("--out", required=True)
    a = p.parse_args(argv)

    from rfmlens import get_session
    from rfmlens.sources.readers import read_transactions
    spark = get_session()
    place = "_place" if a.format == "csv" else None        # ids of rows without one follow their place in the file
    df = read_transactions(spark, a.data, a.format, row_id=place)
    if a.cmd == "train":
        from rfmlens.plans.train import train
        res = train(df, k=a.clusters, currency=a.currency, search_restarts=a.search_restarts,
                    final_restarts=a.final_restarts, save_path=a.out, row_id_col=place)
        print(json.dumps({k: res.model.meta[k] for k in ("n_clusters", "silhouette_euclidean",
                                                         "davies_bouldin", "calinski_harabasz",
                                                         "fit_verdict", "n_customers")}, default=str))
    else:
        from rfmlens.plans.score import score
        from rfmlens.sources.model_store import load_model
        from rfmlens.sources.writers import write_scored
        scored, report = score(df, load_model(spark, a.model), row_id_col=place)
        write_scored(scored, f"{a.out.rstrip('/')}/scored")
        if report is not None:
            report.write.mode("overwrite").json(f"{a.out.rstrip('/')}/cleaning_report")


if __name__ == "__main__":
    main()
