"""Cluster assignment and quality metrics as DataFrame aggregates.

Everything is O(n * k): per-cluster sums (k <= 8 rows) are read back once and
every row is then scored against them with column expressions.

The silhouette here is the *squared*-Euclidean form (Spark's ``ClusteringEvaluator``),
which has this exact O(n * k) expression; ``operators.silhouette`` has the Euclidean one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The squared-Euclidean silhouette always goes by this name.
SILHOUETTE = "silhouette_sq_euclidean"


def _sq_dist(cols: list[str], center: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lit(float(m)), 2) for c, m in zip(cols, center)])


def cluster_sums(df: DataFrame, cols: list[str], cluster_col: str = "Cluster") -> dict[int, dict]:
    """Per cluster: N, sum of each feature, sum of squared norms (k rows)."""
    aggs = [F.count(F.lit(1)).alias("N")] + [F.sum(c).alias(f"s_{c}") for c in cols]
    aggs.append(F.sum(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])).alias("psi"))
    out = {}
    for r in df.groupBy(cluster_col).agg(*aggs).collect():
        n = int(r["N"])
        out[int(r[cluster_col])] = {"N": n, "sum": [float(r[f"s_{c}"]) for c in cols],
                                    "mean": [float(r[f"s_{c}"]) / n for c in cols], "psi": float(r["psi"])}
    return out


def assign_clusters(df: DataFrame, cols: list[str], centers: list[list[float]],
                    out_col: str = "Cluster") -> DataFrame:
    """M7: nearest centre (squared Euclidean), ties to the lower index; the
    centres are <= 8 literals, so this is a projection, not a join."""
    d = [_sq_dist(cols, c) for c in centers]
    best = F.lit(0)
    best_d = d[0]
    for i in range(1, len(d)):
        best = F.when(d[i] < best_d, F.lit(i)).otherwise(best)
        best_d = F.least(best_d, d[i])
    return df.withColumn(out_col, best.cast("int"))


def inertia(df: DataFrame, cols: list[str], cluster_col: str = "Cluster",
            sums: dict | None = None) -> float:
    """M8: sum of squared distances to the own cluster mean."""
    sums = sums or cluster_sums(df, cols, cluster_col)
    # sum ||x - mu||^2 = psi - N ||mu||^2 per cluster (no second pass)
    return float(sum(s["psi"] - s["N"] * sum(m * m for m in s["mean"]) for s in sums.values()))


def silhouette_rows(df: DataFrame, cols: list[str], cluster_col: str = "Cluster",
                    sums: dict | None = None, out_col: str = SILHOUETTE) -> DataFrame:
    """Per-row squared-Euclidean silhouette.

    Mean squared distance from x to cluster C = |x|^2 + psi_C/N_C - 2 x.Y_C/N_C;
    for the own cluster it is rescaled by N/(N-1) to leave x itself out. A
    row alone in its cluster scores 0.
    """
    sums = sums or cluster_sums(df, cols, cluster_col)
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])
    mean_d = {}
    for cid, s in sums.items():
        dot = reduce(lambda a, b: a + b, [F.col(c) * F.lit(v) for c, v in zip(cols, s["sum"])])
        mean_d[cid] = norm + F.lit(s["psi"] / s["N"]) - 2 * dot / F.lit(float(s["N"]))
    own_n = F.lit(None).cast("long")
    a = F.lit(None).cast("double")
    for cid, s in sums.items():
        is_c = F.col(cluster_col) == F.lit(cid)
        own_n = F.when(is_c, F.lit(s["N"])).otherwise(own_n)
        scale = s["N"] / (s["N"] - 1) if s["N"] > 1 else 0.0
        a = F.when(is_c, mean_d[cid] * F.lit(scale)).otherwise(a)
    b = F.least(*[F.when(F.col(cluster_col) != F.lit(cid), mean_d[cid]) for cid in sums]) \
        if len(sums) > 1 else F.lit(None).cast("double")
    sil = (F.when(own_n <= 1, F.lit(0.0))
           .when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(F.lit(0.0)))
    return df.withColumn(out_col, sil)


def calinski_harabasz(sums: dict, n_features: int | None = None) -> float:
    """(B / (k-1)) / (W / (n-k)) from the per-cluster sums."""
    k = len(sums)
    n = sum(s["N"] for s in sums.values())
    dim = len(next(iter(sums.values()))["sum"])
    mu = [sum(s["sum"][i] for s in sums.values()) / n for i in range(dim)]
    between = sum(s["N"] * sum((s["mean"][i] - mu[i]) ** 2 for i in range(dim)) for s in sums.values())
    within = sum(s["psi"] - s["N"] * sum(m * m for m in s["mean"]) for s in sums.values())
    if k < 2 or within == 0:
        return 1.0 if within == 0 else float("nan")
    return float(between * (n - k) / (within * (k - 1)))


def squared_limit(euclidean: float) -> float:
    """The limit on the squared form that a limit on the Euclidean silhouette
    1 - a / b becomes for a row whose distances within a cluster are about equal:
    1 - (a / b)^2."""
    return 1 - (1 - euclidean) ** 2


def fit_verdict(value: float, warn: float | None = None, good: float | None = None) -> str | None:
    """Below ``warn`` a warning, from ``good`` on good, else ok. The known limits
    (``dims.SIL_WARN``, ``dims.SIL_GOOD``) hold for the Euclidean silhouette; without limits
    for the value at hand there is no verdict."""
    if warn is None or good is None:
        return None
    return "warning" if value < warn else "good" if value >= good else "ok"


def _db_from_spread(sums: dict, spread: dict) -> float:
    """Davies-Bouldin from per-cluster centres and spreads (k <= 8 values).
    Coincident centres count as infinitely far apart (ratio 0); the score is 0
    when every spread or every centre distance is 0."""
    ids = sorted(sums)
    if len(ids) < 2:
        return float("nan")
    dist = {(i, j): sum((a - b) ** 2 for a, b in zip(sums[i]["mean"], sums[j]["mean"])) ** 0.5
            for i in ids for j in ids if i != j}
    if all(abs(spread[i]) < 1e-12 for i in ids) or all(d < 1e-12 for d in dist.values()):
        return 0.0
    worst = [max((spread[i] + spread[j]) / dist[(i, j)] if dist[(i, j)] > 0 else 0.0
                 for j in ids if j != i) for i in ids]
    return float(sum(worst) / len(worst))


def quality_metrics(df: DataFrame, cols: list[str], cluster_col: str = "Cluster") -> dict:
    """M8-M12 in two passes over the rows: per-cluster sums (k rows), then one
    aggregate per cluster holding the silhouette sum, the negative count and
    the mean distance to the own centre. Inertia, silhouette (squared
    Euclidean), Calinski-Harabasz and Davies-Bouldin follow from k rows."""
    sums = cluster_sums(df, cols, cluster_col)
    dist = None
    for cid, s_ in sums.items():
        term = F.when(F.col(cluster_col) == F.lit(cid), F.sqrt(_sq_dist(cols, s_["mean"])))
        dist = term if dist is None else F.coalesce(dist, term)
    rows = (silhouette_rows(df, cols, cluster_col, sums)
            .groupBy(cluster_col)
            .agg(F.sum(SILHOUETTE).alias("sil_sum"), F.count_if(F.col(SILHOUETTE) < 0).alias("neg"),
                 F.avg(dist).alias("spread"), F.count(F.lit(1)).alias("n"))
            .collect())
    n = sum(int(r["n"]) for r in rows)
    spread = {int(r[cluster_col]): float(r["spread"]) for r in rows}
    return {"k": len(sums), "inertia": inertia(df, cols, cluster_col, sums),
            SILHOUETTE: float(sum(float(r["sil_sum"]) for r in rows) / n) if n else float("nan"),
            "n_negative": int(sum(int(r["neg"]) for r in rows)),
            "calinski_harabasz": calinski_harabasz(sums),
            "davies_bouldin": _db_from_spread(sums, spread)}
