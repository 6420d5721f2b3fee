"""rfmlens: customer segmentation (RFM + clustering) as Spark DataFrame operators.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects so the
work stays inside Catalyst / Tungsten and scales with the cluster.

    from rfmlens import get_session, read_transactions, clean_transactions, compute_rfm, train, score
"""

from rfmlens.session import checkpoint_dir, get_session

_LAZY = {
    "read_transactions": "rfmlens.sources.readers",
    "clean_transactions": "rfmlens.operators.clean",
    "compute_rfm": "rfmlens.operators.rfm",
    "add_rfm_scores": "rfmlens.operators.scoring",
    "fit_transform": "rfmlens.operators.transform",
    "assign_segment_labels": "rfmlens.operators.labels",
    "train": "rfmlens.plans.train",
    "score": "rfmlens.plans.score",
    "score_upload": "rfmlens.plans.score",
    "save_model": "rfmlens.sources.model_store",
    "load_model": "rfmlens.sources.model_store",
}


def __getattr__(name):
    if name in _LAZY:
        import importlib
        return getattr(importlib.import_module(_LAZY[name]), name)
    raise AttributeError(name)


__all__ = ["get_session", "checkpoint_dir", *_LAZY]
