"""Score transaction files as they land in a folder (M17 as a stream).

Each micro-batch holds whole files (``maxFilesPerTrigger``) and is scored on
its own, exactly like one uploaded file: cleaned, RFM relative to that
batch's last purchase, transformed with the saved knots, assigned with the
saved centres. Output goes to ``{out}/batch_id={n}`` with overwrite, so a
batch replayed after a failure rewrites the same folder (idempotent sink);
the streaming checkpoint records which files were done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rfmlens.plans.score import score
from rfmlens.plans.train import SegmentModel
from rfmlens.sources.readers import csv_options, missing_to_null


def score_arriving_files(spark: SparkSession, in_dir: str, model: SegmentModel, out_dir: str,
                         checkpoint_location: str, columns: list[str] | None = None,
                         files_per_batch: int = 1, available_now: bool = True, fmt: str = "csv"):
    """Start the stream and return the ``StreamingQuery``.

    ``columns`` names the CSV header (read with the batch reader's dialect and
    missing-value tokens); when omitted it is taken from the files already present.
    """
    if fmt == "csv":
        if columns is None:
            columns = csv_options(spark.read).csv(in_dir).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        stream = csv_options(spark.readStream.schema(schema)).option("maxFilesPerTrigger", files_per_batch)
        reader = missing_to_null(stream.csv(in_dir))
    else:
        schema = spark.read.format(fmt).load(in_dir).schema
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch) \
            .format(fmt).load(in_dir)

    def _score_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        scored, _ = score(batch, model, refit_pca=False)
        (scored.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    writer = reader.writeStream.foreachBatch(_score_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
