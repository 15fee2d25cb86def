"""The folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's ``spark.checkpoint.dir``; only where it is unset, a folder of this machine."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="terracell-"))
