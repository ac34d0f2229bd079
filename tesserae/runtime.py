"""Session-level services shared by all operators: checkpoint folder, lineage cuts, numbers of parts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, gets a folder of its own
    when the setting is missing; a cluster without the setting is an error, because a folder that
    lives on one machine would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tesserae-checkpoint-")
    sc.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable, replicated checkpoint; computed once, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    """Into how many parts to split a join of few bytes and long work, which adaptive execution would put into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
