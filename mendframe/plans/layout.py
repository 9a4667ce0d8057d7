"""How rows are laid out over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores.  The kernels are
    bound by CPU, not by input: a small file that is read as one split would run
    on one core.  Inputs with enough splits are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
