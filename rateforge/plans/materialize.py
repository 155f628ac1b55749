"""Cutting lineage before a result is used more than once."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names in
    ``spark.checkpoint.dir``.  Only a local session may leave it unset and gets a
    temporary one; machines of a cluster would not share such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="rateforge-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``, so later steps do not recompute it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again: unlike a checkpoint it
    keeps column pruning and pushed filters for its readers."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to: Spark removes them when the
    driver collects garbage.  The last plan is held until another one runs."""
    spark.range(1, numPartitions=1).count()
    gc.collect()
    spark._jvm.System.gc()
