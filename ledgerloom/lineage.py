"""Where tables are written to cut their lineage: the folder that the cluster names, so that no lost executor takes work along."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of the warehouse, which is shared too, or in local mode a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            own = tempfile.mkdtemp(prefix="checkpoints-") if sc.master.startswith("local[") or sc.master == "local" else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder; what builds on it plans from there."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()
