"""Cutting long lineages so that a lost executor never replays a whole iterative job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def local_folder(master: str, prefix: str) -> str:
    """A temporary folder for a local master; elsewhere executors could not see it."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none, which is the case
    in local tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or local_folder(sc.master, "tablewright-checkpoint-"))
    return df.checkpoint(eager=eager)
