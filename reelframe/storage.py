"""What is computed once and kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df computed once, kept in spark.checkpoint.dir; on one machine, in a new folder where that is unset.

    Rows that an operator goes over several times are kept before, and the loss of an executor then costs no more than
    reading them again.  A folder of one machine is an error on a cluster.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelframe-"))
    return df.checkpoint()
