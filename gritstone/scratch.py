"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, written to spark.checkpoint.dir and read from there: it outlives any executor. Where that is unset, a local session uses a
    temporary folder of its own; any other is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gritstone-"))
    return df.checkpoint()
