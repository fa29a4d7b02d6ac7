"""Where written intermediates go: the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: The temporary folder of each application with a local master.
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, as the cluster names it, or the checkpoint folder set on the context.

    Only with a local master, where all is one process, is one chosen here; a cluster without a named
    folder is an error, since its executors may share none.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="binsieve-")
    return _LOCAL[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
