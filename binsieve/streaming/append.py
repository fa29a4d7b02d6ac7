"""Beyond the batch engine: index partitions appended from a stream."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from binsieve.functions.binning import Binning
from binsieve.operators.index import build_index, committed


def append_index(stream: DataFrame, path: str, var: str, rid: str, binning: Binning, part_size: int, checkpoint: str) -> DataStreamWriter:
    """A writer that indexes each micro-batch and appends its partitions to a stored index.

    Micro-batches have to hold whole partitions, as files of ``part_size`` records do. A micro-batch is one
    committed batch of the index, named by its number: one that is run again after a failure, wherever it
    failed, is written once, and readers see all of it or nothing. Partitions that other batches have are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        own = f"stream-{number:012d}"
        made = build_index(batch, var, rid, binning, part_size)
        others = [b for b in committed(spark, path) if not b.endswith(f"/batch-{own}")]
        if others:
            there = spark.read.parquet(*(f"{b}/parts" for b in others)).select("part_id")
            made = replace(made, **{name: getattr(made, name).join(there, "part_id", "left_anti") for name in ("words", "bins", "parts", "present")})
        made.append(path, own)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
