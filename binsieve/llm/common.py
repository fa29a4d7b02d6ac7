"""Helpers shared by the text operators: shared storage, Arrow batches, null-safe texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from binsieve.sources.scratch import scratch_path

#: Characters of text that one vectorised step works on; longer single texts form a step of their own.
STEP_CHARS = 1 << 20
#: Bytes of text that become Python objects at once.
SLICE_BYTES = 1 << 22


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Cuts the lineage: what follows re-reads the table after an executor is lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch | pa.Table, column: str) -> list[str]:
    """A text column as strings, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` characters each, at least one row."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about ``most`` bytes of a text or binary column, at least one row.

    Arrow batches hold so many rows, however long their texts are; Python objects are made of one slice at a time.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def unused_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names with underscores before them, as many as it takes to differ from all taken ones."""
    prefix, lower = "_", {x.lower() for x in taken}
    while any(prefix + x in lower for x in names):
        prefix += "_"
    return [prefix + x for x in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
