"""Sources of one-variable data: rows in memory, raw binary files, and subsets of a grid."""

from __future__ import annotations

import math
import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binsieve.functions.bits import coordinates
from binsieve.functions.types import column_type

#: Values in a block of a raw file.
BLOCK = 1 << 16


def in_memory(spark: SparkSession, values: list, dims: list[int] | None = None, kind: str = "int32", var: str = "value") -> DataFrame:
    """(rid, var) of a list; its length has to be the grid's."""
    if dims is not None and math.prod(dims) != len(values):
        raise ValueError(f"{len(values)} values on a grid of {math.prod(dims)}")
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField(var, column_type(kind).spark)])
    return spark.createDataFrame(list(enumerate(values)), schema)


def raw_file(spark: SparkSession, path: str, kind: str, dims: list[int], var: str = "value", big_endian: bool = False) -> DataFrame:
    """(rid, var) of a headerless binary array, read in blocks through Spark's file systems.

    The reader of fixed-length records splits a file among tasks; a record here is a block of as many
    values as divide the file evenly, up to ``BLOCK``, and Arrow batches turn blocks into rows.
    Shorter files than the grid are an error.
    """
    own = column_type(kind)
    if own.numpy is None:
        raise TypeError("raw files hold numbers")
    n, width = math.prod(dims), own.bits // 8
    size = spark.read.format("binaryFile").load(path).select("length").first()["length"]
    if size < n * width:
        raise ValueError(f"{posixpath.basename(path)} holds {size} bytes; the grid has {n * width}")
    if size % width:
        raise ValueError(f"{posixpath.basename(path)} ends within a value")
    values = size // width
    block = next(k for k in range(min(BLOCK, max(values, 1)), 0, -1) if values % k == 0)
    dtype = np.dtype((">" if big_endian else "<") + own.numpy)
    plain = {"u1": "int16", "u2": "int32", "u4": "int64", "u8": "uint64"}.get(own.numpy, dtype.newbyteorder("=").str)

    def rows(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                found = pa.array(np.frombuffer(data, dtype).astype(plain))
                if own.numpy == "u8":
                    found = found.cast(pa.decimal128(20, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number * block, number * block + len(found))), found], names=["rid", var])

    records = spark.sparkContext.binaryRecords(path, width * block).zipWithIndex().map(lambda r: (r[1], bytes(r[0])))
    blocks = spark.createDataFrame(records, "block bigint, data binary")
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField(var, own.spark)])
    return blocks.mapInArrow(rows, schema).where(F.col("rid") < n)


def linear_ranges(rid: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a record is in one of the (offset, length) ranges; pushed down where rid is a stored column."""
    if not ranges:
        return F.lit(False)
    tests = [(rid >= a) & (rid < a + n) for a, n in ranges]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def subvolume(rid: Column, grid: list[int], offsets: list[int], dims: list[int]) -> Column:
    """Whether a record of a row-major grid is in a box."""
    if any(o < 0 or o + d > n for o, d, n in zip(offsets, dims, grid)):
        raise ValueError("the box leaves the grid")
    out = F.lit(True)
    for c, o, d in zip(coordinates(rid, grid), offsets, dims):
        out = out & (c >= o) & (c < o + d)
    # the first dimension bounds the record id itself, which a scan can use
    stride = math.prod(grid[1:])
    return (rid >= offsets[0] * stride) & (rid < (offsets[0] + dims[0]) * stride) & out


def chunk_of(rid: Column, grid: list[int], chunk: list[int]) -> Column:
    """The number of the natural partition a record is in; the first dimension's chunks vary fastest."""
    out, stride = F.lit(0).cast("bigint"), 1
    for c, n, k in zip(coordinates(rid, grid), grid, chunk):
        out = out + F.floor(c / k).cast("bigint") * stride
        stride *= -(-n // k)
    return out


def write_rids(found: DataFrame, path: str) -> None:
    """Record ids as Parquet, in order within each file."""
    found.select(F.col("rid").cast("bigint")).sortWithinPartitions("rid").write.parquet(path)
