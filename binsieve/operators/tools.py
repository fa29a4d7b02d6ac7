"""Tools over columns: run statistics, equal-depth bins, dense bin ids, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binsieve.sources.scratch import scratch_path

#: Records in a chunk within which runs are found; neighbouring chunks are then joined by their edges.
CHUNK = 1 << 20


def characterize(df: DataFrame, key: Column, rid: str, offset: int = 0, size: int | None = None) -> DataFrame:
    """Of each bin key: count, runs, density, mean run length and its deviation.

    A run is a maximal stretch of consecutive rows in rid order with one key. Rows are cut into
    chunks of record ids, so that no task sorts more than a chunk; a chunk's first row is compared
    with the last row of the chunk before, which is one row for each chunk.
    """
    own = df.select(F.col(rid).cast("bigint").alias("rid"), key.alias("bin_key")).where(F.col("rid") >= offset)
    if size is not None:
        own = own.where(F.col("rid") < offset + size)
    own = own.withColumn("chunk", F.floor(F.col("rid") / CHUNK))
    within = Window.partitionBy("chunk").orderBy("rid")
    marked = own.withColumn("place", F.row_number().over(within)).withColumn("before", F.lag("bin_key").over(within))
    inner = F.when(F.col("place") == 1, 0).otherwise((~F.col("bin_key").eqNullSafe(F.col("before"))).cast("int"))
    runs = marked.groupBy("bin_key").agg(F.count(F.lit(1)).alias("n"), F.sum(inner).alias("runs"))
    edges = own.groupBy("chunk").agg(F.min_by("bin_key", "rid").alias("first"), F.max_by("bin_key", "rid").alias("last"))
    order = Window.orderBy("chunk")
    fresh = edges.withColumn("before", F.lag("last").over(order)).withColumn("head", F.row_number().over(order) == 1)
    fresh = fresh.where(F.col("head") | ~F.col("first").eqNullSafe(F.col("before"))).groupBy(F.col("first").alias("edge_key")).agg(F.count(F.lit(1)).alias("more"))
    both = runs.join(fresh, F.col("bin_key").eqNullSafe(F.col("edge_key")), "left")
    both = both.select("bin_key", "n", (F.col("runs") + F.coalesce("more", F.lit(0))).alias("runs"))
    total = own.agg(F.count(F.lit(1))).scalar()
    density, mean = F.col("n") / total, F.col("n") / F.col("runs")
    return both.select("bin_key", "n", "runs", density.alias("density"), mean.alias("mean_run"), (mean * (1 - density)).alias("sigma"))


def equi_depth(df: DataFrame, value: str, nbins: int, sample_step: int = 1, rid: str | None = None) -> list:
    """The nbins - 1 inner boundaries at rank quantiles of the distinct values.

    With a ``sample_step`` over 1, the rows whose rid it divides are used. Ranks are those of the
    sorted distinct values, counted range by range, so that nothing but the boundaries is gathered.
    """
    own = df.where(F.col(value).isNotNull())
    if sample_step > 1:
        own = own.where(F.col(rid) % sample_step == 0)
    ranked, total = ranks(own.select(F.col(value).alias("v")), "v")
    wanted = sorted({k * total // nbins for k in range(1, nbins)} - {0})
    return [r["v"] for r in ranked.where((F.col("rank") + 1).isin(wanted)).orderBy("rank").collect()] if wanted else []


def ranks(df: DataFrame, value: str, order: Column | None = None) -> tuple[DataFrame, int]:
    """(value, rank) of the distinct values, ranked from 0, and how many there are.

    Distinct values are dealt to ranges and written, so that both passes see the same ranges; a rank
    is that within its range and the sizes of the ranges before, of which the driver sees one number each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    by = F.col(value) if order is None else order
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct().withColumn("by", by)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.repartitionByRange(n, "by").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    before, at = [0] * n, 0
    for r in held.groupBy("part").count().orderBy("part").collect():
        before[r["part"]], at = at, at + r["count"]
    base = F.get(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col("part"))
    return held.select(value, (F.row_number().over(Window.partitionBy("part").orderBy("by")) - 1 + base).alias("rank")), at


def equi_depth_bin(value: Column, boundaries: list) -> Column:
    """The number of the (previous, boundary] interval a value is in; the last one is open."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(boundaries[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return F.when(value.isNotNull(), tree(0, len(boundaries)))


def dense_ids(df: DataFrame, key: str, order: Column | None = None, to: str = "bin_id") -> DataFrame:
    """Add the rank of each row's key among the distinct keys, from 0.

    Only distinct keys are ranked; they are joined back by key.
    """
    ranked, _ = ranks(df.select(F.col(key).alias("_key")), "_key", order)
    return df.join(ranked.withColumnRenamed("rank", to), F.col(key) == F.col("_key"), "left").drop("_key")


def pivot_first(df: DataFrame, rows: list[str], column: str, body: str, order: str) -> DataFrame:
    """A table of the first body value (by ``order``) of each row and column key, as strings."""
    first = F.min_by(F.col(body).cast("string"), F.col(order))
    cells = df.groupBy(*[F.col(r).cast("string").alias(r) for r in rows], F.col(column).cast("string").alias("_column")).agg(first.alias("_body"))
    return cells.groupBy(*rows).pivot("_column").agg(F.first("_body"))
