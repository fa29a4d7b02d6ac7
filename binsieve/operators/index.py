"""Binned indexes: built by partition, encoded, stored as Parquet, and read region by region."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binsieve.functions.binning import Binning, from_told
from binsieve.operators import regions
from binsieve.plans.encoding import ENCODINGS

PART = ("part_id",)


@dataclass(frozen=True)
class Index:
    """``words``: (part_id, region_id, word_idx, word); ``bins``: (part_id, bin_no, bin_key, order, n); ``parts``: (part_id, domain_offset, domain_size, nbins); ``present``: the words of all records that are in a bin."""

    var: str
    encoding: str
    words: DataFrame
    bins: DataFrame
    parts: DataFrame
    present: DataFrame
    binning: Binning | None = None
    #: (part_id, region_id, bytes) where it is stored, and whether this index is.
    known_sizes: DataFrame | None = None
    stored: bool = False

    @property
    def sizes(self) -> DataFrame:
        """(part_id, region_id, bytes) of every region: read where the index is stored, else added up."""
        return self.region_bytes() if self.known_sizes is None else self.known_sizes

    def encode(self, encoding: str) -> Index:
        """The same bins in another encoding; the source has to be an equality index."""
        if self.encoding != "equality":
            raise ValueError("only an equality index can be encoded")
        made = ENCODINGS[encoding]
        n = self.parts.select("part_id", F.col("nbins").cast("int").alias("n"))
        bins = self.bins.select("part_id", F.col("bin_no").cast("int").alias("b")).join(n, "part_id")
        into = bins.select("part_id", F.col("b").alias("region_id"), F.explode(made.members(F.col("n"), F.col("b"))).alias("to"))
        words = self.words.join(into, ["part_id", "region_id"]).groupBy("part_id", F.col("to").cast("int").alias("region_id"), "word_idx").agg(F.bit_or("word").alias("word"))
        return replace(self, encoding=made.name, words=words, known_sizes=None, stored=False)

    def regions(self, ids: list[int], parts: list[int] | None = None) -> DataFrame:
        """Words of some regions; both filters reach the Parquet scan."""
        found = self.words.where(F.col("region_id").isin(*map(int, ids)))
        return found if parts is None else found.where(F.col("part_id").isin(*map(int, parts)))

    def partition(self, part_id: int) -> Index:
        own = F.col("part_id") == part_id
        sizes = None if self.known_sizes is None else self.known_sizes.where(own)
        return replace(self, words=self.words.where(own), bins=self.bins.where(own), parts=self.parts.where(own), present=self.present.where(own), known_sizes=sizes)

    def partition_at(self, offset: int) -> DataFrame:
        """The partition whose domain begins at an offset: one row or none."""
        return self.parts.where(F.col("domain_offset") == offset).select("part_id")

    def region_bytes(self) -> DataFrame:
        return self.words.groupBy("part_id", "region_id").agg((F.count(F.lit(1)) * 8).alias("bytes"))

    def size(self, lower: int, upper: int) -> DataFrame:
        """Bytes of regions lower <= id < upper, by partition."""
        if lower > upper:
            raise ValueError("the lower region id is above the upper one")
        own = self.words.where((F.col("region_id") >= lower) & (F.col("region_id") < upper))
        return self.parts.select("part_id").join(own.groupBy("part_id").agg((F.count(F.lit(1)) * 8).alias("bytes")), "part_id", "left").select("part_id", F.coalesce("bytes", F.lit(0)).alias("bytes"))

    def info(self, details: bool = False) -> DataFrame:
        """A row for each partition: domain, encoding, bins and bytes, and with ``details`` the binning and the bin keys in order."""
        stored = self.sizes.groupBy("part_id").agg(F.count(F.lit(1)).alias("nregions"), F.sum("bytes").alias("bytes"))
        rows = self.parts.join(stored, "part_id", "left")
        extra = []
        if details:
            listed = self.bins.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("bin_no", "bin_key"))).alias("bins"))
            told = F.lit(None if self.binning is None else str(self.binning)).cast("string")
            rows, extra = rows.join(listed, "part_id", "left"), [told.alias("binning"), F.col("bins.bin_key").alias("bin_keys")]
        return rows.select(F.lit(self.var).alias("var"), F.lit(self.encoding).alias("encoding"), "part_id", "domain_offset", "domain_size", "nbins", F.coalesce("nregions", F.lit(0)).alias("nregions"), F.coalesce("bytes", F.lit(0)).alias("bytes"), *extra)

    def domains(self) -> DataFrame:
        """Partitions in order of domain offset with their rank."""
        return self.parts.select("part_id", "domain_offset", "domain_size", (F.row_number().over(Window.orderBy("domain_offset")) - 1).alias("domain_id"))

    def save(self, path: str, mode: str = "errorifexists", batch: str | None = None) -> bool:
        """Write the index as one batch of partitions: a folder that counts only once all of it is there.

        Words stand by partition, sorted by region so that row groups can be skipped. ``append`` adds a batch;
        with a name, a batch that is committed already is left alone, and what a failure left of one is
        written anew. Tells whether anything was written.
        """
        spark = self.words.sparkSession
        fs, folder = _files(spark, path)
        if mode == "overwrite":
            fs.delete(folder(path), True)
        elif mode == "errorifexists" and committed(spark, path):
            raise FileExistsError(path)
        elif mode not in ("append", "errorifexists"):
            raise ValueError(f"unknown mode {mode!r}")
        own = f"{path}/batch-{batch or uuid.uuid4().hex}"
        if fs.exists(folder(f"{own}/{COMMIT}")):
            return False
        fs.delete(folder(own), True)
        meta = {"var": self.var, "encoding": self.encoding, "binning": None if self.binning is None else self.binning.told()}
        tables = {"bins": self.bins, "present": self.present, "parts": self.parts.withColumn("meta", F.lit(json.dumps(meta)))}

        def words_and_sizes() -> None:
            self.words.repartition("part_id", F.floor(F.col("word_idx") / (1 << 20))).sortWithinPartitions("part_id", "region_id", "word_idx").write.parquet(f"{own}/words")
            spark.read.parquet(f"{own}/words").groupBy("part_id", "region_id").agg((F.count(F.lit(1)) * 8).alias("bytes")).write.parquet(f"{own}/sizes")

        # The tables don't need each other, so their jobs run together; one that fails leaves the batch without its commit.
        writes = [words_and_sizes, *(partial(df.write.parquet, f"{own}/{name}") for name, df in tables.items())]
        with ThreadPoolExecutor(len(writes)) as pool:
            for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]:
                done.result()
        fs.create(folder(f"{own}/{COMMIT}"), True).close()
        return True

    def append(self, path: str, batch: str | None = None) -> bool:
        return self.save(path, "append", batch)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """An index of all committed batches, with the binning it was built with; batches that differ in it are an error."""
        batches = committed(spark, path)
        if not batches:
            raise FileNotFoundError(f"no index in {path}")
        read = lambda name: spark.read.parquet(*(f"{b}/{name}" for b in batches))
        parts = read("parts")
        told = [r["meta"] for r in parts.select("meta").distinct().limit(2).collect()]
        if len(told) != 1:
            raise ValueError(f"batches of {path} are not of one index")
        meta = json.loads(told[0])
        binning = None if meta["binning"] is None else from_told(meta["binning"])
        return Index(meta["var"], meta["encoding"], read("words"), read("bins"), parts.drop("meta"), read("present"), binning, read("sizes"), True)


#: The file whose presence says that a batch is whole.
COMMIT = "_COMMITTED"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function to its paths."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path
    return folder(path).getFileSystem(context._jsc.hadoopConfiguration()), folder


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of an index's whole batches, in order of name."""
    fs, folder = _files(spark, path)
    found = fs.globStatus(folder(f"{path}/batch-*/{COMMIT}"))
    return sorted(x.getPath().getParent().toString() for x in found or [])


def build_index(df: DataFrame, var: str, rid: str, binning: Binning, part_size: int | None = None, offset: int = 0, size: int | None = None, relative: bool = True) -> Index:
    """An equality index of one column, by partitions of ``part_size`` records, each with bins of its own.

    ``offset`` and ``size`` choose a range of records; with ``relative`` record ids count from it.
    Rows with a null are in no bin; record ids have to be distinct. Two aggregations, both combined before their shuffle.
    """
    own = df.select((F.col(rid).cast("bigint") - (offset if relative else 0)).alias("rid"), F.col(var).alias("value"), F.col(rid).cast("bigint").alias("at")).where(F.col("at") >= offset)
    if size is not None:
        own = own.where(F.col("at") < offset + size)
    start = 0 if relative else offset
    step = part_size or (1 << 62)
    part = F.floor((F.col("rid") - start) / step).cast("bigint")
    own = own.withColumn("part_id", part).withColumn("local", F.col("rid") - start - F.col("part_id") * step).withColumn("bin_key", binning.key(F.col("value")))
    # One aggregation by (partition, key) tells the bins, and added up by partition the domains: count() passes over the null key.
    keys = own.groupBy("part_id", "bin_key").agg(F.count(F.lit(1)).alias("n"), F.max("local").alias("last"))
    sizes = keys.groupBy("part_id").agg((F.max("last") + 1).alias("domain_size"), F.count("bin_key").cast("int").alias("nbins"))
    parts = sizes.select("part_id", (F.lit(start) + F.col("part_id") * step).alias("domain_offset"), "domain_size", "nbins")
    filled = own.where("bin_key is not null")
    counts = keys.where("bin_key is not null").select("part_id", "bin_key", "n", binning.order(F.col("bin_key")).alias("order"))
    bins = counts.withColumn("bin_no", (F.row_number().over(Window.partitionBy("part_id").orderBy("order")) - 1).cast("int"))
    keyed = regions.words(filled, "local", "bin_key", PART).withColumnRenamed("region_id", "bin_key")
    words = keyed.join(bins.select("part_id", "bin_key", "bin_no"), ["part_id", "bin_key"]).select("part_id", F.col("bin_no").alias("region_id"), "word_idx", "word")
    present = keyed.groupBy("part_id", "word_idx").agg(F.bit_or("word").alias("word"))
    return Index(var, "equality", words, bins.select("part_id", "bin_no", "bin_key", "order", "n"), parts, present, binning)
