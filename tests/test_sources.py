import numpy as np
import pytest
from pyspark.sql import functions as F

from binsieve.functions.binning import Sigbits
from binsieve.operators.index import Index
from binsieve.sources import datasets
from binsieve.sources.database import Database, DatasetMeta, Variable
from binsieve.streaming.append import append_index


def test_memory_and_raw(spark, tmp_path):
    with pytest.raises(ValueError):
        datasets.in_memory(spark, [1, 2, 3], [2, 2])
    assert datasets.in_memory(spark, [5, 6], [2]).count() == 2
    for kind, code in (("float64", "<f8"), ("int16", "<i2"), ("uint64", "<u8"), ("uint8", "u1")):
        values = np.arange(1000).astype(code)
        path = str(tmp_path / kind)
        values.tofile(path)
        rows = datasets.raw_file(spark, path, kind, [10, 100]).orderBy("rid").collect()
        assert [r.rid for r in rows] == list(range(1000)) and [float(r.value) for r in rows] == values.astype(float).tolist()
    with pytest.raises(ValueError):
        datasets.raw_file(spark, path, "uint8", [1001])


def test_subsets(spark):
    df = spark.range(60).withColumnRenamed("id", "rid")
    got = sorted(r.rid for r in df.where(datasets.subvolume(F.col("rid"), [3, 4, 5], [1, 1, 2], [2, 2, 2])).collect())
    assert got == [z * 20 + y * 5 + x for z in (1, 2) for y in (1, 2) for x in (2, 3)]
    assert df.where(datasets.linear_ranges(F.col("rid"), [(0, 2), (58, 10)])).count() == 4
    assert df.where(datasets.linear_ranges(F.col("rid"), [])).count() == 0
    with pytest.raises(ValueError):
        datasets.subvolume(F.col("rid"), [3, 4], [2, 0], [2, 1])
    chunks = {r.rid: r.c for r in df.select("rid", datasets.chunk_of(F.col("rid"), [3, 4, 5], [2, 2, 5]).alias("c")).collect()}
    assert chunks[0] == 0 and chunks[40] == 1 and chunks[10] == 2 and chunks[59] == 3


def test_catalog_round_trip(spark, tmp_path):
    made = Database([Variable("bob", "m", "i"), Variable("fred", None, "i2"), Variable("otto", "m3")])
    path = str(tmp_path / "db")
    made.save(path)
    assert Database.load(path).variables == made.variables
    assert Database.parse("# note\n\nx.metafile = a\nx.indexfile=b\n").get("x") == Variable("x", "a", "b")
    with pytest.raises(ValueError):
        Database.parse("x.color=red")
    data, meta = str(tmp_path / "d.raw"), str(tmp_path / "d.meta")
    np.arange(6, dtype="<i4").tofile(data)
    told = DatasetMeta("raw", data, "int32", [2, 3])
    with open(meta, "w") as f:
        f.write(told.text())
    assert DatasetMeta.parse(told.text()) == told
    assert Variable("x", meta).open_data(spark).count() == 6
    with pytest.raises(NotImplementedError):
        DatasetMeta.parse("hdf5 x\n/y")


def test_streaming_append(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(0, 30, 1, 1).select(F.col("id").alias("rid"), (F.col("id") % 7).cast("int").alias("v"))
    df.where("rid < 20").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(source)
        append_index(stream, out, "v", "rid", Sigbits(32, "int32"), 10, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        df.where("rid >= 20").write.mode("append").parquet(source)
    index = Index.load(spark, out)
    assert sorted((r.part_id, r.domain_size) for r in index.parts.collect()) == [(0, 10), (1, 10), (2, 10)]


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as Made

    from binsieve.sources.scratch import scratch_root

    none = Made(isDefined=lambda: False)
    of = lambda master, folder=None: Made(sparkContext=Made(master=master, applicationId="app-1", getConf=lambda: {"spark.checkpoint.dir": folder} if folder else {}, _jsc=Made(sc=lambda: Made(getCheckpointDir=lambda: none))), conf=Made(get=lambda k, d=None: d))
    assert scratch_root(of("spark://host:1", "s3://bucket/shared/")) == "s3://bucket/shared"
    assert scratch_root(of("local[2]")) == scratch_root(of("local[2]"))
    for master in ("spark://host:1", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch_root(of(master))
