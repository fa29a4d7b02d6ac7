import math
import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binsieve.functions import bits
from binsieve.functions.binning import Cast, Explicit, Precision, Sigbits, binning, rounded
from binsieve.functions.types import TYPES, column_type
from binsieve.operators.column_engine import ColumnEngine
from binsieve.operators.index import build_index
from binsieve.plans.terms import Query


def keys(spark, values, kind, made):
    df = spark.createDataFrame([(v,) for v in values], f"x {column_type(kind).spark.simpleString()}")
    return [r[0] for r in df.select(made.key(F.col("x"))).collect()]


def ordered_keys(spark, values, kind, made):
    df = spark.createDataFrame([(v,) for v in values], f"x {column_type(kind).spark.simpleString()}").select(made.key(F.col("x")).alias("k")).distinct()
    return [r[0] for r in df.orderBy(made.order(F.col("k"))).collect()]


def test_types_by_alias():
    assert column_type("long").name == column_type("INT64").name == "int64"
    assert len({n for t in TYPES for n in (t.name, *t.aliases)}) == sum(1 + len(t.aliases) for t in TYPES)
    with pytest.raises(ValueError):
        column_type("blob")


def test_bin_orders(spark):
    assert ordered_keys(spark, [1, 0, 0, 2], "uint16", Sigbits(16, "uint16")) == [0, 1, 2]
    assert ordered_keys(spark, [1, 0, 0, -1], "int32", Sigbits(32, "int32")) == [0xFFFFFFFF, 0, 1]
    signed = lambda x: struct.unpack("<q", struct.pack("<d", x))[0]
    assert ordered_keys(spark, [1.0, -0.0, 0.0, -1.0], "float64", Sigbits(64, "float64")) == [signed(x) for x in (-1.0, -0.0, 0.0, 1.0)]


def test_uint64_keys(spark):
    from decimal import Decimal

    values = [0, 5, 2**63, 2**64 - 1]
    found = ordered_keys(spark, [Decimal(v) for v in values], "uint64", Sigbits(64, "uint64"))
    assert [k % 2**64 for k in found] == values


def test_sigbits_of_a_sequence(spark):
    assert sorted(set(keys(spark, range(16), "int32", Sigbits(31, "int32")))) == list(range(8))


@pytest.mark.parametrize("kind,code,width", [("float64", "d", 64), ("float32", "f", 32)])
def test_float_bits_are_exact(spark, kind, code, width):
    values = [0.0, -0.0, 1.0, -1.5, math.pi, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, math.inf, -math.inf, 1.7976931348623157e308, 0.1, 2**52 + 1.0, 7.999999999999999, 8.0]
    if kind == "float32":
        values = [struct.unpack("<f", struct.pack("<f", v))[0] for v in values if v in (math.inf, -math.inf) or abs(v) < 3e38] + [1e-45, 1.1754942e-38]
        values = [struct.unpack("<f", struct.pack("<f", v))[0] for v in values]
    want = [struct.unpack("<q" if width == 64 else "<I", struct.pack("<" + code, v))[0] for v in values]
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {column_type(kind).spark.simpleString()}")
    got = [r[1] for r in df.select("i", bits.float_bits(F.col("x"), width)).orderBy("i").collect()]
    assert got == want


@given(st.floats(allow_nan=False), st.integers(1, 64), st.floats(allow_nan=False))
def test_order_follows_values(a, n, b):
    made = Sigbits(n, "float64")
    if a <= b:
        assert made.order_of(a) <= made.order_of(b)


def test_precision(spark):
    for digits, want in ((3, 1.23), (2, 1.2), (1, 1.0)):
        assert keys(spark, [1.234], "float64", Precision(digits)) == [want]
    assert keys(spark, [9.87654321e24], "float64", Precision(3)) == [pytest.approx(9.88e24, rel=1e-12)]
    assert keys(spark, [-1.236, 0.0, 5e-324, math.inf, None], "float64", Precision(3)) == [-1.24, 0.0, 0.0, math.inf, None]
    # 0 digits round as 1 does; only more digits than a double has leave a value alone.
    assert keys(spark, [1.23456, 16.0, -0.27], "float64", Precision(0)) == keys(spark, [1.23456, 16.0, -0.27], "float64", Precision(1))
    assert keys(spark, [1.23456], "float64", Precision(0)) == [1.0] and keys(spark, [1.23456], "float64", Precision(16)) == [1.23456]


@pytest.mark.parametrize("digits", [1, 3, 9, 15])
def test_precision_is_the_librarys(spark, digits):
    draw = random.Random(digits)
    ties = [(draw.randrange(10 ** (digits - 1), 10**digits) + 0.5) * 10.0 ** draw.randint(-20, 20) for _ in range(2000)]
    values = ties + [math.nextafter(v, 0) for v in ties] + [draw.uniform(-1, 1) * 10.0 ** draw.randint(-307, 308) for _ in range(2000)]
    values += [10.0**n for n in range(-307, 309)] + [1.7976931348623157e308, -0.0, math.inf]
    assert keys(spark, values, "float64", Precision(digits)) == [rounded(v, digits) for v in values]


def test_precision_of_constants(spark):
    values = [21.95, -30650.0, 24.45, 1705.0, 7.0, None]
    df, own = spark.createDataFrame(list(enumerate(values)), "rid int, x double"), {"x": Precision(3)}
    for v in values[:-1]:
        engine = ColumnEngine(df, own, "rid")
        assert {r.rid for r in engine.evaluate(Query.range("x", v, v)).collect()} == {i for i, w in enumerate(values) if rounded(w, 3) == rounded(v, 3)}
    assert [tuple(r) for r in ColumnEngine(df, own, "rid").bin_keys("x").collect()] == sorted((rounded(v, 3), 1) for v in values[:-1])
    assert tuple(ColumnEngine(df, own, "rid").bin_keys("x", nulls=True).first()) == (None, 1)
    assert [r[0] for r in build_index(df, "x", "rid", own["x"]).bins.orderBy("bin_no").select("bin_key").collect()] == sorted(rounded(v, 3) for v in values[:-1])


def test_explicit(spark):
    bounds = (1, 2, 3, 4, 5, 8, 10, 20, 40, 60, 80, 100, 120, 140, 160, 180)
    values = list(range(-3, 190))
    want = [max([b for b in bounds if b <= v], default=-(2**31)) for v in values]
    assert keys(spark, values, "int32", Explicit(bounds, "int32")) == want
    assert keys(spark, ["a", "m", "z", None], "string", Explicit(("b", "m"))) == ["", "m", "m", None]


def test_cast_and_registry(spark):
    assert keys(spark, [1.9, -1.9], "float64", Cast("int32", Sigbits(32, "int32"))) == [1, 0xFFFFFFFF]
    assert binning("sigbits", 8, "int32") == Sigbits(8, "int32")
    for bad in (lambda: Sigbits(8, "string"), lambda: binning("precision", 3, "int32"), lambda: Sigbits(32, "int32").constant("x"), lambda: Explicit((1,)).constant("x")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        Sigbits(65, "int64")


@given(st.integers(0, 2**16 - 1), st.integers(1, 3))
def test_dilation_is_undone(x, d):
    wide = sum((x >> i & 1) << (i * d) for i in range(16))
    assert sum((wide >> (i * d) & 1) << i for i in range(16)) == x


def test_dilation_columns_and_z_order(spark):
    df = spark.range(64).select("id", bits.coordinates(F.col("id"), [8, 8])[0].alias("y"), bits.coordinates(F.col("id"), [8, 8])[1].alias("x"))
    rows = df.select("y", "x", bits.morton([F.col("y"), F.col("x")], 3).alias("z"), bits.undilate(bits.dilate(F.col("x"), 2, 3), 2, 3).alias("back"), bits.row_major([F.col("y"), F.col("x")], [8, 8]).alias("rid"), "id").collect()
    for r in rows:
        assert r.back == r.x and r.rid == r.id
        assert r.z == sum((r.x >> i & 1) << 2 * i | (r.y >> i & 1) << 2 * i + 1 for i in range(3))
