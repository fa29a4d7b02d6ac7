"""The indexable column types: names, widths and how their bits are ordered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    name: str
    aliases: tuple[str, ...]
    bits: int
    order: str  # "unsigned", "twos", "magnitude" or "none"
    spark: T.DataType
    numpy: str | None

    @property
    def is_float(self) -> bool:
        return self.order == "magnitude"


TYPES = (
    ColumnType("float32", ("float",), 32, "magnitude", T.FloatType(), "f4"),
    ColumnType("float64", ("double",), 64, "magnitude", T.DoubleType(), "f8"),
    ColumnType("int8", ("char", "tinyint"), 8, "twos", T.ByteType(), "i1"),
    ColumnType("int16", ("short", "smallint"), 16, "twos", T.ShortType(), "i2"),
    ColumnType("int32", ("int",), 32, "twos", T.IntegerType(), "i4"),
    ColumnType("int64", ("long", "bigint"), 64, "twos", T.LongType(), "i8"),
    ColumnType("uint8", ("uchar",), 8, "unsigned", T.ShortType(), "u1"),
    ColumnType("uint16", ("ushort",), 16, "unsigned", T.IntegerType(), "u2"),
    ColumnType("uint32", ("uint",), 32, "unsigned", T.LongType(), "u4"),
    ColumnType("uint64", ("ulong",), 64, "unsigned", T.DecimalType(20, 0), "u8"),
    ColumnType("string", ("char*",), 0, "none", T.StringType(), None),
)
_BY_NAME = {n: t for t in TYPES for n in (t.name, *t.aliases)}


def universal(value, to: str):
    """A constant as one of the four stored types (int64, uint64, double, string), or None where there is no conversion.

    Text and numbers don't convert to each other; integers wrap, fractions are cut towards zero, and what
    no integer of 64 bits can hold (NaN, infinities, greater floats) is None.
    """
    if to not in ("int64", "uint64", "double", "string"):
        raise ValueError(f"no stored type {to!r}")
    if value is None or isinstance(value, str) != (to == "string"):
        return None
    if to in ("string", "double"):
        return value if to == "string" else float(value)
    if isinstance(value, float) and not -(2.0**63) <= value < 2.0**64:
        return None
    whole = int(value) & (1 << 64) - 1
    return whole - (1 << 64) if to == "int64" and whole >> 63 else whole


def column_type(name: str) -> ColumnType:
    """The type of a name or alias, in any case."""
    try:
        return _BY_NAME[name.lower()]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}") from None


def type_of(data_type: T.DataType) -> ColumnType:
    """The indexable type of a Spark column (signed, as Spark has no unsigned types)."""
    return column_type(data_type.simpleString())
