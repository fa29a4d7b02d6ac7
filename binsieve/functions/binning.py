"""Quantization: from values to bin keys, and from keys to an order.

A binning gives a ``key`` column (what is stored and shown) and an ``order`` column of it (a number
that sorts as the keys do); ``bound`` turns a query's bound into the order of its key.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsieve.functions.bits import MAX_LONG, MIN_LONG, float_bits
from binsieve.functions.types import ColumnType, column_type


class Binning:
    """Base of the binnings; registries of further ones need only these three methods."""

    def key(self, value: Column) -> Column:
        raise NotImplementedError

    def order(self, key: Column) -> Column:
        """A column that sorts as keys do."""
        return key

    def bound(self, value):
        """The order of a constant's key, as a column."""
        return self.order(self.key(self.constant(value)))

    def constant(self, value) -> Column:
        return F.lit(value)

    def counts(self, df: DataFrame, value: Column) -> DataFrame:
        """(bin_key, n): the keys of a table's rows and how many have each."""
        return df.groupBy(self.key(value).alias("bin_key")).agg(F.count(F.lit(1)).alias("n"))

    def told(self) -> dict:
        """What ``from_told`` makes the same binning of; plain enough for JSON."""
        raise NotImplementedError

    def upper_values(self, column: Column, value) -> Column | None:
        """What ``key <= bound(value)`` says about the column itself, in a form that scans can use, if anything."""
        return None


@dataclass(frozen=True)
class Sigbits(Binning):
    """The ``n`` most significant bits of a value's representation."""

    n: int
    kind: ColumnType

    def __init__(self, n: int, kind: str | ColumnType):
        kind = column_type(kind) if isinstance(kind, str) else kind
        if kind.order == "none":
            raise TypeError("strings have no significant bits; use explicit bins")
        if not 1 <= n <= kind.bits:
            raise ValueError(f"{n} significant bits of a {kind.bits}-bit type")
        object.__setattr__(self, "n", n)
        object.__setattr__(self, "kind", kind)

    def key(self, value: Column) -> Column:
        w = self.kind.bits
        if self.kind.is_float:
            word = float_bits(value, w)
        elif self.kind.name == "uint64":  # a decimal: its upper half becomes negative longs
            word = F.when(value >= F.lit(str(1 << 63)).cast("decimal(20,0)"), (value - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("bigint")).otherwise(value.cast("bigint"))
        else:
            word = value.cast("bigint").bitwiseAND(F.lit(-1 if w == 64 else (1 << w) - 1).cast("bigint"))
        return F.shiftrightunsigned(word, w - self.n) if self.n < w else word

    def order(self, key: Column) -> Column:
        n, sign = self.n, self.kind.order
        if sign == "unsigned":
            return key.bitwiseXOR(F.lit(MIN_LONG).cast("bigint")) if n == 64 else key
        if sign == "twos":
            return key if n == 64 else F.shiftright(F.shiftleft(key, 64 - n), 64 - n)
        magnitude = key.bitwiseAND(F.lit(MAX_LONG if n == 64 else (1 << (n - 1)) - 1).cast("bigint"))
        negative = key < 0 if n == 64 else F.getbit(key, F.lit(n - 1)) == 1
        return F.when(negative, F.bitwise_not(magnitude)).otherwise(key)

    def min_key(self) -> int:
        """The first key in order: that of the least value, or of the negative ones farthest from zero."""
        return self._signed({"unsigned": 0, "twos": 1 << (self.n - 1), "magnitude": (1 << self.n) - 1}[self.kind.order])

    def max_key(self) -> int:
        """The last key in order: all bits set, but for the sign of types that have one."""
        return self._signed((1 << (self.n if self.kind.order == "unsigned" else self.n - 1)) - 1)

    @staticmethod
    def _signed(key: int) -> int:
        """A key of 64 bits as the long that holds it."""
        return key - (1 << 64) if key >> 63 else key

    def constant(self, value) -> Column:
        if isinstance(value, str):
            raise TypeError("a string bound on a numeric column")
        if not self.kind.is_float:
            low, high = (0, 2**self.kind.bits - 1) if self.kind.order == "unsigned" else (-(2 ** (self.kind.bits - 1)), 2 ** (self.kind.bits - 1) - 1)
            if isinstance(value, float) and math.isfinite(value):
                value = math.floor(value)
            value = int(min(max(value, low), high))
        return F.lit(str(value) if self.kind.name == "uint64" else value).cast(self.kind.spark)

    def order_of(self, value) -> int:
        """The order of a constant, worked out here; for planning without a session."""
        w, n = self.kind.bits, self.n
        word = struct.unpack(f"<{'Q' if w == 64 else 'I'}", struct.pack(f"<{'d' if w == 64 else 'f'}", value))[0] if self.kind.is_float else int(value) & (1 << w) - 1
        key = word >> (w - n)
        if self.kind.order == "unsigned" or not key >> (n - 1):
            return key if not (self.kind.order == "unsigned" and n == 64) else key - (1 << 63)
        return key - (1 << n) if self.kind.order == "twos" else ~(key & (1 << (n - 1)) - 1)

    def told(self) -> dict:
        return {"kind": "sigbits", "n": self.n, "type": self.kind.name}


def rounded(value: float | None, digits: int) -> float | None:
    """A value to ``digits`` significant decimal digits, by the C library's logarithm and power.

    Whether a value halfway between two keys goes up or down depends on the last bits of both functions: those of
    the C library are the reference's and DuckDB's, and those of the JVM are others.
    """
    if value is None or digits > 15 or not 0 < abs(value) < math.inf:
        return value
    if abs(value) < 2.0**-1022:
        return math.copysign(0.0, value)
    power = lambda n: math.pow(10.0, n) if n <= 308 else math.inf
    log = math.log10(abs(value))
    shift = math.floor(log) - (max(1, digits) - 1)
    whole = float(math.floor(0.5 + math.pow(10.0, log - shift)))
    return math.copysign(whole * power(shift) if shift > 0 else whole / power(-shift), value)


@dataclass(frozen=True)
class Precision(Binning):
    """Round to ``digits`` significant decimal digits, half up; 0 digits round as 1 does, over 15 leave the value alone.

    "Half" is as ``rounded`` has it. Built-in functions give the key of all values but those so near to a half, to a power
    of ten or to the ends of the range that the last bits of a logarithm or a power count; an Arrow function rounds these.
    """

    digits: int

    def _split(self, value: Column) -> tuple[Column, Column]:
        """The key where built-in functions can tell it, else null, and the value where they can't, else null."""
        value = value.cast("double")
        x = F.abs(value)
        usual = (x >= 2.0**-1022) & (x < float("inf"))
        log = F.log10(F.when(usual, x).otherwise(F.lit(2.0)))
        shift = F.floor(log) - (max(1, self.digits) - 1)
        exact = F.pow(F.lit(10.0), log - shift)
        # Over six times what two logarithms within 1.5 units of their last place, and a power of each, can differ by. Powers of ten
        # are exact up to 22. One comparison, no OR: what is evaluated always is evaluated once.
        slack = (F.abs(log) + 1) * 1e-14
        near = F.least(F.abs(exact - F.floor(exact) - 0.5) / exact, F.abs(log - F.rint(log)), 22.5 - F.abs(shift)) <= slack
        digits = F.floor(F.lit(0.5) + exact).cast("double")
        scaled = F.when(shift > 0, digits * F.pow(F.lit(10.0), shift)).when(shift < 0, digits / F.pow(F.lit(10.0), -shift)).otherwise(digits)
        told = F.when(near, F.lit(None)).when(usual, scaled).when(x < 2.0**-1022, F.lit(0.0)).otherwise(x)
        return F.when(value < 0, -told).otherwise(told), F.when(near, value)

    def _settled(self, told: Column, value: Column) -> Column:
        digits = self.digits
        by_library = F.arrow_udf(lambda batch: pa.array([rounded(v, digits) for v in batch.to_pylist()], pa.float64()), "double")
        return F.coalesce(told, by_library(value))

    def key(self, value: Column) -> Column:
        return value.cast("double") if self.digits > 15 else self._settled(*self._split(value))

    def counts(self, df: DataFrame, value: Column) -> DataFrame:
        """As any binning's, but rows are counted first, so that the Arrow function sees distinct values only."""
        if self.digits > 15:
            return super().counts(df, value)
        told, left = self._split(value)
        first = df.groupBy(told.alias("told"), left.alias("left")).agg(F.count(F.lit(1)).alias("n"))
        return first.groupBy(self._settled(F.col("told"), F.col("left")).alias("bin_key")).agg(F.sum("n").alias("n"))

    def bound(self, value):
        self.constant(value)
        return F.lit(rounded(float(value), self.digits))

    def constant(self, value) -> Column:
        if isinstance(value, str):
            raise TypeError("a string bound on a numeric column")
        return F.lit(float(value))

    def told(self) -> dict:
        return {"kind": "precision", "digits": self.digits}


@dataclass(frozen=True)
class Explicit(Binning):
    """The greatest of the given boundaries that isn't above the value, else the type's lowest value.

    The boundaries become a balanced tree of comparisons, so that many cost no more than a few.
    """

    bounds: tuple
    lowest: object = None

    def __init__(self, bounds, kind: str | ColumnType | None = None):
        own = tuple(sorted(set(bounds)))
        if not own:
            raise ValueError("no boundaries")
        object.__setattr__(self, "bounds", own)
        if isinstance(own[0], str):
            lowest: object = ""
        elif kind is not None and not (t := column_type(kind) if isinstance(kind, str) else kind).is_float:
            lowest = 0 if t.order == "unsigned" else -(1 << (t.bits - 1))
        else:
            lowest = -1.7976931348623157e308
        object.__setattr__(self, "lowest", lowest)

    def key(self, value: Column) -> Column:
        def tree(low: int, high: int) -> Column:
            """The boundary at low - 1, ..., high - 1 that a value in between belongs to."""
            if low == high:
                return F.lit(self.bounds[low - 1] if low else self.lowest)
            middle = (low + high + 1) // 2
            return F.when(value >= F.lit(self.bounds[middle - 1]), tree(middle, high)).otherwise(tree(low, middle - 1))

        return F.when(value.isNotNull(), tree(0, len(self.bounds)))

    def upper_values(self, column: Column, value) -> Column | None:
        after = bisect_right(self.bounds, value)
        return column < F.lit(self.bounds[after]) if after < len(self.bounds) else None

    def constant(self, value) -> Column:
        if isinstance(value, str) != isinstance(self.bounds[0], str):
            raise TypeError("a bound of another type than the boundaries")
        return F.lit(value)

    def told(self) -> dict:
        return {"kind": "explicit", "bounds": list(self.bounds), "lowest": self.lowest}


@dataclass(frozen=True)
class Cast(Binning):
    """Cast to another type, then quantize as that type's binning does."""

    kind: str
    base: Binning

    def key(self, value: Column) -> Column:
        return self.base.key(value.cast(column_type(self.kind).spark))

    def told(self) -> dict:
        return {"kind": "cast", "type": self.kind, "base": self.base.told()}

    def order(self, key: Column) -> Column:
        return self.base.order(key)

    def constant(self, value) -> Column:
        return F.lit(value)


def from_told(told: dict) -> Binning:
    """The binning that told itself so."""
    kind = told["kind"]
    if kind == "sigbits":
        return Sigbits(told["n"], told["type"])
    if kind == "precision":
        return Precision(told["digits"])
    if kind == "cast":
        return Cast(told["type"], from_told(told["base"]))
    if kind == "explicit":
        made = Explicit(told["bounds"])
        object.__setattr__(made, "lowest", told["lowest"])
        return made
    raise ValueError(f"unknown binning {kind!r}")


#: Kinds of binning by the names a command line has.
BINNINGS = {"sigbits": lambda parameter, kind: Sigbits(int(parameter), kind), "precision": lambda parameter, kind: Precision(int(parameter)), "explicit": lambda parameter, kind: Explicit(parameter, kind)}


def binning(name: str, parameter, kind: str | None = None) -> Binning:
    if name not in BINNINGS:
        raise ValueError(f"unknown binning {name!r}")
    if name == "precision" and kind is not None and not column_type(kind).is_float:
        raise TypeError("decimal precision needs a float type")
    return BINNINGS[name](parameter, kind)
