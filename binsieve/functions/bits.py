"""Bit-level column functions: float bits, bit dilation, Morton order, and word transforms."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LONG, MAX_LONG = -(1 << 63), (1 << 63) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def float_bits(value: Column, bits: int = 64) -> Column:
    """The IEEE 754 bits of a float or double as a long, by arithmetic alone so that code generation holds.

    The exponent comes from a logarithm put right by one step either way; scaling by powers of two is
    exact, subnormals included. NaN is the positive quiet one.
    """
    fraction, bias = (52, 1023) if bits == 64 else (23, 127)
    x = F.abs(value.cast("double"))
    safe = F.when((x > 0) & (x < float("inf")), x).otherwise(F.lit(1.0))
    small = safe < 2.0 ** (1 - bias)
    guess = F.floor(F.log2(F.when(small, F.lit(1.0)).otherwise(safe))).cast("int")
    guess = F.when(F.pow(F.lit(2.0), guess) > safe, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= safe, guess + 1).otherwise(guess)
    mantissa = (safe / F.pow(F.lit(2.0), guess) - 1) * float(1 << fraction)
    normal = F.shiftleft((guess + bias).cast("bigint"), fraction) + mantissa.cast("bigint")
    half = (bias + fraction - 1) // 2
    subnormal = (safe * 2.0**half * 2.0 ** (bias + fraction - 1 - half)).cast("bigint")
    plain = F.when(small, subnormal).otherwise(normal)
    top = _long(((1 << (bits - fraction - 1)) - 1) << fraction)
    plain = F.when(F.isnan(value), top + _long(1 << (fraction - 1))).when(x == float("inf"), top).when(x == 0, _long(0)).otherwise(plain)
    negative = ~F.isnan(value) & ((value < 0) | (value == 0) & value.cast("string").startswith("-"))
    sign = _long(MIN_LONG if bits == 64 else 1 << 31)
    return F.when(negative, plain.bitwiseOR(sign)).otherwise(plain)


def dilate(value: Column, dims: int, width: int) -> Column:
    """Spread ``width`` low bits so that ``dims - 1`` zero bits follow each."""
    out = _long(0)
    for i in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("bigint"), i).bitwiseAND(_long(1)), i * dims))
    return out


def undilate(value: Column, dims: int, width: int) -> Column:
    """Gather every ``dims``-th bit: the inverse of ``dilate``."""
    out = _long(0)
    for i in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("bigint"), i * dims).bitwiseAND(_long(1)), i))
    return out


def morton(coordinates: list[Column], width: int) -> Column:
    """The Z-order id of coordinates, the last one varying fastest."""
    d = len(coordinates)
    out = _long(0)
    for k, c in enumerate(reversed(coordinates)):
        out = out.bitwiseOR(F.shiftleft(dilate(c, d, width), k))
    return out


def row_major(coordinates: list[Column], dims: list[int]) -> Column:
    out = _long(0)
    for c, n in zip(coordinates, dims):
        out = out * n + c.cast("bigint")
    return out


def coordinates(rid: Column, dims: list[int]) -> list[Column]:
    """Row-major coordinates of a record id."""
    out, stride = [], 1
    for n in reversed(dims):
        out.append(F.pmod(F.floor(rid / F.lit(stride)).cast("bigint"), F.lit(n)).alias(f"c{len(dims) - 1 - len(out)}"))
        stride *= n
    return out[::-1]


def z_order(spark: SparkSession, dims: list[int]) -> DataFrame:
    """(z, rid, c0, c1, ...): every cell of a grid of one to five dimensions with its Z-order id and row-major id.

    Cells are enumerated row by row and only those of the grid, so that a grid whose sides are no powers of two costs
    no more; ``orderBy("z")`` gives the curve, with gaps in z where it leaves the grid.
    """
    if not 1 <= len(dims) <= 5 or min(dims) < 0:
        raise ValueError("one to five dimensions, none negative")
    cells = spark.range(prod(dims)).select(F.col("id").alias("rid"), *(coordinates(F.col("id"), dims) if min(dims) else [F.col("id").alias(f"c{k}") for k in range(len(dims))]))
    width = max((n - 1).bit_length() for n in dims)
    if width * len(dims) > 63:
        raise ValueError("Z-order ids of this grid don't fit into 63 bits")
    names = [f"c{k}" for k in range(len(dims))]
    return cells.select(morton([F.col(c) for c in names], width).alias("z"), "rid", *names)


def transform_word(value: Column, mode: str, keep: int, width: int) -> Column:
    """Bitwise transforms of a ``width``-bit word: keep its high bits, order signed ones, or clear low ones.

    ``truncate`` moves the ``keep`` high bits down; ``conv2c`` does so after flipping the sign bit, so
    that unsigned order is the order of two's complement; ``zero`` clears all but the high bits.
    """
    mask = _long(-1 if width == 64 else (1 << width) - 1)
    word = value.cast("bigint").bitwiseAND(mask)
    if mode == "conv2c":
        word = word.bitwiseXOR(_long(MIN_LONG if width == 64 else 1 << (width - 1)))
    elif mode not in ("truncate", "zero"):
        raise ValueError(f"unknown mode {mode!r}")
    high = F.shiftrightunsigned(word, width - keep) if keep < width else word
    return F.shiftleft(high, width - keep) if mode == "zero" and keep < width else high
