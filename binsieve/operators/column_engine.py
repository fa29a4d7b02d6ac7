"""The primary query path: a query over binned columns as one Boolean column for Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsieve.functions.binning import Binning
from binsieve.plans.terms import Constraint, Query


def combine(name: str, operands: list[Column]) -> Column:
    """Set operators as Boolean algebra over columns that are never null."""
    if name == "NOT":
        return ~operands[0]
    if name == "AND":
        return reduce(lambda a, b: a & b, operands)
    if name == "OR":
        return reduce(lambda a, b: a | b, operands)
    if name == "ANDNOT":
        return operands[0] & ~reduce(lambda a, b: a | b, operands[1:]) if len(operands) > 1 else operands[0]
    return reduce(lambda a, b: a != b, operands)


class ColumnEngine:
    """Range queries over the columns of one DataFrame, one record for each row.

    With mode ``bins`` a constraint selects whole bins: it starts with the greatest populated key at
    or below the key of its lower bound (the least key where there is none) and ends with the key of
    its upper bound. With ``exact`` it selects values. A null value is in no bin: constraints are
    false for it and their complements true. Partitions, where ``part`` names a column, have keys of
    their own.
    """

    def __init__(self, df: DataFrame, binnings: dict[str, Binning], rid: str, part: str | None = None, mode: str = "bins"):
        if mode not in ("bins", "exact"):
            raise ValueError(f"unknown mode {mode!r}")
        self.df, self.binnings, self.rid, self.part, self.mode = df, binnings, rid, part, mode

    def order(self, var: str) -> Column:
        own = self.binnings[var]
        return own.order(own.key(F.col(var)))

    def _lows(self, query: Query) -> tuple[DataFrame | None, dict[Constraint, Column]]:
        """The first key of each constraint with a lower bound, by one aggregation of all of them."""
        wanted = [c for c in dict.fromkeys(t for t in query.terms if isinstance(t, Constraint)) if c.lower is not None]
        if not wanted or self.mode == "exact":
            return None, {}
        found = []
        for i, c in enumerate(wanted):
            key = self.order(c.var)
            bound = self.binnings[c.var].bound(c.lower)
            found.append(F.coalesce(F.max(F.when(key <= bound, key)), F.min(key)).alias(f"_low{i}"))
        rows = self.df.groupBy(F.col(self.part).alias("_part")) if self.part else self.df
        lows = rows.agg(*found)
        if self.part:
            return lows, {c: F.col(f"_low{i}") for i, c in enumerate(wanted)}
        one = lows.agg(F.first(F.struct(*lows.columns)).alias("lows")).scalar()
        return None, {c: one[f"_low{i}"] for i, c in enumerate(wanted)}

    def predicate(self, query: Query, lows: dict[Constraint, Column]) -> Column:
        def leaf(c: Constraint) -> Column:
            if c.var not in self.binnings:
                raise KeyError(f"no binning for {c.var}")
            # Null only where the column is, and there the first test is false: so the whole is never null.
            value, own = F.col(c.var), self.binnings[c.var]
            tests = [value.isNotNull()]
            if self.mode == "exact":
                tests += ([value >= F.lit(c.lower)] if c.lower is not None else []) + ([value <= F.lit(c.upper)] if c.upper is not None else [])
                return reduce(lambda a, b: a & b, tests)
            key = self.order(c.var)
            if c.lower is not None:
                tests.append(key >= lows[c])
            if c.upper is not None:
                tests.append(key <= own.bound(c.upper))
                if (scanned := own.upper_values(value, c.upper)) is not None:
                    tests.append(scanned)
            return reduce(lambda a, b: a & b, tests)

        return query.fold(leaf, combine)

    def select(self, query: Query) -> DataFrame:
        """The rows that answer the query."""
        lows, by_constraint = self._lows(query)
        condition = self.predicate(query, by_constraint)
        if lows is None:
            return self.df.where(condition)
        # A row for each partition; joined by size as any table is.
        return self.df.join(lows, F.col(self.part) == F.col("_part")).where(condition).select(self.df.columns)

    def evaluate(self, query: Query, begin: int = 0, end: int | None = None) -> DataFrame:
        """Record ids, with their partition if there are any, of partitions begin <= part < end."""
        found = self.select(query)
        if not self.part:
            return found.select(F.col(self.rid).cast("bigint").alias("rid"))
        found = found.where(F.col(self.part) >= begin)
        if end is not None:
            found = found.where(F.col(self.part) < end)
        return found.select(F.col(self.part).alias("part_id"), F.col(self.rid).cast("bigint").alias("rid"))

    def count(self, query: Query) -> DataFrame:
        return self.select(query).agg(F.count(F.lit(1)).alias("n"))

    def bin_keys(self, var: str, nulls: bool = False) -> DataFrame:
        """Populated keys with their counts, in key order; with ``nulls`` the count of nulls, if there are any, under a null key."""
        own = self.binnings[var]
        rows = self.df if nulls else self.df.where(F.col(var).isNotNull())
        return own.counts(rows, F.col(var)).orderBy(own.order(F.col("bin_key")))
