"""Set algebra on regions as they are stored: lists of ids, lists of the ids that are missing, and runs.

Nothing here goes through words. A list form is (chunk, ids) with ids in order, by chunks of 2^16
records, and a flag that says whether it lists a region or its complement; the flag is folded by De Morgan's rules, so
that no complement is ever spelled out. A run form is (start, len).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binsieve.operators import regions

CHUNK = 1 << 16


@dataclass(frozen=True)
class IdLists:
    """A region as lists; ``inverted`` ones list the records that are not in it."""

    lists: DataFrame
    inverted: bool = False

    @staticmethod
    def of(rids: DataFrame, inverted: bool = False) -> IdLists:
        """Lists of a column ``rid``: the region's records, or with ``inverted`` its complement's."""
        chunk = F.floor(F.col("rid") / CHUNK).cast("bigint")
        return IdLists(rids.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list("rid")).alias("ids")), inverted)

    def _with(self, other: IdLists, made) -> DataFrame:
        """Chunk by chunk; a chunk that one side lacks is empty there."""
        none = F.array().cast("array<bigint>")
        both = self.lists.select("chunk", F.col("ids").alias("a")).join(other.lists.select("chunk", F.col("ids").alias("b")), "chunk", "full")
        ids = F.sort_array(made(F.coalesce("a", none), F.coalesce("b", none)))
        return both.select("chunk", ids.alias("ids")).where(F.size("ids") > 0)

    def __invert__(self) -> IdLists:
        return replace(self, inverted=not self.inverted)

    def __and__(self, other: IdLists) -> IdLists:
        if self.inverted and other.inverted:
            return IdLists(self._with(other, F.array_union), True)
        if self.inverted:
            return IdLists(other._with(self, F.array_except))
        return IdLists(self._with(other, F.array_except if other.inverted else F.array_intersect))

    def __or__(self, other: IdLists) -> IdLists:
        return ~(~self & ~other)

    def __sub__(self, other: IdLists) -> IdLists:
        return self & ~other

    def __xor__(self, other: IdLists) -> IdLists:
        return IdLists(self._with(other, lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a))), self.inverted != other.inverted)

    def rids(self, domain: DataFrame | None = None) -> DataFrame:
        """The region's record ids; an inverted form needs its domain, a table of one row with ``size``."""
        listed = self.lists.select(F.explode("ids").alias("rid"))
        if not self.inverted:
            return listed
        if domain is None:
            raise ValueError("what is missing from an inverted list depends on the domain")
        return regions.rids(regions.uniform(regions.spine(domain, "size"), True)).join(listed, "rid", "left_anti")


def _holds(name: str, mask: Column, operands: int) -> Column:
    """Whether a record is in the result, by the bits of the operands it is in."""
    if name == "OR":
        return mask != 0
    if name == "AND":
        return mask == (1 << operands) - 1
    if name == "ANDNOT":
        return mask == 1
    if name == "XOR":
        return F.bit_count(mask) % 2 == 1
    raise ValueError(f"unknown operator {name!r}")


def combine_runs(name: str, *operands: DataFrame) -> DataFrame:
    """(start, len) of the maximal runs that OR, AND, ANDNOT or XOR of run forms gives, by one sweep.

    Runs are cut at stretches of 2^16 words, which are swept apart; the mask of open operands changes only where a
    run of one of them begins or ends, however long it is. At most 62 operands.
    """
    if not 0 < len(operands) <= 62:
        raise ValueError("one to 62 operands")
    stretch = regions.BITS << 16
    events = None
    for k, runs in enumerate(operands):
        last = F.col("start") + F.col("len") - 1
        cut = runs.where("len > 0").select(F.col("start").alias("s"), last.alias("e"), F.explode(F.sequence(F.floor(F.col("start") / stretch), F.floor(last / stretch))).alias("chunk"))
        ends = F.array(F.greatest("s", F.col("chunk") * stretch), F.least(F.col("e") + 1, (F.col("chunk") + 1) * stretch))
        own = cut.select("chunk", F.explode(ends).alias("at"), F.lit(1 << k).cast("bigint").alias("bit"))
        events = own if events is None else events.unionByName(own)
    # Runs of one operand that touch open and close at one place, which cancels out.
    turns = events.groupBy("chunk", "at").agg(F.bit_xor("bit").alias("bit")).where("bit <> 0")
    order = Window.partitionBy("chunk").orderBy("at")
    mask = F.bit_xor("bit").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = turns.select("chunk", "at", mask.alias("mask"), F.lead("at").over(order).alias("to"))
    held = swept.where(F.col("to").isNotNull() & _holds(name, F.col("mask"), len(operands)))
    fresh = (F.coalesce(F.lag("to").over(order), F.lit(-1)) != F.col("at")).cast("int")
    numbered = held.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    parts = numbered.groupBy("chunk", "run").agg(F.min("at").alias("start"), (F.max("to") - 1).alias("stop")).select("start", "stop")
    return regions.joined(parts)
