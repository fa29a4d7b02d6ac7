"""Queries answered from indexes alone: bin ranges, region formulas, and set algebra on words."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsieve.functions.binning import Binning
from binsieve.operators import regions
from binsieve.operators.index import PART, Index
from binsieve.plans.encoding import ENCODINGS, Formula
from binsieve.plans.terms import Constraint, Operator, Query

#: Cost of a seek, in bytes read.
SEEK = 1 << 20


def read_cost(formula: Formula, sizes: dict[int, int]) -> int:
    """Bytes of the regions read, and a seek for each stretch of consecutive ids."""
    ids = formula.regions()
    return sum(sizes.get(i, 0) for i in ids) + SEEK * sum(1 for i, r in enumerate(ids) if not i or ids[i - 1] != r - 1)


def choose(encoding: str, n: int, lower: int, upper: int, sizes: dict[int, int], complement: str = "auto") -> tuple[Formula, bool]:
    """The formula for a bin range, direct or by complement as told or as reading costs less."""
    made = ENCODINGS[encoding]
    direct, other = made.formula(n, lower, upper), made.formula(n, lower, upper, True)
    if complement == "always" or complement == "auto" and read_cost(other, sizes) < read_cost(direct, sizes):
        return other, other != direct
    if complement not in ("auto", "never"):
        raise ValueError(f"unknown complement mode {complement!r}")
    return direct, False


_PICK = "array<struct<side:int,place:int,ands:int,is_and:boolean,region_id:int>>"
_PLAN = f"part_id bigint, nbins int, lower int, upper int, kind string, complemented boolean, negated boolean, seeks int, formula string, picks {_PICK}"


def _plans(encoding: str):
    """A function of batches of bin ranges that adds each partition's formula."""
    made = ENCODINGS[encoding]

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("kind", "complemented", "negated", "seeks", "formula", "picks")}
            for n, lower, upper, other in zip(*(batch.column(c).to_pylist() for c in ("nbins", "lower", "upper", "other"))):
                kind = "empty" if lower >= upper else "full" if (lower, upper) == (0, n) else "some"
                formula, complemented, negated, picks = None, False, False, []
                if kind == "some":
                    formula = made.formula(n, lower, upper, other)
                    complemented = other and formula != made.formula(n, lower, upper)
                    *chains, negated = formula.sides()
                    for side, chain in enumerate(chains):
                        ands = 0
                        for place, (op, region) in enumerate(chain):
                            ands += op == "AND"
                            picks.append({"side": side, "place": place, "ands": ands, "is_and": op == "AND", "region_id": region})
                ids = formula.regions() if formula else []
                told = (kind, complemented, negated, sum(not i or ids[i - 1] != r - 1 for i, r in enumerate(ids)), str(formula or kind), picks)
                for column, value in zip(rows.values(), told):
                    column.append(value)
            pick = pa.list_(pa.struct([("side", pa.int32()), ("place", pa.int32()), ("ands", pa.int32()), ("is_and", pa.bool_()), ("region_id", pa.int32())]))
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pick)
            own = [batch.column(c) for c in ("part_id", "nbins", "lower", "upper")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], names=["part_id", "nbins", "lower", "upper", *rows])

    return run


def _chain(found: Column, side: int, ands: Column) -> Column:
    """The words of one chain, from left to right, where a region without a word here is zero: what an AND that is missing leaves."""
    zero = F.lit(0).cast("bigint")
    steps = F.array_sort(F.filter(found, lambda x: x["side"] == side))

    def step(held, x):
        # ``ands`` counts the ANDs up to a place: one that has no word lies between if the count jumps.
        before = F.when(held["ands"] == x["ands"] - x["is_and"].cast("int"), held["word"]).otherwise(zero)
        return F.struct(x["ands"].alias("ands"), F.when(x["is_and"], before.bitwiseAND(x["word"])).otherwise(before.bitwiseOR(x["word"])).alias("word"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("ands"), zero.alias("word")), step, lambda held: F.when(held["ands"] == ands, held["word"]).otherwise(zero))


#: The region id under which the words of all records in a bin meet a plan's picks, and the side they are on.
PRESENT, WHOLE = -1, 2


def _combine(name: str, operands: list[Column]) -> Column:
    """One operator on words that stand side by side; NOT is within the spine's mask."""
    first, *rest = operands
    if name == "NOT":
        return F.bitwise_not(first).bitwiseAND(F.coalesce("mask", F.lit(0).cast("bigint")))
    if name == "ANDNOT":
        return first.bitwiseAND(F.bitwise_not(reduce(Column.bitwiseOR, rest))) if rest else first
    return reduce({"AND": Column.bitwiseAND, "OR": Column.bitwiseOR, "XOR": Column.bitwiseXOR}[name], rest, first)


class IndexEngine:
    """Range queries over indexes of several columns with the same partitions.

    Bins of an index come from the binning it was built with; ``binnings`` is for indexes that carry none, and
    one that differs from the index's own is an error.
    """

    def __init__(self, indexes: dict[str, Index], binnings: dict[str, Binning] | None = None, complement: str = "auto"):
        if not indexes:
            raise ValueError("no index")
        if complement not in ("auto", "never", "always"):
            raise ValueError(f"unknown complement mode {complement!r}")
        self.indexes, self.complement = indexes, complement
        self.binnings = {}
        for var, index in indexes.items():
            told = (binnings or {}).get(var)
            if index.binning is not None and told is not None and told != index.binning:
                raise ValueError(f"the index of {var} was built with {index.binning}, not {told}")
            if (own := index.binning or told) is None:
                raise ValueError(f"no binning for {var}")
            self.binnings[var] = own

    def bin_range(self, c: Constraint, begin: int = 0, end: int | None = None) -> DataFrame:
        """(part_id, nbins, lower, upper): the bins lower <= b < upper that a constraint touches in each partition."""
        index, own = self.indexes[c.var], self.binnings[c.var]
        order, number = F.col("order"), F.col("bin_no")
        low = F.coalesce(F.max(F.when(order <= own.bound(c.lower), number)), F.lit(0)) if c.lower is not None else F.lit(0)
        high = F.coalesce(F.max(F.when(order <= own.bound(c.upper), number)), F.lit(-1)) + 1 if c.upper is not None else F.max(number) + 1
        found = self._some(index.bins, begin, end).groupBy("part_id").agg((F.max(number) + 1).alias("nbins"), low.alias("lower"), high.alias("upper"))
        parts = self._some(index.parts, begin, end).select("part_id")
        zero = F.lit(0)
        return parts.join(found, "part_id", "left").select("part_id", F.coalesce("nbins", zero).alias("nbins"), F.coalesce("lower", zero).alias("lower"), F.greatest(F.coalesce("upper", zero), F.coalesce("lower", zero)).alias("upper"))

    @staticmethod
    def _some(df: DataFrame, begin: int, end: int | None) -> DataFrame:
        df = df.where(F.col("part_id") >= begin)
        return df if end is None else df.where(F.col("part_id") < end)

    def plan(self, c: Constraint, begin: int = 0, end: int | None = None) -> DataFrame:
        """How a constraint is answered in each partition, one row each: bin range, formula, and the regions it picks.

        Partitions differ in their bins, so each has a formula of its own, direct or by complement as
        costs less there. Nothing comes to the driver, and the plan is the same for any number of partitions.
        """
        index = self.indexes[c.var]
        ranges = self.bin_range(c, begin, end)
        if self.complement == "auto" and index.encoding == "equality":
            inside = (F.col("region_id") >= F.col("lower")) & (F.col("region_id") < F.col("upper"))
            sized = ranges.join(self._some(index.sizes, begin, end), "part_id", "left").groupBy("part_id", "nbins", "lower", "upper")
            seeks = (F.col("lower") > 0).cast("int") + (F.col("upper") < F.col("nbins")).cast("int")
            cost = sized.agg(F.coalesce(F.sum(F.when(inside, F.col("bytes"))), F.lit(0)).alias("direct"), F.coalesce(F.sum(F.when(~inside, F.col("bytes"))), F.lit(0)).alias("rest"))
            ranges = cost.withColumn("other", F.col("rest") + SEEK * seeks < F.col("direct") + SEEK)
        else:
            ranges = ranges.withColumn("other", F.lit(self.complement == "always"))
        own = ranges.select("part_id", F.col("nbins").cast("int").alias("nbins"), F.col("lower").cast("int").alias("lower"), F.col("upper").cast("int").alias("upper"), "other")
        return own.mapInArrow(_plans(index.encoding), _PLAN)

    def _picked(self, c: Constraint, number: int, begin: int, end: int | None) -> DataFrame:
        """The words that one constraint's plan picks, each with its place in the formula.

        A partition that is answered by what its regions leave, or in full, also picks the words of
        all records that are in a bin, so that nulls stay out.
        """
        index, plan = self.indexes[c.var], self.plan(c, begin, end)
        most = lambda k: F.coalesce(F.array_max(F.transform(F.filter("picks", lambda x: x["side"] == k), lambda x: x["ands"])), F.lit(0)).alias(f"ands{k}")
        told = {"side": F.lit(WHOLE), "place": F.lit(0), "ands": F.lit(0), "is_and": F.lit(False), "region_id": F.lit(PRESENT)}
        present = F.when(F.expr("negated or kind = 'full'"), F.array(F.struct(*(v.alias(k) for k, v in told.items())))).otherwise(F.array().cast(_PICK))
        picks = plan.select("part_id", most(0), most(1), F.explode(F.concat("picks", present)).alias("pick")).select("part_id", "ands0", "ands1", "pick.*")
        stored = self._some(index.words, begin, end)
        if index.stored:  # regions outside the least and the greatest picked are left out by the scan
            ends = picks.where(F.col("region_id") != PRESENT).agg(F.min("region_id").alias("low"), F.max("region_id").alias("high"))
            stored = stored.where((F.col("region_id") >= ends.select("low").scalar()) & (F.col("region_id") <= ends.select("high").scalar()))
        whole = self._some(index.present, begin, end).select("part_id", F.lit(PRESENT).alias("region_id"), "word_idx", "word")
        found = stored.select("part_id", "region_id", "word_idx", "word").unionByName(whole).join(picks, ["part_id", "region_id"])
        return found.select("part_id", "word_idx", F.lit(number).alias("number"), "word", "side", "place", "ands", "is_and", "ands0", "ands1")

    def _answer(self, c: Constraint, number: int) -> tuple[list[Column], Column]:
        """One constraint's columns in the aggregation by word, and its answer from them."""
        own, zero = F.col("number") == number, F.lit(0).cast("bigint")
        side = lambda k: F.bit_or(F.when(own & (F.col("side") == k), F.col("word"))).alias(f"side{k}_{number}")
        whole = F.col(f"side{WHOLE}_{number}")
        if self.indexes[c.var].encoding in ("binary", "interval"):
            # ANDs need their order; a position has as many rows as a formula has regions: at most two, or bits of the bins' number.
            listed = F.collect_list(F.when(own & (F.col("side") != WHOLE), F.struct("side", "place", "ands", "is_and", "word"))).alias(f"found_{number}")
            aggregates = [listed, *(F.max(F.when(own, F.col(f"ands{k}"))).alias(f"ands{k}_{number}") for k in (0, 1)), side(WHOLE)]
            kept, dropped = (_chain(F.col(f"found_{number}"), k, F.coalesce(F.col(f"ands{k}_{number}"), F.lit(0))) for k in (0, 1))
        else:
            aggregates = [side(0), side(1), side(WHOLE)]
            kept, dropped = (F.coalesce(F.col(f"side{k}_{number}"), zero) for k in (0, 1))
        picked = kept.bitwiseAND(F.bitwise_not(dropped))
        return aggregates, F.when(whole.isNotNull(), whole.bitwiseAND(F.bitwise_not(picked))).otherwise(picked)

    def words(self, query: Query, begin: int = 0, end: int | None = None) -> DataFrame:
        """(part_id, word_idx, word) of the answer.

        The words that all constraints pick meet in one aggregation by (partition, word), whatever the
        expression is; its operators then are functions of the answers that stand side by side in a row.
        """
        numbers = {c: i for i, c in enumerate(dict.fromkeys(t for t in query.terms if isinstance(t, Constraint)))}
        aggregates, answers, rows = [], {}, None
        for c, number in numbers.items():
            own, answer = self._answer(c, number)
            aggregates += own
            answers[c] = F.col(f"answer_{number}"), answer.alias(f"answer_{number}")
            picked = self._picked(c, number, begin, end)
            rows = picked if rows is None else rows.unionByName(picked)
        if rows is None:
            raise ValueError("a query without a constraint")
        masked = any(isinstance(t, Operator) and t.name == "NOT" for t in query.terms)
        if masked:
            spine = regions.spine(self._some(next(iter(self.indexes.values())).parts, begin, end), "domain_size", PART)
            rows = rows.unionByName(spine.select("part_id", "word_idx", F.lit(len(numbers)).alias("number"), F.col("mask").alias("word")), allowMissingColumns=True)
            aggregates.append(F.bit_or(F.when(F.col("number") == len(numbers), F.col("word"))).alias("mask"))
        sides = rows.groupBy(*PART, "word_idx").agg(*aggregates).select(*PART, "word_idx", *(["mask"] if masked else []), *(a for _, a in answers.values()))
        return sides.select(*PART, "word_idx", query.fold(lambda c: answers[c][0], _combine).alias("word")).where("word <> 0")

    def evaluate(self, query: Query, begin: int = 0, end: int | None = None) -> DataFrame:
        """(part_id, rid) with 0-based record ids over all partitions."""
        some = next(iter(self.indexes.values()))
        found = self.words(query, begin, end).join(some.parts.select("part_id", "domain_offset"), "part_id")
        return regions.rids(found, F.col("domain_offset"), PART)

    def counts(self, query: Query, begin: int = 0, end: int | None = None) -> DataFrame:
        """(part_id, n) for every partition."""
        some = self._some(next(iter(self.indexes.values())).parts, begin, end).select("part_id")
        return some.join(regions.count(self.words(query, begin, end), PART), "part_id", "left").select("part_id", F.coalesce("n", F.lit(0)).alias("n"))

    def statistics(self, query: Query, begin: int = 0, end: int | None = None) -> DataFrame:
        """A row for each constraint and partition: bins touched, regions, bytes and seeks read, complement used, and the formula."""
        out = None
        for c in dict.fromkeys(t for t in query.terms if isinstance(t, Constraint)):
            plan = self.plan(c, begin, end)
            read = plan.select("part_id", F.explode(F.array_distinct(F.transform("picks", lambda x: x["region_id"]))).alias("region_id"))
            read = read.join(self._some(self.indexes[c.var].sizes, begin, end), ["part_id", "region_id"], "left").groupBy("part_id").agg(F.count(F.lit(1)).alias("regions_read"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
            zero = F.lit(0).cast("bigint")
            rows = plan.join(read, "part_id", "left").select(
                F.lit(str(c)).alias("constraint"), "part_id", "nbins", (F.col("upper") - F.col("lower")).alias("bins_touched"), F.coalesce("regions_read", zero).alias("regions_read"),
                F.coalesce("bytes", zero).alias("bytes"), F.col("seeks").cast("bigint").alias("seeks"), "complemented", "formula",
            )
            out = rows if out is None else out.unionByName(rows)
        return out

    @staticmethod
    def total_statistics(rows: DataFrame) -> DataFrame:
        """Statistics of many partitions, or of many runs, added up by constraint."""
        sums = [F.sum(c).alias(c) for c in ("bins_touched", "regions_read", "bytes", "seeks")]
        return rows.groupBy("constraint").agg(F.count(F.lit(1)).alias("parts"), *sums, F.sum(F.col("complemented").cast("bigint")).alias("complemented"))

    def cursor(self, query: Query, begin: int = 0, end: int | None = None, step: int = 1) -> Cursor:
        """The answer, some partitions at a time."""
        return Cursor(self, query, begin, end, step)


class Cursor:
    """Record ids of ``step`` partitions after another, each worked out when it is asked for.

    The driver holds the numbers of the partitions. A cursor is also an iterator.
    """

    def __init__(self, engine: IndexEngine, query: Query, begin: int, end: int | None, step: int):
        if step < 1:
            raise ValueError("a step is one partition or more")
        self.engine, self.query, self.step_size = engine, query, step
        parts = engine._some(next(iter(engine.indexes.values())).parts, begin, end)
        self.parts = [r["part_id"] for r in parts.select("part_id").orderBy("part_id").collect()]
        self.at = 0

    def has_next(self) -> bool:
        return self.at < len(self.parts)

    def step(self, n: int = 1) -> None:
        """Pass over n steps."""
        self.at = min(len(self.parts), self.at + n * self.step_size)

    def next(self) -> DataFrame:
        """(part_id, rid) of the next partitions."""
        if not self.has_next():
            raise StopIteration
        own = self.parts[self.at : self.at + self.step_size]
        self.step()
        return self.engine.evaluate(self.query, own[0], own[-1] + 1)

    __next__ = next

    def __iter__(self) -> Cursor:
        return self
