"""Regions: sets of record ids as words of 64 bits, and what else they can be written as.

A word table has (region_id, word_idx, word); a word that isn't there is zero. With ``by`` columns,
such as a partition's id, every operation holds within each of their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64


def words(df: DataFrame, rid: str, region: str = "region_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Word table of (region, rid) rows; partial words are combined before the shuffle."""
    position = F.pmod(F.col(rid), F.lit(BITS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), position)
    return df.groupBy(*by, F.col(region).alias("region_id"), F.floor(F.col(rid) / BITS).cast("bigint").alias("word_idx")).agg(F.bit_or(bit).alias("word"))


#: Word positions of a stretch of a spine that one row stands for before it is spread over tasks.
STRETCH = 1 << 16


def spine(domain: DataFrame, size: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All word positions of a domain of ``size`` records, each with the mask of its valid bits.

    A domain is cut into stretches first, which are dealt to all tasks, so that no row or task has to hold all of a long one.
    """
    n = int(domain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col(size) - 1) / BITS)
    rest = F.pmod(F.col(size), F.lit(BITS)).cast("int")
    full = F.lit(-1).cast("bigint")
    tail = F.when((F.col("word_idx") == last) & (rest > 0), F.call_function("shiftleft", F.lit(1).cast("bigint"), rest) - F.lit(1).cast("bigint")).otherwise(full)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    stretches = domain.where(F.col(size) > 0).select(*by, size, F.explode(F.sequence(zero, F.floor(last / STRETCH).cast("bigint"))).alias("stretch")).repartition(n, *by, "stretch")
    first = F.col("stretch") * STRETCH
    return stretches.select(*by, size, F.explode(F.sequence(first, F.least(last.cast("bigint"), first + F.lit(STRETCH).cast("bigint") - one))).alias("word_idx")).select(*by, "word_idx", tail.alias("mask"))


def _operands(regions: list[DataFrame], by: tuple[str, ...]) -> DataFrame:
    parts = [r.select(*by, "word_idx", "word", F.lit(i).alias("operand")) for i, r in enumerate(regions)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union(*regions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _operands(list(regions), by).groupBy(*by, "word_idx").agg(F.bit_or("word").alias("word")).where("word <> 0")


def intersect(*regions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A word that some operand lacks is zero there."""
    found = _operands(list(regions), by).groupBy(*by, "word_idx").agg(F.bit_and("word").alias("word"), F.count_distinct("operand").alias("n"))
    return found.where((F.col("n") == len(regions)) & (F.col("word") != 0)).drop("n")


def difference(first: DataFrame, *rest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    own, other = F.bit_or(F.when(F.col("operand") == 0, F.col("word"))), F.bit_or(F.when(F.col("operand") > 0, F.col("word")))
    found = _operands([first, *rest], by).groupBy(*by, "word_idx").agg(own.alias("own"), other.alias("other"))
    return found.select(*by, "word_idx", F.col("own").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("bigint")))).alias("word")).where("word <> 0")


def symdiff(*regions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _operands(list(regions), by).groupBy(*by, "word_idx").agg(F.bit_xor("word").alias("word")).where("word <> 0")


def complement(region: DataFrame, whole: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What the domain's spine has and the region has not."""
    out = whole.join(region.select(*by, "word_idx", "word"), [*by, "word_idx"], "left")
    return out.select(*by, "word_idx", F.bitwise_not(F.coalesce("word", F.lit(0).cast("bigint"))).bitwiseAND(F.col("mask")).alias("word")).where("word <> 0")


def uniform(whole: DataFrame, filled: bool, by: tuple[str, ...] = ()) -> DataFrame:
    return whole.select(*by, "word_idx", F.col("mask").alias("word")).where(F.lit(filled))


def count(region: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    total = F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("bigint").alias("n")
    return region.groupBy(*by).agg(total) if by else region.agg(total)


def rids(region: DataFrame, offset: Column | int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Record ids of a region, 0-based, with the domain's offset added."""
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", F.col("word"), b) == 1)).alias("bit")
    base = offset if isinstance(offset, Column) else F.lit(offset)
    return region.select(*by, base.alias("_base"), "word_idx", bit).select(*by, (F.col("_base") + F.col("word_idx") * BITS + F.col("bit")).cast("bigint").alias("rid"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two regions have the same records."""
    return symdiff(a.select("word_idx", "word"), b.select("word_idx", "word")).agg((F.count(F.lit(1)) == 0).alias("equal"))


def from_runs(runs: DataFrame, start: str = "start", length: str = "len", by: tuple[str, ...] = ()) -> DataFrame:
    """Word table of runs of records, each run cut at word ends."""
    last = F.col(start) + F.col(length) - 1
    cut = F.explode(F.sequence(F.floor(F.col(start) / BITS).cast("bigint"), F.floor(last / BITS).cast("bigint")))
    parts = runs.where(F.col(length) > 0).select(*by, F.col(start).alias("s"), last.alias("e"), cut.alias("word_idx"))
    low = F.greatest(F.col("s") - F.col("word_idx") * BITS, F.lit(0)).cast("int")
    high = F.least(F.col("e") - F.col("word_idx") * BITS, F.lit(BITS - 1)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), BITS - 1 - high)
    mask = F.call_function("shiftleft", F.call_function("shiftrightunsigned", ones, low), low)
    return parts.groupBy(*by, "word_idx").agg(F.bit_or(mask).alias("word"))


def runs(region: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Run-length form: (start, len) of each maximal run.

    Records of 2^16 words are numbered together, where the difference of record and number tells the runs
    apart; those that meet at the ends of such stretches are put together by a second window over the ends.
    """
    ids = rids(region, by=by)
    chunk = F.floor(F.col("rid") / (BITS << 16))
    within = Window.partitionBy(*by, "chunk").orderBy("rid")
    marked = ids.withColumn("chunk", chunk).withColumn("island", F.col("rid") - F.row_number().over(within))
    parts = marked.groupBy(*by, "chunk", "island").agg(F.min("rid").alias("start"), F.max("rid").alias("stop")).drop("island")
    return joined(parts, by)


def joined(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, len) of runs (start, stop) that were found in stretches of 2^16 words each.

    A run that goes over stretches touches their edges: only those parts meet in a second pass.
    """
    edge = (F.pmod("start", F.lit(BITS << 16)) == 0) | (F.pmod(F.col("stop") + 1, F.lit(BITS << 16)) == 0)
    inner = parts.where(~edge).select(*by, "start", "stop")
    order = Window.partitionBy(*by).orderBy("start") if by else Window.partitionBy(F.lit(0)).orderBy("start")
    edges = parts.where(edge).withColumn("fresh", (F.coalesce(F.lag("stop").over(order), F.lit(-2)) + 1 != F.col("start")).cast("int")).withColumn("run", F.sum("fresh").over(order))
    whole = edges.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(*by, "start", "stop")
    return inner.unionByName(whole).select(*by, "start", (F.col("stop") - F.col("start") + 1).alias("len"))


def blocks(region: DataFrame, dims: int, levels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Tree form: the largest aligned blocks of (2^dims)^level records that are full.

    Each level's full blocks come from counting full blocks of the level below; those whose parent
    is full too are left to it.
    """
    side = 1 << dims
    level = rids(region, by=by).select(*by, F.lit(0).alias("level"), F.col("rid").alias("block_no"))
    parts = []
    for depth in range(levels + 1):
        parent = F.floor(F.col("block_no") / side).cast("bigint")
        full = level.groupBy(*by, parent.alias("block_no")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side).select(*by, F.lit(depth + 1).alias("level"), "block_no")
        if depth == levels:
            parts.append(level)
            break
        up = full.select(*by, F.col("block_no").alias("_parent"))
        parts.append(level.withColumn("_parent", parent).join(up, [*by, "_parent"], "left_anti").select(*by, "level", "block_no"))
        level = full
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_blocks(table: DataFrame, dims: int, by: tuple[str, ...] = ()) -> DataFrame:
    size = F.pow(F.lit(float(1 << dims)), F.col("level")).cast("bigint")
    return from_runs(table.select(*by, (F.col("block_no") * size).alias("start"), size.alias("len")), by=by)


def tree_levels(size: int, dims: int) -> int:
    """The least number of levels whose tree of 2^dims children a node holds ``size`` records."""
    levels = 1
    while 1 << dims * levels < size:
        levels += 1
    return levels


def _node(level: int, node: Column, word: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), node.alias("node"), F.bit_count(word).cast("bigint").alias("n"))


def _word_nodes(level: int, size: int) -> Column:
    """The nodes of ``size`` records each, fewer than 64, that lie in a word."""
    mask = F.lit((1 << size) - 1).cast("bigint")
    cut = lambda i: F.call_function("shiftrightunsigned", F.col("word"), i * size).bitwiseAND(mask)
    return F.transform(F.sequence(F.lit(0), F.lit(BITS // size - 1)), lambda i: _node(level, F.col("word_idx") * (BITS // size) + i, cut(i)))


def _level_counts(region: DataFrame, dims: int, levels: int) -> DataFrame:
    """(level, node, n) of the nodes below the root that have records: one aggregation, combined before its shuffle.

    Nodes of fewer records than a word has are cut out of it; a greater node adds up the words it holds.
    """
    told = [_word_nodes(level, 1 << dims * level) if dims * level < 6 else F.array(_node(level, F.shiftright("word_idx", dims * level - 6), F.col("word"))) for level in range(levels)]
    return region.select(F.explode(F.concat(*told)).alias("t")).select("t.*").where("n > 0").groupBy("level", "node").agg(F.sum("n").alias("n"))


def codes(region: DataFrame, dims: int, levels: int) -> DataFrame:
    """Tree form in codes: (level, node, code), a row for each child of the root and of every mixed node.

    A node of level l stands for the (2^dims)^l records from ``node`` times that many; code 0 is empty, 1 full, 2
    mixed. The root is on level ``levels`` and has no row; the domain ends with it. What is above a mixed node is
    mixed, so the counts alone tell which nodes have rows: one join, however many levels there are.
    """
    if levels < 1 or dims * levels > 62:
        raise ValueError("a tree has a level or more and at most 2^62 records")
    counts = _level_counts(region, dims, levels)
    whole = F.expr(f"shiftleft(1L, level * {dims})")
    mixed = counts.where((F.col("level") > 0) & (F.col("n") < whole)).select("level", "node")
    root = region.sparkSession.range(1).select(F.lit(levels).alias("level"), F.col("id").alias("node"))
    below = F.transform(F.sequence(F.lit(0), F.lit((1 << dims) - 1)), lambda i: F.col("node") * (1 << dims) + i)
    children = mixed.unionByName(root).select((F.col("level") - 1).alias("level"), F.explode(below).alias("node"))
    code = F.when(F.col("n").isNull(), 0).when(F.col("n") == whole, 1).otherwise(2)
    return children.join(counts, ["level", "node"], "left").select("level", "node", code.alias("code"))


def from_codes(table: DataFrame, dims: int) -> DataFrame:
    """Word table of a tree form in codes."""
    return from_blocks(table.where("code = 1").select("level", F.col("node").alias("block_no")), dims)


def traverse(table: DataFrame, dims: int, depth_first: bool = False) -> DataFrame:
    """The codes in order: by level from the root down, or each node before what is under it."""
    if not depth_first:
        return table.orderBy(F.desc("level"), "node")
    return table.orderBy(F.col("node") * F.pow(F.lit(2.0), F.col("level") * dims).cast("bigint"), F.desc("level"))


def id_list(region: DataFrame, inverted: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """List form, in chunks of 2^16 records: (chunk, inverted, deltas), where the first of a chunk is its own id.

    With ``inverted`` the list is of the complement, which is shorter for dense regions.
    """
    own = complement(region, whole) if inverted else region
    ids = rids(own).withColumn("chunk", F.floor(F.col("rid") / (1 << 16)))
    lists = ids.groupBy("chunk").agg(F.sort_array(F.collect_list("rid")).alias("ids"))
    deltas = F.transform("ids", lambda x, i: F.when(i == 0, x).otherwise(x - F.get(F.col("ids"), i - 1)))
    return lists.select("chunk", F.lit(inverted).alias("inverted"), deltas.alias("deltas"))


def from_id_list(table: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Word table of a list form; with the domain's spine ``whole``, of lists that are inverted."""
    deltas = table.select("chunk", F.posexplode("deltas").alias("place", "delta"))
    running = Window.partitionBy("chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = words(deltas.select(F.lit(0).alias("region_id"), F.sum("delta").over(running).alias("rid")), "rid").drop("region_id")
    return listed if whole is None else complement(listed, whole)


def sizes(region: DataFrame, dims: int = 2, levels: int = 3) -> DataFrame:
    """Bytes of a region in each form: list of 4-byte ids, 8-byte words, 8-byte runs, blocks of 9 bytes."""
    parts = [("list", rids(region), 4), ("bitmap", region, 8), ("runs", runs(region), 8), ("blocks", blocks(region, dims, levels), 9)]
    out = None
    for name, table, unit in parts:
        row = table.agg((F.count(F.lit(1)) * unit).alias("bytes")).select(F.lit(name).alias("form"), "bytes")
        out = row if out is None else out.unionByName(row)
    return out
