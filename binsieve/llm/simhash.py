"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are linked at ``radius`` or fewer differing bits. A fingerprint is cut into a ring of
``radius + 1`` segments. If two differ by at most ``radius`` bits, then from some segment on, every
chain of 1, 2, ... consecutive segments differs by no more than its share of the radius, rounded
down: no bit in the first, one in the first two, and so on. So both agree on the first segment of
that chain and on all but at most one bit of the second, which gives an equality key for each segment
and each bit of the next one left out; rows that share a key are compared chain by chain, and only
what stays within every budget is checked in full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of, unused_names, written
from binsieve.llm.components import components

#: Fingerprints compared with each other in one block of a bucket; larger buckets are dealt out by pairs of blocks.
BLOCK = 2048
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Odd multipliers that make further 64-bit hashes of a shingle's first one.
_AGAIN = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _shingle_hashes(text: str, shingle: int) -> list[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of one text in order, repeats included, by ``COUNT_ROWS``."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, stops[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    ends = stops[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    parts = []
    for at in range(0, n, COUNT_ROWS):
        some = [digest(line[a:b], 42) for a, b in zip(starts[at : min(n, at + COUNT_ROWS)].tolist(), ends[at : at + COUNT_ROWS].tolist())]
        parts.append(np.array(some, "<u8"))
    return parts


def _majority(parts: list[np.ndarray], tables: int) -> list[int]:
    """Fingerprints of the hashes in all ``parts``; those after the first are of hashes made from these by a multiplication and a fold."""
    count = np.zeros((tables, 64), np.int64)
    for hashes in parts:
        for k in range(tables):
            if k:
                hashes = hashes * np.uint64(_AGAIN[(k - 1) % 2])
                hashes ^= hashes >> np.uint64(29)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count[k] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > sum(map(len, parts)), axis=1, bitorder="little").view("<u8").ravel().tolist()


def simhashes(text: str, shingle: int, tables: int = 1) -> list[int]:
    """64-bit fingerprints of one text: majority bits of XXH64 (seed 42) over word shingles, repeats counted."""
    return _majority(_shingle_hashes(text, shingle), tables)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *parts]))


def _pieces(hashes: np.ndarray) -> list[np.ndarray]:
    return [hashes[at : at + COUNT_ROWS] for at in range(0, len(hashes), COUNT_ROWS)]


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The 64-bit hashes of all distinct shingles of one text, in order."""
    return _distinct(_shingle_hashes(text, shingle))


def simhash(text: str, shingle: int) -> int:
    """The first fingerprint of one text."""
    return simhashes(text, shingle)[0]


def shingle_sketch(text: str, shingle: int, size: int) -> bytes:
    """The ``size`` smallest distinct 32-bit shingle hashes in order: all of them, where there are no more."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh32_intdigest
    found = {digest(b" ".join(words[i : i + shingle]), 7) for i in range(n)}
    return np.sort(np.fromiter(found, "<u4", len(found)))[:size].tobytes()


def resemblance(a: bytes, b: bytes, size: int) -> float:
    """Jaccard similarity of two shingle sets by their sketches; exact where both sketches hold whole sets."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    union = np.union1d(x, y)
    if len(x) >= size or len(y) >= size:
        union = union[:size]
    return np.isin(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True).sum() / len(union)


def fingerprints(df: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is the 64-bit fingerprint as a signed long. No shuffle."""
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text"):
            found = np.array([simhash(t, shingle) for t in texts_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(radius: int) -> list[list[int]]:
    """The bits of each segment."""
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]


def chains(radius: int) -> list[list[tuple[int, int]]]:
    """For each first segment, the bit mask and budget of its chains of 1, 2, ... segments."""
    parts = ring(radius)
    m = len(parts)
    out = []
    for i in range(m):
        mask, own = 0, []
        for k in range(m):
            mask |= sum(1 << b for b in parts[(i + k) % m])
            own.append((mask, (k + 1) * radius // m))
        out.append(own)
    return out


def _linked_rows(groups: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal ``groups``, as pairs of row numbers.

    ``near(i, j)`` tells for two arrays of rows which pairs are links.
    """
    n = len(groups)
    parent = np.arange(n)
    begin, d = np.arange(n - 1), 1

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    while len(begin):
        begin = begin[begin + d < n]
        begin = begin[groups[begin] == groups[begin + d]]
        pairs = begin[parent[begin] != parent[begin + d]]
        joined = False
        for i in pairs[near(pairs, pairs + d)].tolist():
            a, b = find(i), find(i + d)
            if a != b:
                parent[max(a, b)] = min(a, b)
                joined = True
        while joined:
            flat = parent[parent]
            joined = bool((flat != parent).any())
            parent = flat
        d += 1
    off = np.flatnonzero(parent != np.arange(n))
    return off, parent[off]


def _dealt(rows: DataFrame, hot: DataFrame, node: str, tag: int) -> DataFrame:
    """Rows with the keys of hot buckets (key, blocks) replaced by one for each pair of blocks that a row takes part in.

    The lowest ``tag`` bits of a key tell its first segment, and stay.
    """
    zero = F.lit(0).cast("bigint")
    own = F.pmod(F.xxhash64(F.lit(7), node), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(own, x).alias("a"), F.greatest(own, x).alias("b")))
    dealt = F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array(F.struct(zero.alias("a"), zero.alias("b")))))
    names = [c for c in rows.columns if c != "key"]
    rows = rows.join(hot, "key", "left").select(*names, "key", F.coalesce("blocks", F.lit(1)).alias("blocks")).select(*names, "key", "blocks", dealt.alias("p"))
    salted = F.shiftleft(F.shiftright(F.xxhash64("key", "p.a", "p.b"), tag), tag).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << tag) - 1).cast("bigint")))
    return rows.select(*names, F.when(F.col("blocks") > 1, salted).otherwise(F.col("key")).alias("key"))


def _bucket_links(rows: DataFrame, columns: list[str], found) -> DataFrame:
    """Edges (u, v) that ``found(keys, *columns)`` gives, called with whole buckets of equal keys at a time."""

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in ["key", *columns]]

        def shown(part):
            u, v = found(*part)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ["key", *columns])]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole >= 1 << 16:
                yield shown([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield shown(held)

    dealt = rows.select("key", *columns).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Few and small rows over all shuffle partitions, before each becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly what links connect.

    Within a bucket of fingerprints that share a key, a spanning forest of its links stands for all
    of them, so a dense group of near copies gives no more rows than it has members and keys. A
    bucket of over ``BLOCK`` fingerprints is split into blocks, and each pair of blocks is compared
    by its own task, so no task holds more than two blocks of a bucket; no link is lost.
    """
    if not 1 <= radius <= 7:
        raise ValueError("radius must be from 1 to 7")
    parts = ring(radius)
    m = len(parts)

    def key(tag, masked):
        return F.shiftleft(F.shiftright(F.xxhash64(F.lit(tag), masked), 3), 3).bitwiseOR(F.lit(tag & 7).cast("bigint"))

    def left_out(i, of):
        """The keys of segment i and the next, one bit of the next left out."""
        nxt = parts[(i + 1) % m]
        both = sum(1 << b for b in parts[i] + nxt)
        return [key(8 * (b + 1) + i, of.bitwiseAND(F.lit(_signed(both & ~(1 << b))))) for b in nxt]

    fp = F.col("fp")
    pair_masks = [_signed(sum(1 << b for b in parts[i] + parts[(i + 1) % m])) for i in range(m)]
    exact = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(x)).alias("x")) for i, x in enumerate(pair_masks)])).alias("k"))
    large = exact.groupBy("k.i", "k.x").count().where(F.col("count") > BLOCK // 2)
    by_start = F.array()
    for i in range(m):
        by_start = F.when(F.col("i") == i, F.array(*left_out(i, F.col("x")))).otherwise(by_start) if i else F.when(F.col("i") == 0, F.array(*left_out(0, F.col("x"))))
    hot = large.select("count", F.explode(by_start).alias("key")).groupBy("key").agg(F.ceil((F.sum("count") + BLOCK // 2) / BLOCK).cast("int").alias("blocks"))
    hot = written(hot, "hot-buckets")
    rows = _spread(distinct, "fp").select("fp", F.explode(F.array(*[k for i in range(m) for k in left_out(i, fp)])).alias("key"))
    if not hot.isEmpty():
        rows = _dealt(rows, hot, "fp", 3)
    tests = [(np.array([own[k][0] for own in chains(radius)] + [0] * (8 - m), np.uint64), (k + 1) * radius // m) for k in range(m)]

    def found(keys, fps):
        bits, starts = fps.view(np.uint64), (keys & 7).astype(np.int64)

        def near(i, j):
            differ = bits[i] ^ bits[j]
            keep = np.ones(len(i), bool)
            for masks, budget in tests:
                keep[keep] = np.bitwise_count(differ[keep] & masks[starts[i[keep]]]) <= budget
            return keep

        a, b = _linked_rows(keys, near)
        return fps[a], fps[b]

    return _bucket_links(rows, ["fp"], found)


def _named(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, name) of every distinct fingerprint: the smallest ``first`` that edges (u, v) reach."""
    roots = written(components(edges), "roots")
    known = roots.join(firsts.select("fp", "first"), roots["node"] == firsts["fp"]).select("node", "root", "first")
    smallest = written(known.groupBy("root").agg(F.min("first").alias("name")), "component-names")
    named = written(roots.join(smallest, "root").select(F.col("node").alias("fp"), "name"), "named")
    return written(firsts.select("fp", "first").join(named, "fp", "left").select("fp", F.coalesce("name", "first").alias("name")), "labels")


def simhash_components(df: DataFrame, shingle: int = 5, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint and component of every row: (id column, ``fingerprint``, ``component_id``).

    Words are split at ASCII white space after lower-casing A-Z; a text of fewer words than a shingle
    is one shingle, one without words (null, empty) has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest id that links reach, the row's own included. Rows whose
    fingerprints are equal are one node, so copies cost nothing; a null id takes part, but names a
    component only where no other id does. One row out for each row in; other columns are dropped.
    """
    held = written(fingerprints(df, shingle, id_column, text_column), "fingerprints")
    firsts = written(held.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = _named(firsts, written(links(firsts.select("fp"), radius), "links"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return held.join(labels, "fp").select(F.col("id").alias(id_column), shown.alias("fingerprint"), F.col("name").alias("component_id"))


#: Segments of a ring, the shingles that each is the SimHash of, and the bits of a segment that chains compare.
SEGMENTS, DRAWN, BOX = 16, 5, 16
#: Standard deviations by which the radius exceeds the mean distance of two texts that are just similar enough.
MARGIN = 3.3
#: The texts of one block of a large group, and those that all its blocks hold.
GROUP, PIVOTS = 512, 8
_DRAWS = np.array([xxhash.xxh64_intdigest(bytes([k]), 11) | 1 for k in range(SEGMENTS * DRAWN)], np.uint64)


def drawn(parts: list[np.ndarray]) -> np.ndarray:
    """For each of ``SEGMENTS`` x ``DRAWN`` permutations, the least hash that a text's shingles have under it.

    Two texts agree on a draw with a probability that is the similarity of their shingle sets.
    """
    least = np.full(len(_DRAWS), np.iinfo(np.uint64).max, np.uint64)
    for hashes in parts:
        for at in range(0, len(hashes), 4096):
            np.minimum(least, np.multiply.outer(_DRAWS, hashes[at : at + 4096]).min(axis=1), out=least)
    return least


def rings(draws: np.ndarray) -> np.ndarray:
    """The segments of each row of draws: the SimHash, or bitwise majority, of every ``DRAWN`` of them, hashed again as least hashes have few high bits."""
    mixed = draws * np.uint64(_AGAIN[0])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_AGAIN[1])
    mixed ^= mixed >> np.uint64(32)
    a, b, c, d, e = np.moveaxis(mixed.reshape(-1, SEGMENTS, DRAWN), 2, 0)
    sum1, carry1 = a ^ b ^ c, a & b | c & (a | b)
    sum2, carry2 = sum1 ^ d ^ e, sum1 & d | e & (sum1 | d)
    return carry1 & carry2 | (carry1 | carry2) & sum2


def ring_radius(similarity: float) -> int:
    """The bits, of ``SEGMENTS`` x ``BOX``, by which rings of texts of this similarity differ at most, but for one pair in some hundreds."""

    def odds(n, k, p):
        return math.comb(n, k) * p**k * (1 - p) ** (n - k)

    def differs(common):
        """A majority bit's odds to differ where so many draws agree."""
        wins = [(odds(common, x, 0.5), sum(odds(DRAWN - common, y, 0.5) for y in range(DRAWN - common + 1) if 2 * (x + y) > DRAWN)) for x in range(common + 1)]
        return sum(p * 2 * q * (1 - q) for p, q in wins)

    by_common = [(odds(DRAWN, c, similarity), differs(c)) for c in range(DRAWN + 1)]
    mean = sum(p * f for p, f in by_common)
    variance = sum(p * (BOX * f * (1 - f) + (BOX * (f - mean)) ** 2) for p, f in by_common)
    return math.ceil(SEGMENTS * BOX * mean + MARGIN * math.sqrt(SEGMENTS * variance))


def ring_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between rows (node, ring): rings within ``radius`` bits, found where a segment is equal.

    An equal segment is an exact key of 64 bits, so buckets hold texts that are alike, and not texts
    that share a few bits by chance however many there are. From that segment on, every chain of 1, 2, ...
    segments has to stay within its share of the radius, and so the whole ring within all of it. As in
    ``links`` a forest stands for a bucket's links, and large buckets are dealt out by pairs of blocks.
    """
    tag = 4
    segment = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: F.shiftleft(F.shiftright(F.xxhash64(i, F.get("ring", i)), tag), tag).bitwiseOR(i.cast("bigint")))
    box = (1 << BOX) - 1
    words = 64 // BOX
    boxes = [F.expr("|".join(f"shiftleft(ring[{i}] & {box}, {BOX * k})" for k, i in enumerate(range(at, at + words)))).alias(f"w{at // words}") for at in range(0, SEGMENTS, words)]
    names = [f"w{k}" for k in range(SEGMENTS // words)]
    spread = _spread(distinct, "node")
    hot = spread.select(F.explode(segment).alias("key")).groupBy("key").count().where(F.col("count") > BLOCK)
    hot = written(hot.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-segments")
    rows = spread.select("node", *boxes, F.explode(segment).alias("key"))
    if not hot.isEmpty():
        rows = _dealt(rows, hot, "node", tag)
    budgets = np.arange(1, SEGMENTS + 1) * radius // SEGMENTS
    turns = (np.arange(SEGMENTS)[:, None] + np.arange(SEGMENTS)) % SEGMENTS

    def found(keys, nodes, *words):
        bits, starts = np.stack(words, axis=1).view(np.uint64), (keys & (1 << tag) - 1).astype(np.int64)

        def near(i, j):
            differ = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint16))
            chains = np.cumsum(np.take_along_axis(differ, turns[starts[i]], axis=1), axis=1, dtype=np.int64)
            return (chains <= budgets).all(axis=1)

        a, b = _linked_rows(keys, near)
        return nodes[a], nodes[b]

    return _bucket_links(rows, ["node", *names], found)


def _confirmed(nodes: list[int], labels: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes of similarity or more that connect what all such pairs connect.

    Every pair is tested on its whole sets, but for those already in one component: equal ``labels``
    say so at the start, and found links from then on.
    """
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    sizes = np.array([len(x) for x in sets])
    own = np.split(flat, np.cumsum(sizes)[:-1])
    part = np.unique(np.array(labels), return_inverse=True)[1]
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    out = []
    for i in range(len(nodes) - 1):
        rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) / np.maximum(1, np.maximum(sizes[rest], sizes[i])) >= similarity]
        if not len(rest):
            continue
        mark[own[i]] = True
        shared = np.append(0, np.cumsum(mark[np.concatenate([own[j] for j in rest.tolist()])]))
        mark[own[i]] = False
        shared = np.diff(shared[np.append(0, np.cumsum(sizes[rest]))])
        alike = rest[shared / (sizes[i] + sizes[rest] - shared) >= similarity]
        joined, one_of = np.unique(part[alike], return_index=True)
        out += [(nodes[i], nodes[j]) for j in alike[one_of].tolist()]
        part[np.isin(part, joined)] = part[i]
    return out


def _near_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that stand among the rows (chunk, node, label, shingles) of each chunk."""

    def run(batches):
        at, held = None, {}

        def found():
            nodes = sorted(held)
            return _confirmed(nodes, [held[x][0] for x in nodes], [np.frombuffer(held[x][1], "<u8") for x in nodes], similarity) if len(nodes) > 1 else []

        def shown(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            pairs = []
            for chunk, node, label, shingles in zip(*(batch.column(c).to_pylist() for c in ("chunk", "node", "label", "shingles"))):
                if chunk != at:
                    pairs += found()
                    at, held = chunk, {}
                held[node] = (label, shingles)
            yield shown(pairs)
        yield shown(found())

    return rows.select("chunk", "node", "label", "shingles").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "u bigint, v bigint")


def _group_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) that connect what all pairs of ``similarity`` or more inside each candidate group connect.

    ``sets`` holds (node, root, blocks, shingles), where ``blocks`` is more than one for a group of over
    ``GROUP`` nodes. Such a group is tested block by block, with a few of its nodes, the pivots, in every
    block, so that a dense group becomes one component at once. Then what isn't in its largest
    component is tested against all of it, by pairs of blocks: no pair that could join two components is left out.
    """
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - F.lit(1).cast("bigint"))
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))
    large = sets.where("blocks > 1")
    pivots = large.groupBy("root", F.pmod(F.xxhash64(F.lit(6), "node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("node")).select("node")
    everywhere = large.join(pivots, "node").select("node", "root", F.explode(upto("blocks")).alias("block"), "shingles")
    first = sets.select("node", "root", own.alias("block"), "shingles").union(everywhere)
    found = written(_near_links(first.select(F.xxhash64("root", "block").alias("chunk"), "node", F.col("node").alias("label"), "shingles"), similarity), "near-links")
    members = written(large.select("node", "root"), "large-groups")
    if members.isEmpty():
        return found
    inside = found.join(members.select(F.col("node").alias("u")), "u", "left_semi")
    known = components(inside).select("node", F.col("root").alias("known"))
    labels = written(members.join(known, "node", "left").select("node", "root", F.coalesce("known", "node").alias("label")), "large-labels")
    counts = labels.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("root").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("total")).where("total > most.n")
    blocks = lambda n: F.ceil(n / GROUP).cast("int")
    most = written(most.select("root", F.col("most.label").alias("main"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("total") - F.col("most.n")).alias("others")), "open-groups")
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    of = lambda n: F.pmod(F.xxhash64(F.lit(7), "node"), F.col(n))
    main = F.transform(upto("others"), lambda x: pair(1, of("mains"), x))
    other = F.concat(F.transform(upto("mains"), lambda x: pair(1, x, of("others"))), F.transform(upto("others"), lambda x: pair(0, F.least(of("others"), x), F.greatest(of("others"), x))))
    dealt = labels.join(most, "root").select("node", "root", "label", F.explode(F.when(F.col("label") == F.col("main"), main).otherwise(other)).alias("p"))
    dealt = written(dealt.select("node", "label", F.xxhash64("root", "p.kind", "p.a", "p.b").alias("chunk")), "open-blocks")
    return found.union(written(_near_links(dealt.join(sets.select("node", "shingles"), "node"), similarity), "more-near-links"))


def near_duplicate_groups(df: DataFrame, key_column: str, text_column: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, name) of every row: ``name`` is the smallest key of its group of near copies.

    Texts of equal shingle sets are copies. Two texts are near copies if their whole shingle sets are
    alike by ``similarity`` or more, and groups are closed under that. Pairs are proposed by rings: one
    64-bit SimHash of all shingles of a text differs in 15 % of its bits between texts of similarity 0.8,
    so no radius with selective keys would find them; a ring has ``SEGMENTS`` SimHashes, each over ``DRAWN`` shingles
    drawn minwise, of which some are equal. At 0.8, 997 pairs in 1000 are proposed, and more above it. Proposals
    make candidate groups, and inside each of them all pairs that could still join two components are tested exactly.
    Sets are made of texts in candidate groups only, one for each distinct set. Keys may be of any type that
    has an order, structs included. Null and empty texts have the empty set and are copies of each other.
    """
    if similarity < 0.75:
        raise ValueError("rings propose enough pairs from a similarity of 0.75 on")
    text = F.col(text_column).cast("string")
    source = df.select(F.col(key_column).alias("id"), text.alias("text"), F.xxhash64(F.col(key_column), text).alias("row"))

    def class_of(found):
        return xxhash.xxh64_intdigest(found.tobytes(), 3)

    def run(batches):
        for batch in sliced(batches, "text"):
            # Over distinct shingles, as similarity is: a line said often has no more say than one said once.
            sets = [_distinct(_shingle_hashes(t, shingle)) for t in texts_of(batch, "text")]
            found = rings(np.array([drawn([x]) for x in sets], np.uint64)).view(np.int64)
            classes = np.array([class_of(x) for x in sets], np.uint64).view(np.int64)
            ring_of = pa.ListArray.from_arrays(np.arange(0, found.size + 1, SEGMENTS, dtype=np.int32), pa.array(np.ascontiguousarray(found).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(classes), ring_of], names=["id", "row", "fp", "ring"])

    held = written(source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, row bigint, fp bigint, ring array<bigint>"), "set-rings")
    # Equal sets have equal rings, so any row of a class names its ring.
    firsts = written(held.groupBy("fp").agg(F.min("id").alias("first"), F.min(F.struct("row", "ring")).alias("any")).select("fp", "first", "any.row", "any.ring"), "distinct-sets")
    near = written(ring_links(firsts.select(F.col("fp").alias("node"), "ring"), ring_radius(similarity)).distinct(), "candidates")
    groups = written(components(near), "candidate-groups")
    sizes = written(groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks")), "candidate-sizes")
    members = written(groups.join(sizes, "root").join(firsts.select(F.col("fp").alias("node"), "row"), "node").select("row", "node", "root", "blocks"), "candidate-members")

    def whole(batches):
        seen = set()
        for batch in sliced(batches, "text"):
            rows = []
            for i, (text, node) in enumerate(zip(texts_of(batch, "text"), batch.column("node").to_pylist())):
                # Rows of equal id and text come more than once; a class is named by its own set only.
                if node not in seen and class_of(found := shingle_set(text, shingle)) == node % (1 << 64):
                    seen.add(node)
                    rows.append((i, found.tobytes()))
            own = batch.select(["node", "root", "blocks"]).take(pa.array([i for i, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x for _, x in rows], pa.binary())], names=["node", "root", "blocks", "shingles"])

    texts = source.select("row", "text").join(members, "row").select("node", "root", "blocks", "text")
    sets = written(texts.mapInArrow(whole, "node bigint, root bigint, blocks int, shingles binary"), "shingle-sets")
    labels = _named(firsts, _group_links(sets, similarity))
    return held.select("id", "fp").join(labels, "fp").select(F.col("id").alias(key_column), "name")


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Keep one row of each group of near copies: the one of the smallest (id, hash of the text).

    All columns are kept, whatever their names. A null id is smaller than any other. Of rows that have
    the same id and text, one stays, found by a map-side aggregation.
    """
    names = df.columns
    key, own_id, own_hash, text_hash = unused_names(names, "key", "id", "hash", "text_hash")
    hashed = F.xxhash64(F.col(text_column))
    keyed = df.select(F.struct(F.col(id_column).alias("id"), hashed.alias("hash")).alias(key), F.col(text_column))
    groups = written(near_duplicate_groups(keyed, key, text_column, **options), "near-groups")
    first = F.col(key).eqNullSafe(F.col("name"))
    dropped = groups.where(~first).select(key).distinct()
    again = written(groups.where(first).groupBy(key).count().where("count > 1").select(key), "repeated-rows")
    parts = lambda x: x.select(F.col(f"{key}.id").alias(own_id), F.col(f"{key}.hash").alias(own_hash))
    match = F.col(id_column).eqNullSafe(F.col(own_id)) & (F.col(text_hash) == F.col(own_hash))
    kept = df.withColumn(text_hash, hashed).join(parts(dropped), match, "left_anti")
    if again.isEmpty():
        return kept.select(names)
    repeated = kept.join(parts(again), match, "left_semi").groupBy(id_column, text_hash).agg(F.min(F.struct(names)).alias(key)).select(f"{key}.*")
    return kept.join(parts(again), match, "left_anti").select(names).unionByName(repeated.select(names))
