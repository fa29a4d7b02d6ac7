"""Pattern packing of documents into fixed-length sequences.

Pieces of one length are alike, so what is packed is the histogram of lengths. Patterns of a few
lengths that fill a sequence are enumerated, how often each is repeated is fitted to the histogram by
non-negative least squares, the counts are rounded down to what the histogram holds, and what is left
is packed by best fit, again with repeated patterns. All of that takes time by the number of lengths,
whatever the number of documents. Pieces then find their places by their rank among the pieces of
their length, without ever being gathered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of, written
from binsieve.llm.encoding import byte_encoder, packed, shared_classes

#: Triples considered for each longest length, the fullest histogram bins first.
TRIPLES = 6
FIT_ROUNDS = 300

Plan = list[tuple[tuple[int, ...], int]]


def _patterns(have: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Patterns of one, two and three lengths that fill a sequence exactly."""
    some = set(np.flatnonzero(have).tolist())
    out: list[tuple[int, ...]] = [(limit,)] if limit in some else []
    by_count = sorted(some, key=lambda n: (-have[n], n))
    for a in sorted(some, reverse=True):
        if a <= limit - a and limit - a in some:
            out.append((limit - a, a))
        found = 0
        for b in by_count:
            c = limit - a - b
            if c in some and a >= b >= c > 0:
                out.append((a, b, c))
                found += 1
                if found == TRIPLES:
                    break
    return out


def _fit(patterns: list[tuple[int, ...]], have: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - have|, by accelerated projected gradients."""
    width = max(map(len, patterns))
    table = np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        table[i, : len(p)] = p
    weight = (table > 0).astype(float)
    scale = have.max()
    goal = have / scale
    # The norm of A is at most the root of its largest column sum times its largest row sum.
    rows = np.bincount(table.ravel(), weight.ravel(), len(have))
    rate = 1 / max(1.0, weight.sum(1).max() * rows.max())
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(FIT_ROUNDS):
        off = np.bincount(table.ravel(), (weight * y[:, None]).ravel(), len(have)) - goal
        new = np.maximum(0, y - rate * (off[table] * weight).sum(1))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x * scale


def plan(histogram: dict[int, int], limit: int) -> Plan:
    """Patterns with repeat counts that use up the histogram exactly."""
    have = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    out: Plan = []
    patterns = _patterns(have, limit)
    if patterns:
        for k in np.argsort(-(counts := _fit(patterns, have)), kind="stable"):
            own = dict.fromkeys(patterns[k], 0)
            for n in patterns[k]:
                own[n] += 1
            n = min(int(counts[k]), *(int(have[a]) // m for a, m in own.items()))
            if n:
                out.append((patterns[k], n))
                for a, m in own.items():
                    have[a] -= n * m
    left = [int(n) for n in have]
    mask = sum(1 << a for a, n in enumerate(left) if n)
    while mask:
        own, room, seen = [], limit, mask
        used: dict[int, int] = {}
        while fits := seen & ((1 << room + 1) - 1):
            a = fits.bit_length() - 1  # the longest that fits
            own.append(a)
            used[a] = used.get(a, 0) + 1
            room -= a
            if used[a] == left[a]:
                seen &= ~(1 << a)
        n = min(left[a] // m for a, m in used.items())
        out.append((tuple(own), n))
        for a, m in used.items():
            left[a] -= n * m
            if not left[a]:
                mask &= ~(1 << a)
    return out


def places(made: Plan, limit: int) -> tuple[np.ndarray, ...]:
    """For each slot of the plan, sorted by length: length, ranks before it, first sequence, offset in it."""
    slots, sequence = [], 0
    for pattern, n in made:
        offset = 0
        for length in pattern:
            slots.append((length, n, sequence, offset))
            offset += length
        sequence += n
    table = np.array(sorted(slots) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    before = np.cumsum(table[:, 1]) - table[:, 1]
    first = np.searchsorted(table[:, 0], np.arange(limit + 2))
    return first, before, table[:, 2], table[:, 3]


def pieces(df: DataFrame, tokenizer: str, limit: int, end_id: int, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token pieces of each document: ids and an end id; over ``limit``, a shorter piece and full ones.

    A null or empty text is one piece of just the end id. ``pid`` numbers the task that made a row.
    """
    classes = shared_classes(df.sparkSession)
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    tail = packed([end_id])

    def run(batches):
        encoder, pid = byte_encoder(tokenizer, classes.value), TaskContext.get().partitionId()
        for batch in sliced(batches, "text"):
            own, rows, held = [], [], []
            for i, ids in enumerate(encoder.encode(texts_of(batch, "text"))):
                ids += tail
                n = len(ids) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own.append(i)
                    piece = ids[4 * a : 4 * b]
                    rows.append((k, a, b - a, zlib.crc32(piece)))
                    if keep_ids:
                        held.append(np.frombuffer(piece, "<i4"))
            table = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch.column("id").take(pa.array(own, pa.int32())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, j])) for j in (1, 2, 3)), pa.array(np.full(len(own), pid, np.int32))]
            names = ["id", "piece", "start", "length", "ids_crc32", "pid"]
            if keep_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, pid int" + (", ids array<int>" if keep_ids else ""))


def pack(made: DataFrame, limit: int) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset`` there; ``made`` is a written table of pieces.

    Counts by task and length grow with the number of tasks, so they are merged with the pieces, which the
    ranks in a task have already put in that order, and not broadcast.

    The driver sees the histogram of lengths alone (at most ``limit`` rows). A piece's rank among
    those of its length is its rank in its task plus the counts of the tasks before; so no length,
    however common, comes to one task.
    """
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    slots = made.sparkSession.sparkContext.broadcast(places(plan(histogram, limit), limit))
    counts = made.groupBy("pid", "length").count()
    base = F.sum("count").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    base = written(counts.select("pid", "length", F.coalesce(base, F.lit(0)).alias("base")), "piece-ranks")
    own = F.row_number().over(Window.partitionBy("pid", "length").orderBy("id", "piece", "ids_crc32", "start")) - 1
    ranked = made.withColumn("own", own).join(base.hint("merge"), ["pid", "length"]).withColumn("rank", F.col("own") + F.col("base")).drop("own", "base", "pid")

    def run(batches):
        first, before, sequence, offset = slots.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            # ranks count within a length; before counts over all shorter ones too
            slot = np.searchsorted(before, rank + before[first[length]], side="right") - 1
            at = rank + before[first[length]] - before[slot]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence[slot] + at), pa.array(offset[slot])], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``limit`` tokens as the plan finds.

    Returns per piece: id column, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``, and with ``keep_ids`` the ``ids``. Rows with equal ids, null ids and null texts are
    packed like any other; an empty table gives no rows; other columns are dropped.
    """
    made = written(pieces(df, tokenizer, limit, end_id, id_column, text_column, keep_ids), "pieces")
    out = pack(made, limit)
    return out.select(F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
