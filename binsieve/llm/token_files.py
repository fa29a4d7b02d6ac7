"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A block holds consecutive documents: a header, the Elias-Fano code of their ids less the first one's, the
Elias-Fano code of where each document's token ids end, and all token ids at the narrowest of 16 or
32 bits that holds the vocabulary; no number of 64 bits but for the first document's id. Blocks are rows of a Parquet
table, so that any storage Spark writes to holds them and tasks that are lost write nothing twice.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of
from binsieve.llm.encoding import kept, packed, shared_classes, word_encoder
from binsieve.sources.scratch import scratch_path

MAGIC = b"BSTOKEN2"
#: A block is closed at so many ids or documents; a longer document has a block of its own. Blocks of 16 bits an id are then
#: under half a region of a small heap, so that the JVM frees them young; larger ones pile up until a whole marking.
BLOCK_IDS, BLOCK_DOCS = 1 << 17, 1 << 16
#: Pages and row groups are closed after the block that fills them. Parquet asks for their size first at 100 rows else, and
#: a task would hold all its blocks at once, when writing them and when reading them.
STORED = {"compression": "zstd", "parquet.block.size": str(1 << 23), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: One select sample for so many documents.
SAMPLE = 256
#: Documents of a block have ids that differ by less than this.
BLOCK_SPREAD = 1 << 62
#: Bytes of text that make a shard, the most shards, and the ranges of ids that shards are put together from.
SHARD_BYTES, SHARDS, RANGES = 1 << 25, 1 << 13, 1 << 14
_HEADER = struct.Struct("<8sBBBHIQqIIIIIII")


class EliasFano:
    """A non-decreasing sequence in n (2 + log2(u / n)) bits and a little, with constant-time access.

    ``low`` has the low bits of each value, ``high`` the rest in unary, ``samples`` where the bit of
    every 256th value stands in ``high``.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        width = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        lows = (values[:, None] >> np.arange(width)) & 1
        at = (values >> width) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, width, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        begin = i * self.width
        some = int.from_bytes(self.low[begin >> 3 : (begin + self.width + 7) >> 3].tobytes(), "little")
        return some >> (begin & 7) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value i: from its sample on, bytes are skipped by their bit counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, skip = at >> 3, (1 << (at & 7) + 1) - 1
            bits = int(self.high[byte]) & ~skip
            while (own := bits.bit_count()) < left:
                left -= own
                byte += 1
                bits = int(self.high[byte])
            for _ in range(left - 1):
                bits &= bits - 1
            at = (byte << 3) + (bits & -bits).bit_length() - 1
        return (at - i << self.width) | self._low(i)

    def selects(self, numbers: np.ndarray) -> np.ndarray:
        """Values of many numbers: counts of set bits by byte tell each one's byte, and a table of bytes its bit."""
        numbers = np.asarray(numbers, np.int64)
        if len(numbers) and not 0 <= numbers.min() <= numbers.max() < self.n:
            raise IndexError("no such value")
        before = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        byte = np.searchsorted(before, numbers, "right")
        left = numbers - np.where(byte > 0, before[byte - 1], 0)
        at = (byte << 3) + _bit_places()[self.high[byte], left]
        out = at - numbers << self.width
        places, low = numbers * self.width, np.zeros(len(numbers), np.int64)
        for k in range(self.width):
            low |= ((self.low[places + k >> 3] >> (places + k & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out | low

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()

    def values(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return (at - np.arange(self.n) << self.width) + (bits << np.arange(self.width)).sum(1)


def _bit_places() -> np.ndarray:
    """Where the j-th set bit of each byte stands."""

    def made():
        table = np.zeros((256, 8), np.int64)
        for byte in range(256):
            places = [k for k in range(8) if byte >> k & 1]
            table[byte, : len(places)] = places
        return table

    return kept("bit-places", made)


def block_bytes(doc_ids: np.ndarray, known: np.ndarray, ids: list[bytes], wide: bool) -> bytes:
    """The bytes of one block; ``ids`` has each document's token ids, ``known`` which doc ids are not null.

    Known doc ids have to ascend. An id that doesn't fit 16 bits in a narrow block is an error.
    """
    tokens = np.frombuffer(b"".join(ids), "<u4")
    if not wide and len(tokens) and tokens.max() > 0xFFFF:
        raise ValueError(f"token id {tokens.max()} needs more than 16 bits")
    own = doc_ids[known].astype(np.int64)
    first = int(own[0]) if len(own) else 0
    if (own[1:] < own[:-1]).any() or len(own) and int(own[-1]) - first >= BLOCK_SPREAD:
        raise ValueError("document ids of a block have to ascend, by less than 2^62 in all")
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids]))
    docs = EliasFano.of(own - first)
    parts = [*docs.bytes(), *ends.bytes(), tokens.astype("<u4" if wide else "<u2").tobytes()]
    head = _HEADER.pack(MAGIC, 4 if wide else 2, ends.width, docs.width, SAMPLE, len(ids), len(tokens), first, len(own), *map(len, parts[:6]))
    return b"".join([head, np.packbits(known).tobytes(), *parts])


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, EliasFano, np.ndarray]:
    """(doc ids, which are not null, boundaries, token ids) of a block."""
    if len(data) < _HEADER.size or not data.startswith(MAGIC):
        raise ValueError("not a block of token ids")
    _, size, width, doc_width, _, n, n_tokens, first, n_own, *lengths = _HEADER.unpack_from(data)
    at = _HEADER.size
    parts = []
    for length, kind in zip(((n + 7) // 8, *lengths, n_tokens * size), (np.uint8, np.uint8, np.uint8, "<u4", np.uint8, np.uint8, "<u4", f"<u{size}")):
        parts.append(np.frombuffer(data, kind, length // np.dtype(kind).itemsize, at))
        at += length
    if at != len(data):
        raise ValueError("a block of token ids has the wrong length")
    known = np.unpackbits(parts[0])[:n].astype(bool)
    doc_ids = np.zeros(n, np.int64)
    doc_ids[known] = EliasFano(n_own, doc_width, *parts[1:4]).selects(np.arange(n_own)) + first
    return doc_ids, known, EliasFano(n, width, *parts[4:7]), parts[7]


def highest_id(tokenizer: str) -> int:
    """The largest id a tokenizer file can give."""
    with open(tokenizer, encoding="utf-8") as f:
        file = json.load(f)
    return max([*file["model"]["vocab"].values(), *(x["id"] for x in file["added_tokens"])])


def shard_bounds(source: DataFrame, shards: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of ranges of ids, and each range's shard: consecutive ranges of about equal bytes of text in all.

    Ranges have about equal numbers of documents, by approximate quantiles of the whole column; then
    bytes are added up by range. The driver sees a number for each of at most ``RANGES`` ranges.
    """
    n = source.count()
    ranges = max(1, min(RANGES, n // 8))
    cuts = source.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 2 * RANGES)).first()[0] if ranges > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    def weigh(batches):
        held = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            own = batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            np.add.at(held, np.searchsorted(bounds, own, side="right"), batch.column("size").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], names=["range", "size"])

    sized = source.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"))
    size = np.zeros(len(bounds) + 1, np.int64)
    for r in sized.mapInArrow(weigh, "range bigint, size bigint").groupBy("range").agg(F.sum("size").alias("size")).collect():
        size[r["range"]] = r["size"]
    total = max(1, int(size.sum()))
    shards = shards or max(1, min(SHARDS, -(-total // SHARD_BYTES)))
    middle = np.cumsum(size) - size // 2
    return bounds, np.unique(np.minimum(shards - 1, (middle / total * shards).astype(np.int64)), return_inverse=True)[1]


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, wide: bool | None = None, shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode all documents and write their ids in ascending id order (null first).

    Shards are ranges of ids with about equal bytes of text, as many as the text's size asks for; one
    shuffle carries the encoded ids to a task for each shard, which writes it in order, block by block. Documents with
    equal ids stand side by side, by their token ids. Ids have 16 bits where the vocabulary and ``end_id`` allow
    it, else 32; ``wide`` asks for one of them, and 16 bits for a vocabulary that needs more is an error.
    """
    classes = shared_classes(df.sparkSession)
    source = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    large = max(highest_id(tokenizer), end_id) > 0xFFFF
    if wide is False and large:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    wide = large if wide is None else wide
    bounds, shard_of = shard_bounds(source, shards)
    tail = packed([end_id])

    def encode(batches):
        encoder = word_encoder(tokenizer, classes.value)
        for batch in sliced(batches, "text"):
            ids = [x + tail for x in encoder.encode(texts_of(batch, "text"))]
            if not wide:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            own = batch.column("id")
            at = np.searchsorted(bounds, own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(shard_of[at].astype(np.int32)), own, pa.array(ids, pa.binary())], names=["shard", "id", "ids"])

    def blocks(batches):
        shard, block, first = None, 0, 0
        doc_ids: list = []
        held: list[bytes] = []
        size, least = 0, None

        def out():
            nonlocal doc_ids, held, size, block, first, least
            known = np.array([x is not None for x in doc_ids])
            data = block_bytes(np.array([x or 0 for x in doc_ids], np.int64), known, held, wide)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "first", "n_ids", "data"])
            block, first = block + 1, first + size
            doc_ids, held, size, least = [], [], 0, None
            return row

        for batch in sliced(batches, "ids"):
            for s, i, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "ids"))):
                if held and (s != shard or size >= BLOCK_IDS or len(held) >= BLOCK_DOCS or least is not None and i - least >= BLOCK_SPREAD):
                    yield out()
                if s != shard:
                    shard, block, first = s, 0, 0
                least = i if least is None else least
                doc_ids.append(i)
                held.append(ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                size += len(held[-1]) // 4
        if held:
            yield out()

    # A task for each shard, by its number: a hash of so few numbers would give some tasks several and others none.
    dealt = source.mapInArrow(encode, "shard int, id bigint, ids binary").repartitionById(int(shard_of.max()) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    dealt.mapInArrow(blocks, "shard int, block int, first bigint, n_ids bigint, data binary").write.options(**STORED).parquet(path)


def read_token_files(spark, path: str, id_column: str = "doc_id", keep_ids: bool = False, only: list[int] | None = None) -> DataFrame:
    """Each document of the files: id, ``start`` among all ids, ``n_tokens``, ``ids_crc32``, optionally ``ids``.

    Boundaries come from the select structure of each block. With ``only``, documents of these ids are selected one by one.
    The files' manifest is the number of ids of each shard, which is as many numbers as there are shards.
    """
    files = spark.read.schema("shard int, block int, first bigint, n_ids bigint, data binary").parquet(path)
    sizes = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(sizes):
        before[shard] = total
        total += sizes[shard]

    wanted = None if only is None else np.unique(np.array(only, np.int64))

    def run(batches):
        for batch in sliced(batches, "data"):
            for shard, first, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "data"))):
                doc_ids, known, code, tokens = read_block(data)
                if wanted is None:
                    ends = code.selects(np.arange(code.n))
                    starts = np.append(0, ends[:-1])
                else:
                    own = np.flatnonzero(known & np.isin(doc_ids, wanted))
                    ends = np.array([code.select(i) for i in own.tolist()], np.int64)
                    starts = np.array([code.select(i - 1) if i else 0 for i in own.tolist()], np.int64)
                    doc_ids, known = doc_ids[own], known[own]
                # Whole blocks are widened at once, single documents alone.
                full = tokens.astype("<u4") if wanted is None else tokens
                crc = np.array([zlib.crc32(full[a:b].astype("<u4", copy=False)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
                columns = [pa.array(doc_ids, mask=~known), pa.array(starts + first + before[shard]), pa.array(ends - starts), pa.array(crc)]
                if keep_ids:
                    columns.append(pa.array([full[a:b].astype(np.int32) for a, b in zip(starts, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return files.select("shard", "first", "data").mapInArrow(run, f"`{id_column}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else ""))


def token_files_round_trip(df: DataFrame, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the token files of a table to the shared folder and read every document back from them.

    A null or empty text has the end id alone; an empty table gives no rows; other columns are dropped.
    """
    path = scratch_path(df.sparkSession, "token-files")
    write_token_files(df, path, tokenizer, end_id, id_column=id_column, text_column=text_column)
    return read_token_files(df.sparkSession, path, id_column)
