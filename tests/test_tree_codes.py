"""Trees in codes, grids in Z-order, key limits, conversions, and the command line."""

import io
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from binsieve.__main__ import main
from binsieve.functions import bits
from binsieve.functions.binning import Sigbits
from binsieve.functions.types import universal
from binsieve.operators import regions


def plain_codes(records, dims, levels):
    """By going down from the root."""
    side, out, todo = 1 << dims, {}, [(levels, 0)]
    while todo:
        level, node = todo.pop()
        for child in range(node * side, node * side + side):
            size = side ** (level - 1)
            n = len(records & set(range(child * size, child * size + size)))
            out[level - 1, child] = 0 if not n else 1 if n == size else 2
            if out[level - 1, child] == 2:
                todo.append((level - 1, child))
    return out


def region(spark, records):
    rows = spark.createDataFrame([(0, r) for r in sorted(records)], "region_id int, rid bigint")
    return regions.words(rows, "rid").select("word_idx", "word")


@pytest.mark.parametrize(("dims", "size"), [(1, 200), (2, 300), (3, 600), (4, 700)])
def test_codes_against_going_down(spark, dims, size):
    draw = random.Random(dims)
    records = {r for r in range(size) if draw.random() < 0.3 or 64 <= r < 64 + size // 3}
    levels = regions.tree_levels(size, dims)
    assert (1 << dims * levels) >= size > (1 << dims * (levels - 1))
    made = regions.codes(region(spark, records), dims, levels)
    assert {(r.level, r.node): r.code for r in made.collect()} == plain_codes(records, dims, levels)
    assert {r.rid for r in regions.rids(regions.from_codes(made, dims)).collect()} == records
    by_level = [(r.level, r.node) for r in regions.traverse(made, dims).collect()]
    assert by_level == sorted(by_level, key=lambda x: (-x[0], x[1]))
    down = [(r.node << r.level * dims, -r.level) for r in regions.traverse(made, dims, depth_first=True).collect()]
    assert down == sorted(down)


def test_codes_of_uniform_regions(spark):
    assert [r.code for r in regions.codes(region(spark, set()), 2, 3).collect()] == [0] * 4
    assert [r.code for r in regions.codes(region(spark, set(range(64))), 2, 3).collect()] == [1] * 4
    with pytest.raises(ValueError):
        regions.codes(region(spark, {1}), 4, 16)


@pytest.mark.parametrize("dims", [[5], [3, 6], [2, 1, 5], [3, 2, 2, 3], [2, 3, 1, 2, 2], [0, 4]])
def test_z_order(spark, dims):
    rows = bits.z_order(spark, dims).collect()
    expected, width = {}, max(max((n - 1).bit_length() for n in dims), 0)
    cells = 1
    for n in dims:
        cells *= n
    for rid in range(cells):
        left, cell = rid, []
        for n in reversed(dims):
            left, c = divmod(left, n)
            cell.append(c)
        expected[rid] = (sum((c >> i & 1) << (i * len(dims) + k) for k, c in enumerate(cell) for i in range(width)), tuple(cell[::-1]))
    assert {r.rid: (r.z, tuple(r[f"c{k}"] for k in range(len(dims)))) for r in rows} == expected


@pytest.mark.parametrize("kind", ["uint8", "int8", "float32"])
@pytest.mark.parametrize("n", [1, 5, 8])
def test_key_limits(spark, kind, n):
    made = Sigbits(n, kind)
    keys = [r.id for r in spark.range(1 << n).orderBy(made.order(F.col("id"))).collect()]
    assert (made.min_key(), made.max_key()) == (keys[0], keys[-1])


def test_key_limits_of_64_bits():
    assert (Sigbits(64, "int64").min_key(), Sigbits(64, "int64").max_key()) == (-(1 << 63), (1 << 63) - 1)
    assert (Sigbits(64, "uint64").min_key(), Sigbits(64, "uint64").max_key()) == (0, -1)


def test_universal():
    assert universal(-1, "uint64") == (1 << 64) - 1 and universal((1 << 64) - 1, "int64") == -1
    assert universal(-2.9, "int64") == -2 and universal(3, "double") == 3.0 and universal("x", "string") == "x"
    assert [universal(*x) for x in (("3", "int64"), (3, "string"), (float("nan"), "int64"), (1e300, "uint64"), (None, "double"))] == [None] * 5
    with pytest.raises(ValueError):
        universal(1, "blob")


def test_command_line(spark, tmp_path):
    values = [0, 0, 0, 2, 1, 1, 1, 0, 2, 2, 2, 1, 0, 0, 1, 0]
    raw, meta, index, database = (str(tmp_path / x) for x in ("x.raw", "x.meta", "x.index", "db"))
    with open(raw, "wb") as f:
        f.write(struct.pack("<16i", *values))
    main(["build-meta", "--out", meta, "--path", raw, "--type", "int32", "--dims", "16"])
    main(["build-index", "--meta", meta, "--var", "x", "--out", index, "--binning", "sigbits", "--param", "32", "--encoding", "interval", "--part-size", "4"], spark)
    with open(database, "w") as f:
        f.write(f"x.metapath={meta}\nx.indexpath={index}\n")

    def rows(*arguments):
        out = io.StringIO()
        main(list(arguments), spark, out)
        return [json.loads(line) for line in out.getvalue().splitlines()]

    assert [r["part_id"] for r in rows("index-info", "--index", index)] == [0, 1, 2, 3]
    found = rows("query", "--database", database, "--mode", "rids", "x<=0", "x>=2", "OR")
    # Each partition's least bin stands in for a missing one, and its greatest for one that is above all.
    expected = []
    for part in range(4):
        own = values[part * 4 : part * 4 + 4]
        at = max((k for k in own if k <= 2), default=min(own))
        expected += [part * 4 + i for i, v in enumerate(own) if v <= 0 or v >= at]
    assert sorted(r["rid"] for r in found) == expected
    counted = rows("query", "--database", database, "x<=0", "x>=2", "OR")
    assert sum(r["n"] for r in counted) == len(expected)
    stats = rows("query", "--database", database, "--mode", "stats", "--complement", "always", "x<=0")
    assert len(stats) == 4
    main(["query", "--database", database, "--mode", "rids", "--out", str(tmp_path / "rids"), "x<=0"], spark)
    assert sorted(r.rid for r in spark.read.parquet(str(tmp_path / "rids")).collect()) == [i for i, v in enumerate(values) if v == 0]
