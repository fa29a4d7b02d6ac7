import random

import pytest
from pyspark.sql import functions as F

from binsieve.functions.binning import Cast, Explicit, Precision, Sigbits, from_told
from binsieve.operators import regions, tools
from binsieve.operators.column_engine import ColumnEngine
from binsieve.operators.forms import IdLists, combine_runs
from binsieve.operators.index import Index, build_index, committed
from binsieve.operators.index_engine import IndexEngine, choose, read_cost
from binsieve.plans.terms import AndNot, Constraint, Or, Query, Xor

# Data sets and answers that other implementations of these operators are tested with.
SMALL = [0, 0, 0, 2, 1, 1, 1, 0, 2, 2, 2, 1, 0, 0, 1, 0]
MEDIUM = SMALL + [3, 3, 3, 3, 2, 3, 3, 3, 3, 3, 4, 4, 3, 3, 4, 4] + [5] * 32
BIG = list(range(10)) + [random.Random(1).randrange(10) for _ in range(2000)]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "rid bigint, var int")


def touched(keys, lower, upper):
    """The bins of a constraint, said plainly."""
    keys = sorted(keys)
    at = [k for k in keys if k <= lower]
    first = at[-1] if at else keys[0]
    return {k for k in keys if first <= k <= upper}


def rids(df):
    return sorted(r.rid for r in df.select("rid").collect())


CASES = [
    (SMALL, [(0, 0), (2, 2)], Or()), (SMALL, [(0, 1), (0, 0)], Or()), (MEDIUM, [(0, 0), (2, 3), (5, 5)], Or(3)), (MEDIUM, [(0, 3), (3, 5)], None), (BIG, [(2, 6), (5, 9)], None),
    (SMALL, [(0, 0), (3, 3)], Or()), (SMALL, [(0, 0), (0, 2)], None), (MEDIUM, [(0, 4), (1, 2), (4, 4)], AndNot(3)), (MEDIUM, [(0, 3), (2, 4), (3, 5)], Xor(3)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_both_engines_against_brute_force(spark, case):
    values, ranges, operator = CASES[case]
    made = Query(*(Constraint("var", *r) for r in ranges), operator or Query.range("a").__and__(Query.range("b")).terms[-1])
    sets = [{i for i, v in enumerate(values) if v in touched(set(values), *r)} for r in ranges]
    name = made.terms[-1].name
    want = {"AND": set.intersection, "OR": set.union, "ANDNOT": set.difference}[name](*sets) if name != "XOR" else {i for i in range(len(values)) if sum(i in s for s in sets) % 2}
    own = {"var": Sigbits(32, "int32")}
    df = frame(spark, values)
    assert rids(ColumnEngine(df, own, "rid").evaluate(made)) == sorted(want)
    encoding = ["equality", "range", "interval", "hierarchical", "binary"][case % 5]
    index = build_index(df, "var", "rid", own["var"]).encode(encoding)
    for complement in ("never", "always"):
        assert rids(IndexEngine({"var": index}, own, complement).evaluate(made)) == sorted(want)


def test_golden_explicit_bins(spark):
    df = frame(spark, SMALL)
    made = Query.range("var", 0, 0) | Query.range("var", 2, 2)
    some = [0, 1, 2, 3, 7, 8, 9, 10, 12, 13, 15]
    for bounds, keys, want in (((0, 1, 2), [0, 1, 2], some), ((1, 2), [-(2**31), 1, 2], some), ((0, 2), [0, 2], list(range(16)))):
        engine = ColumnEngine(df, {"var": Explicit(bounds, "int32")}, "rid")
        assert [r.bin_key for r in engine.bin_keys("var").collect()] == keys
        assert rids(engine.evaluate(made)) == want


def test_candidate_rule(spark):
    engine = ColumnEngine(frame(spark, [1, 3, 5, 5]), {"var": Sigbits(32, "int32")}, "rid")
    assert rids(engine.evaluate(Query.range("var", 4, 6))) == [1, 2, 3]
    assert rids(engine.evaluate(Query.range("var", 9))) == [2, 3]
    assert rids(engine.evaluate(Query.range("var", None, 0))) == []
    assert rids(engine.evaluate(Query.range("var", -5, 3))) == [0, 1]


def test_nulls_are_in_no_bin(spark):
    df, own = frame(spark, [1, None, 3, None]), {"var": Sigbits(32, "int32")}
    index = build_index(df, "var", "rid", own["var"])
    for made, want in ((Query.range("var"), [0, 2]), (~Query.range("var"), [1, 3]), (~Query.range("var", 2), [1, 3]), (Query.range("var", 3), [2])):
        assert rids(ColumnEngine(df, own, "rid").evaluate(made)) == want
        for encoding in ("equality", "range", "interval", "hierarchical", "binary"):
            assert rids(IndexEngine({"var": index.encode(encoding)}, own, "always").evaluate(made)) == want


def test_partitions(spark, tmp_path):
    df, own = frame(spark, SMALL), {"var": Sigbits(32, "int32")}
    index = build_index(df, "var", "rid", own["var"], part_size=4)
    assert index.parts.count() == 4 and [r.part_id for r in index.partition_at(8).collect()] == [2]
    made = Query.range("var", 1, 2)
    parted = ColumnEngine(df.withColumn("part", F.floor(F.col("rid") / 4)), own, "rid", part="part")
    want = [i for i, v in enumerate(SMALL) if v in touched(set(SMALL[i // 4 * 4 : i // 4 * 4 + 4]), 1, 2)]
    assert rids(parted.evaluate(made)) == want == rids(IndexEngine({"var": index}, own).evaluate(made))
    assert rids(IndexEngine({"var": index}, own).evaluate(made, 1, 3)) == [i for i in want if 4 <= i < 12]
    path = str(tmp_path / "index")
    index.partition(0).save(path)
    for k in (1, 2, 3):
        index.partition(k).append(path)
    assert rids(IndexEngine({"var": Index.load(spark, path)}, own).evaluate(made)) == want
    assert {r.part_id: r.n for r in IndexEngine({"var": index}, own).counts(made).collect()} == {k: sum(k * 4 <= i < k * 4 + 4 for i in want) for k in range(4)}
    assert index.info().count() == 4 and IndexEngine({"var": index}, own).statistics(made).count() >= 1


def test_ranges_of_records(spark):
    index = build_index(frame(spark, SMALL), "var", "rid", Sigbits(32, "int32"), 4, offset=3, size=7, relative=True)
    assert [(r.domain_offset, r.domain_size) for r in index.parts.orderBy("part_id").collect()] == [(0, 4), (4, 3)]
    absolute = build_index(frame(spark, SMALL), "var", "rid", Sigbits(32, "int32"), 4, offset=3, size=7, relative=False)
    assert [r.domain_offset for r in absolute.parts.orderBy("part_id").collect()] == [3, 7]


def test_cost_of_reading():
    formula, other = choose("equality", 64, 0, 60, dict.fromkeys(range(64), 8))
    assert other and formula.regions() == [60, 61, 62, 63]
    assert read_cost(formula, {}) == 1 << 20


def region(spark, ids):
    return regions.words(spark.createDataFrame([(0, i) for i in ids], "region_id int, rid bigint"), "rid").select("word_idx", "word")


def test_region_algebra_and_forms(spark):
    rng = random.Random(3)
    size = 1000
    a, b, c = (sorted(rng.sample(range(size), 400)) for _ in range(3))
    x, y, z = (region(spark, ids) for ids in (a, b, c))
    whole = regions.spine(spark.createDataFrame([(size,)], "size bigint"), "size")
    assert rids(regions.rids(regions.union(x, y, z))) == sorted({*a, *b, *c})
    assert rids(regions.rids(regions.intersect(x, y, z))) == sorted({*a} & {*b} & {*c})
    assert rids(regions.rids(regions.difference(x, y, z))) == sorted({*a} - {*b} - {*c})
    assert rids(regions.rids(regions.symdiff(x, y))) == sorted({*a} ^ {*b})
    assert rids(regions.rids(regions.complement(x, whole), 7)) == [i + 7 for i in range(size) if i not in {*a}]
    assert regions.count(x).first().n == 400
    for back in (regions.from_runs(regions.runs(x)), regions.from_blocks(regions.blocks(x, 2, 3), 2), regions.from_id_list(regions.id_list(x))):
        assert regions.equal(back, x).first().equal
    assert not regions.equal(x, y).first().equal
    long = region(spark, range(60, 200))
    assert [(r.start, r.len) for r in regions.runs(long).collect()] == [(60, 140)]
    assert {r.form for r in regions.sizes(long).collect()} == {"list", "bitmap", "runs", "blocks"}


def test_tools(spark):
    df = frame(spark, MEDIUM)
    rows = {r.bin_key: (r.n, r.runs) for r in tools.characterize(df, F.col("var"), "rid").collect()}
    runs = [v for i, v in enumerate(MEDIUM) if not i or MEDIUM[i - 1] != v]
    assert rows == {k: (MEDIUM.count(k), runs.count(k)) for k in set(MEDIUM)}
    cuts = tools.equi_depth(spark.range(1000).select(F.col("id").alias("v")), "v", 4)
    assert cuts == [249, 499, 749]
    assert tools.equi_depth(spark.range(2).select(F.col("id").alias("v")), "v", 8) in ([0], [0, 1])
    found = spark.range(1000).groupBy(tools.equi_depth_bin(F.col("id"), cuts).alias("b")).count().collect()
    assert {r.b: r["count"] for r in found} == dict.fromkeys(range(4), 250)
    assert tools.equi_depth(df.where("rid < 0"), "var", 4) == []
    ids = {r.var: r.bin_id for r in tools.dense_ids(frame(spark, [30, 10, 30, 20]), "var").collect()}
    assert ids == {10: 0, 20: 1, 30: 2}


def test_runs_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(tools, "CHUNK", 4)
    rows = {r.bin_key: (r.n, r.runs) for r in tools.characterize(frame(spark, MEDIUM), F.col("var"), "rid", 2, 50).collect()}
    part = MEDIUM[2:52]
    runs = [v for i, v in enumerate(part) if not i or part[i - 1] != v]
    assert rows == {k: (part.count(k), runs.count(k)) for k in set(part)}


@pytest.mark.parametrize("parts", [1, 15, 1000])
def test_any_number_of_partitions(spark, parts):
    """Answers by partition, from a plan that is no longer for more partitions."""
    rng = random.Random(parts)
    values = [rng.randrange(8) if rng.randrange(9) else None for _ in range(3 * parts + 2)]
    step = -(-len(values) // parts)
    made = (Query.range("var", 2, 5) | Query.range("var", 7)) - Query.range("var", 4, 4)
    want = {}
    for at in range(0, len(values), step):
        own = values[at : at + step]
        keys = {v for v in own if v is not None}
        hit = lambda v, *r: v is not None and v in touched(keys, *r)  # noqa: B023, E731
        want[at // step] = sum((hit(v, 2, 5) or hit(v, 7, 99)) and not hit(v, 4, 4) for v in own)
    df, encoding = frame(spark, values), ["equality", "range", "interval", "hierarchical", "binary"][parts % 5]
    counted = [IndexEngine({"var": build_index(df, "var", "rid", Sigbits(32, "int32"), size).encode(encoding)}).counts(made) for size in (step, len(values))]
    assert {r.part_id: r.n for r in counted[0].collect()} == want
    nodes = [len(x._jdf.queryExecution().logical().toString().splitlines()) for x in counted]
    assert nodes[0] == nodes[1]


def test_complement_is_chosen_by_partition(spark):
    """The same bins are cheap to read in one partition and dear in the other."""
    values = [0] * 10 + list(range(1, 9)) * 200 + [8] * 30 + [0] * 1600 + [1] * 40
    index = build_index(frame(spark, values), "var", "rid", Sigbits(32, "int32"), 1640)
    rows = {r.part_id: r for r in IndexEngine({"var": index}).statistics(Query.range("var", 1)).collect()}
    assert rows[0].complemented and rows[0].regions_read == 1 and rows[0].seeks == 1
    assert rows[0].bytes == 8 and rows[0].formula == "0 NOT/1" and rows[1].formula == "1" and not rows[1].complemented
    total = IndexEngine.total_statistics(IndexEngine({"var": index}).statistics(Query.range("var", 1))).first()
    assert total.parts == len(rows) and total.bytes == sum(r.bytes for r in rows.values())


def test_cursor(spark):
    engine = IndexEngine({"var": build_index(frame(spark, SMALL), "var", "rid", Sigbits(32, "int32"), 4)})
    made = Query.range("var", 1, 2)
    whole = rids(engine.evaluate(made))
    cursor = engine.cursor(made, step=3)
    assert cursor.has_next() and rids(cursor.next()) == [i for i in whole if i < 12]
    assert rids(cursor.next()) == [i for i in whole if i >= 12] and not cursor.has_next()
    cursor = engine.cursor(made)
    cursor.step(3)
    assert [rids(x) for x in cursor] == [[i for i in whole if i >= 12]]
    with pytest.raises(StopIteration):
        cursor.next()


def test_a_failed_append_counts_for_nothing(spark, tmp_path, monkeypatch):
    path, own = str(tmp_path / "index"), {"var": Sigbits(32, "int32")}
    index = build_index(frame(spark, SMALL), "var", "rid", own["var"], 4)
    assert index.partition(0).append(path, "a")
    whole = Index.save
    broken = index.partition(1)
    object.__setattr__(broken, "parts", broken.parts.withColumn("nbins", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        broken.append(path, "b")
    assert len(committed(spark, path)) == 1 and Index.load(spark, path).parts.count() == 1
    assert index.partition(1).append(path, "b") and not index.partition(1).append(path, "b")
    loaded = Index.load(spark, path)
    assert loaded.bins.agg(F.sum("n")).first()[0] == 8 and loaded.binning == own["var"] and loaded.sizes.count() == loaded.region_bytes().count()
    made = Query.range("var", 1, 2)
    assert rids(IndexEngine({"var": loaded}).evaluate(made)) == rids(IndexEngine({"var": index}, own).evaluate(made, 0, 2))
    with pytest.raises(ValueError):
        IndexEngine({"var": loaded}, {"var": Sigbits(31, "int32")})
    with pytest.raises(FileExistsError):
        index.save(path)
    with pytest.raises(ValueError):
        build_index(frame(spark, SMALL), "var", "rid", Explicit((0, 1), "int32"), 4).append(path) and Index.load(spark, path)
    assert whole is Index.save and index.save(path, "overwrite") and Index.load(spark, path).parts.count() == 4
    assert index.info(details=True).where("part_id = 0").first().bin_keys == [0, 2]


def test_binnings_tell_themselves():
    for own in (Sigbits(12, "uint16"), Precision(3), Explicit((1, 5), "int32"), Explicit(("a", "b")), Cast("int32", Sigbits(20, "int32"))):
        import json

        assert from_told(json.loads(json.dumps(own.told()))) == own


def test_algebra_of_stored_forms(spark):
    rng = random.Random(8)
    size = 5 * (1 << 22)
    near = [k * (1 << 22) + d for k in range(5) for d in range(-9, 9) if 0 <= k * (1 << 22) + d]
    sets = [{*rng.sample(near, 50), *range(70_000 * k, 70_000 * k + 900)} for k in (1, 1, 2)]
    table = lambda ids: spark.createDataFrame([(i,) for i in sorted(ids)], "rid bigint")
    domain = spark.createDataFrame([(200_000,)], "size bigint")
    small = [{i for i in s if i < 200_000} for s in sets]
    every = set(range(200_000))
    for flip in ((False, False), (True, False), (False, True), (True, True)):
        a, b = (IdLists.of(table(every - s if f else s), f) for s, f in zip(small, flip))
        for got, want in ((a & b, small[0] & small[1]), (a | b, small[0] | small[1]), (a - b, small[0] - small[1]), (a ^ b, small[0] ^ small[1])):
            assert rids(got.rids(domain)) == sorted(want)
    runs = [regions.runs(regions.words(table(s).withColumn("region_id", F.lit(0)), "rid").select("word_idx", "word")) for s in sets]
    for name, want in (("OR", sets[0] | sets[1] | sets[2]), ("AND", sets[0] & sets[1] & sets[2]), ("ANDNOT", sets[0] - sets[1] - sets[2]), ("XOR", sets[0] ^ sets[1] ^ sets[2])):
        got = sorted((r.start, r.len) for r in combine_runs(name, *runs).collect())
        plain = []
        for i in sorted(want):
            if plain and sum(plain[-1]) == i:
                plain[-1] = (plain[-1][0], plain[-1][1] + 1)
            else:
                plain.append((i, 1))
        assert got == plain and max(want) < size


def test_inverted_lists_read_back(spark):
    whole = regions.spine(spark.createDataFrame([(200_000,)], "size bigint"), "size")
    own = region(spark, [*range(65_536, 131_072), 5, 7, 199_999])
    assert regions.equal(regions.from_id_list(regions.id_list(own, True, whole), whole), own).first().equal
    long = spark.createDataFrame([(0, False, [1] * 60_000)], "chunk bigint, inverted boolean, deltas array<bigint>")
    assert regions.count(regions.from_id_list(long)).first().n == 60_000
