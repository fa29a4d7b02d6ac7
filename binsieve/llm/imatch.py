"""I-Match document fingerprints in DataFrame operations.

Terms are the distinct lower-cased words of a text. The lexicon keeps the terms whose inverse document
frequency is within a band; a document's terms in the lexicon, sorted, are hashed once for each of
several random subsets of it, so that a document keeps the hashes of all subsets its changed terms
aren't in. Subsets of many sizes serve short and long documents alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binsieve.llm.common import written

#: Terms in this share of the documents, from least to most, are the lexicon: ln(1 / share) is their inverse document frequency.
BAND = (0.005, 0.2)
#: (one term in so many is in the subset, how many such subsets).
SUBSETS = ((4, 2), (16, 6), (64, 10), (256, 14))
#: XXH64 of an empty array, by which a subset without terms is known.
_NONE = 42


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text: what stands between white space, commas and full stops."""
    plain = F.lower(text)
    for mark in ("\n", "\t", "\r", ",", "."):
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    return F.transform(F.array_remove(F.array_distinct(F.split(plain, " ")), ""), lambda w: F.xxhash64(w))


def subsets() -> list[tuple[int, int]]:
    """(number, modulus) of each subset."""
    sizes = [m for m, n in SUBSETS for _ in range(n)]
    return list(enumerate(sizes))


def lexicon(df: DataFrame, text_column: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, mask): the band's term hashes, each with a bit for every subset it is in.

    Document frequencies are counted over all documents. Were each document to have d distinct terms
    on average, at most d / band[0] terms could reach the band, whatever the number of documents.
    """
    docs = df.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    total = docs.count()
    held = counts.where((F.col("count") >= band[0] * total) & (F.col("count") <= band[1] * total) & (F.col("count") >= 2))
    mask = F.lit(0).cast("bigint")
    for k, m in subsets():
        mask = mask.bitwiseOR(F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(m)) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return written(held.select("term", mask.alias("mask")), "lexicon")


def lookup(words: DataFrame) -> Callable[[Column], Column]:
    """The lexicon as a constant table: a function from a term to the (term, mask) entries of its bucket.

    The lexicon's terms come to the driver; their number is bounded as ``lexicon`` says.
    """
    held = words.collect()
    buckets: list[list[str]] = [[] for _ in range(1 << len(held).bit_length())]
    for term, mask in held:
        buckets[term % len(buckets)].append(f'{{"term":{term},"mask":{mask}}}')
    table = F.from_json(F.lit("[" + ",".join(f"[{','.join(x)}]" for x in buckets) + "]"), "array<array<struct<term:bigint,mask:bigint>>>")
    low = F.lit(len(buckets) - 1).cast("bigint")
    return lambda term: F.get(table, term.bitwiseAND(low).cast("int"))


def with_signatures(df: DataFrame, text_column: str, to: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """Add an array of one hash for each subset; ``bucket`` looks up the lexicon.

    Each term of the document is looked up in its bucket, so a document costs what its own terms cost,
    however large the lexicon is; subsets of a size are then filtered from the terms that are in any of them.
    A text without a term of the lexicon is hashed with all its terms, so that texts don't become
    alike by having none. Terms are columns of their own, so that each is worked out once.
    """
    own, found, band, whole, each = (f"{to} {x}" for x in ("terms", "found", "band", "whole", "each"))
    looked = F.flatten(F.transform(own, lambda t: F.filter(bucket(t), lambda x: x["term"] == t)))
    held = df.withColumn(own, terms(F.col(text_column))).withColumn(found, looked).withColumn(band, F.sort_array(found))
    by_size: dict[int, list[int]] = {}
    for k, m in subsets():
        by_size.setdefault(m, []).append(k)
    some = {m: f"{to} of {m}" for m in by_size}
    among = lambda ks: lambda x: x["mask"].bitwiseAND(F.lit(sum(1 << k for k in ks)).cast("bigint")) != 0
    held = held.withColumns({some[m]: F.filter(band, among(ks)) for m, ks in by_size.items()})
    # Filters keep this projection out of whole-stage code, whose one method for all subsets would be too
    # long for the JVM to compile; expression code is split into a method for each.
    hashed = F.array(*[F.xxhash64(F.filter(some[m], among([k]))["term"]) for k, m in subsets()])
    held = held.withColumns({each: hashed, whole: F.sort_array(F.filter(own, lambda t: F.size(band) == 0))})
    other = F.transform(F.array(*[F.lit(k) for k, _ in subsets()]), lambda k: F.xxhash64(F.col(whole), k))
    return held.withColumn(to, F.when(F.size(band) > 0, F.col(each)).otherwise(other)).drop(own, found, band, whole, each, *some.values())


def shown(found: Column) -> Column:
    """Signatures as hexadecimal text, 32 bits each."""
    return F.array_join(F.transform(found, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among those that are of a term on either side."""
    told = F.zip_with(a, b, lambda x, y: F.when((x == _NONE) & (y == _NONE), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1000)))
    total = F.aggregate(told, F.lit(0), lambda s, x: s + x)
    return F.when(total > 0, F.pmod(total, F.lit(1000)) / F.floor(total / 1000)).otherwise(F.lit(0.0)).cast("double")


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many bounds are at or below value, by bisection."""
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) <= value), s).otherwise(0))


def with_next(df: DataFrame, id_column: str, carried: list[str], buckets: int) -> DataFrame:
    """Add ``next``, a struct of the carried columns of the row that comes next in descending id order.

    After the last row (the smallest id, nulls below all) comes the first. Rows of equal ids are in
    the order of their carried columns' hash. Rows are dealt to ranges of ids by quantiles of the
    whole column, and the first row of each range is also sent to the range that comes before it, so no range sees more
    than its rows and one. The driver sees one id for each range.
    """
    ids = df.select(F.col(id_column).cast("bigint").alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [k / buckets for k in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts)) if buckets > 1 else []
    at = _bucket(bounds, F.col(id_column).cast("bigint"))
    tops = sorted((r["b"], r["top"]) for r in ids.select(_bucket(bounds, F.col("i")).alias("b"), "i").groupBy("b").agg(F.max("i").alias("top")).collect())
    top, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for k, (b, highest) in enumerate(tops):
        top[b], before[b] = highest, tops[(k + 1) % len(tops)][0]
    highest = F.get(F.array(*[F.lit(x).cast("bigint") for x in top]), F.col("bucket"))
    target = F.get(F.array(*[F.lit(x) for x in before]), F.col("bucket"))
    placed = df.withColumn("bucket", at)
    first = F.col(id_column).cast("bigint").eqNullSafe(highest)
    both = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")), F.when(first, F.struct(target.alias("bucket"), F.lit(1).alias("extra")))))
    dealt = placed.withColumn("to", F.explode(both)).withColumn("bucket", F.col("to.bucket")).withColumn("extra", F.col("to.extra")).drop("to")
    order = Window.partitionBy("bucket").orderBy("extra", F.col(id_column).desc_nulls_last(), F.xxhash64(*carried), *carried)
    found = dealt.withColumn("next", F.lead(F.struct(*carried)).over(order))
    return found.where("extra = 0").drop("bucket", "extra")


def imatch_edits(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's.

    The edited text has the last third of the code points (rounded down) replaced by the first as
    many of the next document in descending id order; after the last comes the first. Returns the id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``. Null texts are empty; a single document is its own next; an empty table gives no
    rows; other columns are dropped. Ids must be integers.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    words = lookup(lexicon(docs, "text", band))
    signed = with_signatures(docs, "text", "own", words)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(signed, "id", ["text", "own"], buckets)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = paired.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next.text", F.lit(1), third)))
    done = with_signatures(edited, "edited", "changed", words)
    return done.select(
        F.col("id").alias(id_column), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next.own")).alias("near_next"),
    )
