import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from binsieve.llm import imatch, media, pii, simhash, toxicity, url_rules
from binsieve.llm.components import components


def num(x):
    return -1 if x is None else x


def test_media_formats():
    import gzip
    import io
    import struct
    import zipfile

    wav = media.encode_wav(b"ab" * 64)
    assert media.read_wav(wav) == b"ab" * 64 and media.sniff(wav) == [("wav", 0, len(wav))]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\2\2\x4c\1\0\x3b"
    bmp = b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as f:
        f.writestr("a.txt", "hello")
    parts = [("wav", wav), ("png", png), ("gif", gif), ("bmp", bmp), ("gzip", gzip.compress(b"hello" * 20)), ("zip", held.getvalue())]
    data, want = b"", []
    for name, part in parts:
        data += b"some text RIFF GIF89a BM OggS "
        want.append((name, len(data), len(part)))
        data += part
    assert media.sniff(data) == want
    for name, part in parts:
        assert not any(n == name for n, *_ in media.sniff(part[:-1] + b"?" if name == "png" else part[:-3]))


def plain_pdf(body=b"stream"):
    head = b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n"
    return head + b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(head)


def test_two_files_in_a_row_stay_two():
    one, two = plain_pdf(), plain_pdf(b"more %%EOF PK\5\6")
    data = b"text %PDF- no " + one + b" and " + two + b" %%EOF"
    assert media.sniff(data) == [("pdf", 14, len(one)), ("pdf", 14 + len(one) + 5, len(two))]
    assert media.sniff(one[:-9] + b"9\n%%EOF") == []
    chunk = b"WEBPVP8 " + (6).to_bytes(4, "little") + b"abcdef"
    webp = b"RIFF" + len(chunk).to_bytes(4, "little") + chunk
    assert media.sniff(webp) == [("webp", 0, len(webp))] and media.sniff(webp[:16] + b"\7" + webp[17:]) == []


def test_sniffing_takes_linear_time():
    import gzip
    import time

    big = gzip.compress(b"\0" * 3_000_000, 1)
    for unit in (b"PK\3\4 no ", b"%PDF-1 no ", b"%PDF-1 startxref 5 %%EOF", b"PK\3\4PK\5\6" + b"\0" * 18, b"\x1f\x8b\x08 no ", b"BM" + b"\1" * 40, b"RIFF    WEBPVP8 "):
        took = []
        for n in (1 << 14, 1 << 16):
            began = time.process_time()
            media.sniff(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.2, unit
    assert media.sniff(b"x" + big) == [("gzip", 1, len(big))]


def test_features_are_plain_counts():
    samples = bytes(range(256)) * 3 + b"\0" * 64
    wav = media.encode_wav(samples)
    mean = sum(samples) / len(samples)
    spread = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
    levels = ".".join(str(sum(x // 16 == k for x in samples)) for k in range(16))
    assert media.feature(wav, samples) == f"wav;{len(wav)};none;mean={mean:.4f};std={spread:.4f};levels={levels}"
    inner = plain_pdf()
    held = media.encode_wav(inner)
    assert f";pdf@44:{len(inner)};" in media.feature(held, inner)


def test_media_columns(spark, odd_docs):
    wav = media.encode_wav(b"x" * 64)
    df = spark.createDataFrame([(1, wav, "image/png"), (2, b"plain" + wav, "text/plain"), (3, None, "image/png"), (4, b"", None)], "k int, media binary, told string")
    rows = {r.k: r for r in media.sniff_media(df, "k", "media", "told").collect()}
    assert rows[1].media_type == "audio/wav" and rows[1].corrected
    assert rows[2].media_type == "text/plain" and not rows[2].corrected and bytes(rows[2].carved[0].bytes) == wav and rows[2].carved[0].start == 5
    assert rows[3].media_type == "image/png" and rows[4].media_type == "application/octet-stream"
    for r in media.media_round_trip(odd_docs).collect():
        texts = [x.text or "" for x in odd_docs.where(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).collect()]
        payload = texts[0].encode() + b"\0" * (-len(texts[0].encode()) % 64) or b"\0" * 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[0].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.feature.startswith("wav;")
    assert media.media_round_trip(odd_docs.where("false")).count() == 0


def brute_simhash(text, k):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or [" ".join(found)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    name = {n: n for n in nodes}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            name[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(500, 500 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("radius,block", [(4, 2048), (4, 8), (2, 4), (7, 16)])
def test_links_lose_nothing(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(radius + block)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(30)} | {rng.getrandbits(64) for _ in range(50)} | {0}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    want = brute_components(pairs, signed)
    assert {x: got.get(x, x) for x in signed} == want


def test_simhash_rows(odd_docs, documents):
    for df in (odd_docs, documents):
        texts = df.select("doc_id", "text").collect()
        rows = simhash.simhash_components(df, 4, 4).collect()
        fps = [brute_simhash(t.text or "", 4) for t in texts]
        assert sorted((num(r.doc_id), r.fingerprint) for r in rows) == sorted((num(t.doc_id), f"{f:016x}") for t, f in zip(texts, fps))
        pairs = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 4]
        groups = brute_components(pairs, set(fps))
        smallest: dict = {}
        for t, f in zip(texts, fps):
            if t.doc_id is not None:
                smallest[groups[f]] = min(smallest.get(groups[f], t.doc_id), t.doc_id)
        assert sorted((num(r.doc_id), num(r.component_id)) for r in rows) == sorted((num(t.doc_id), smallest.get(groups[f], -1)) for t, f in zip(texts, fps))
    assert simhash.simhash_components(odd_docs.where("false")).count() == 0


def test_sketches():
    a = " ".join(f"w{i}" for i in range(100))
    b = " ".join(f"w{i}" for i in range(10, 104))
    x, y = simhash.shingle_sketch(a, 5, 128), simhash.shingle_sketch(b, 5, 128)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    p, q = shingles(a), shingles(b)
    assert simhash.resemblance(x, y, 128) == pytest.approx(len(p & q) / len(p | q))
    assert simhash.resemblance(simhash.shingle_sketch("", 5, 8), simhash.shingle_sketch(" ", 5, 8), 8) == 1.0


def test_near_duplicates_are_dropped(spark, odd_docs):
    rng = random.Random(8)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(200)]
        for k in range(5):
            own = list(base)
            if k:
                own[rng.randrange(190)] = f"edit{g}{k}"
            texts.append(" ".join(own))
    alone = [" ".join(f"z{rng.randrange(10_000)}" for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + alone)), "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    assert [k for k in kept if k >= 30] == list(range(30, 70))
    assert [k for k in kept if k < 30] == [0, 5, 10, 15, 20, 25]
    odd = simhash.drop_near_duplicates(odd_docs)
    assert odd.columns == odd_docs.columns
    assert sorted(num(r.doc_id) for r in odd.collect()) == [-1, 1, 2, 4, 8, 9]


def near_groups(texts, k=5, similarity=0.8):
    """For each text the first of its group, by shingle sets of all pairs."""
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in map(str.split, texts)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]
    return brute_components(pairs, range(len(texts)))


def found_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.name for r in simhash.near_duplicate_groups(df, "doc_id").select("doc_id", F.col("name").alias("name")).collect()}


def test_near_copies_in_full_buckets(spark):
    """Fingerprints ruled by one line are all near each other; the endings tell which texts are copies."""
    rng = random.Random(12)
    line, texts = [f"l{i}" for i in range(12)], []
    for g in range(250):
        tail = [f"t{g}w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(line * 12 + tail[:-1] + [f"end{k}"]) for k in range(5)]
    expected = near_groups(texts)
    assert len(set(expected.values())) == 250
    assert found_groups(spark, texts) == expected


@pytest.mark.parametrize("group", [512, 8])
def test_chains_of_near_copies(spark, monkeypatch, group):
    """Three steps of forty texts, of which only next ones are alike: no single text stands for all."""
    monkeypatch.setattr(simhash, "GROUP", group, raising=False)
    rng = random.Random(31)
    texts = []
    for g in range(5):
        words = [f"c{g}w{rng.randrange(10**6)}" for _ in range(300)]
        for step in range(3):
            for k in range(4 if step else 0):
                words[20 * (4 * step + k)] = f"edit{g}x{step}x{k}"
            texts += [" ".join([*words[:-1], f"end{step}x{k}"]) for k in range(40)]
    rng.shuffle(texts)
    expected = near_groups(texts)
    assert len(set(expected.values())) == 5
    assert found_groups(spark, texts) == expected


def test_near_copies_of_equal_fingerprints(spark):
    """One word, said over and over, rules the fingerprints of all; the endings tell which are copies."""
    rng = random.Random(5)
    texts = []
    for g in range(6):
        tail = [f"t{g}w{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(["again"] * 3000 + tail), " ".join(["again"] * 3000 + tail[:-1] + ["other"])]
    assert len({tuple(simhash.simhashes(t, 5, 2)) for t in texts}) == 1
    expected = near_groups(texts)
    assert len(set(expected.values())) == 6
    assert found_groups(spark, texts) == expected


def test_similarity_is_of_whole_texts(spark):
    """Pairs near 0.8 on either side, whose smallest 256 hashes say otherwise."""
    wrong = {True: [], False: []}
    for seed in range(4000):
        rng = random.Random(seed)
        a = [f"s{seed}w{rng.randrange(10**6)}" for _ in range(604)]
        b = list(a)
        edits = (13, 14)[seed % 2]
        for k in range(edits):
            b[20 + 40 * k] = f"edit{k}"
        a, b = " ".join(a), " ".join(b)
        alike = (600 - 5 * edits) / (600 + 5 * edits) >= 0.8
        said = simhash.resemblance(simhash.shingle_sketch(a, 5, 256), simhash.shingle_sketch(b, 5, 256), 256) >= 0.8
        if alike != said and len(wrong[alike]) < 3 and any((x ^ y).bit_count() <= 7 for x, y in zip(simhash.simhashes(a, 5, 2), simhash.simhashes(b, 5, 2))):
            wrong[alike] += [(a, b)]
        if all(len(x) == 3 for x in wrong.values()):
            break
    texts = [t for pairs in wrong.values() for p in pairs for t in p]
    assert len(texts) == 12 and len(set(near_groups(texts).values())) == 9
    assert found_groups(spark, texts) == near_groups(texts)


def test_repeated_lines_hide_no_near_copy(spark):
    rng = random.Random(6)
    texts = []
    for g in range(6):
        words, line = ([f"{k}{g}w{rng.randrange(10**6)}" for _ in range(n)] for k, n in (("r", 300), ("l", 12)))
        texts += [" ".join(words + line * 2), " ".join([*words[:-1], "other"] + line * 200)]
    expected = near_groups(texts)
    assert len(set(expected.values())) == 6
    assert found_groups(spark, texts) == expected


def edited_pair(rng, name, words, share):
    """A text, and it with single words changed until about ``share`` of all five-word shingles is common."""
    a = [f"{name}w{rng.randrange(10**6)}" for _ in range(words)]
    b, n, edit = list(a), words - 4, 0
    places = list(range(2, words - 2, 7))
    rng.shuffle(places)
    while places:
        b[places.pop()] = f"{name}edit{edit}"
        edit += 1
        if (n - 5 * edit) / (n + 5 * edit) < share + 5 / n:
            break
    return " ".join(a), " ".join(b)


def test_recall_of_planted_pairs(spark):
    """Pairs from 0.8 to 0.95, each the only way to its partner: at least 98 in 100 are found, and nothing unlike."""
    rng = random.Random(21)
    texts = [t for g in range(400) for t in edited_pair(rng, f"p{g}", rng.randrange(80, 600), rng.uniform(0.8, 0.95))]
    expected, got = near_groups_of_pairs(texts), found_groups(spark, texts)
    alike = [k for k in range(1, len(texts), 2) if expected[k] != k]
    assert len(alike) > 300
    assert sum(got[k] == expected[k] for k in alike) >= 0.98 * len(alike)
    assert all(got[k] == k for k in range(len(texts)) if expected[k] == k)


def near_groups_of_pairs(texts):
    """For each text the first of its group, where only the texts of a pair can be alike."""
    return {k + at: k + g for k in range(0, len(texts), 2) for at, g in near_groups(texts[k : k + 2]).items()}


def test_ring_radius_holds_for_similar_sets():
    rng = np.random.default_rng(3)
    radius, over = simhash.ring_radius(0.8), 0
    for _ in range(400):
        common, own = rng.integers(0, 2**63, (1, 400), np.uint64)[0], rng.integers(0, 2**63, (2, 50), np.uint64)
        a, b = simhash.rings(np.array([simhash.drawn([np.append(common, x)]) for x in own]))
        over += int(np.bitwise_count((a ^ b) & np.uint64((1 << simhash.BOX) - 1)).sum()) > radius
    assert over <= 8 and 64 <= radius <= 76


@pytest.mark.parametrize("block", [2048, 16])
def test_variants_of_one_text(spark, monkeypatch, block):
    """Three hundred edits of one text: what stays is what stays by brute force, in whole buckets and dealt ones."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(17)
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 9)):
            own[at] = f"edit{k}x{at}"
        texts.append(" ".join(own))
    assert found_groups(spark, texts) == near_groups(texts)


def test_names_that_clash_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9, 10), (2, "a b c d e f", 7, 8, 9, 10), (2, "a b c d e f", 7, 8, 9, 10), (3, None, 7, 8, 9, 10)], "doc_id int, text string, _id int, _hash int, _hash2 int, __text_hash int")
    assert sorted(map(tuple, simhash.drop_near_duplicates(df).collect())) == [(1, "a b c d e f", 7, 8, 9, 10), (3, None, 7, 8, 9, 10)]
    renamed = df.withColumnRenamed("_id", "_key").withColumnRenamed("_hash", "name").withColumnRenamed("_hash2", "_text_hash")
    assert simhash.drop_near_duplicates(renamed).columns == renamed.columns and simhash.drop_near_duplicates(renamed).count() == 2
    assert simhash.drop_near_duplicates(df.where("false")).count() == 0


def test_imatch(spark, odd_docs, documents):
    for df in (odd_docs, documents):
        rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
        rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
        got = sorted(imatch.imatch_edits(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
        by_text: dict = {}
        for k, (a, b) in enumerate(zip(rows, got)):
            n, after = len(a.text), rows[(k + 1) % len(rows)].text
            edited = a.text[: n - n // 3] + after[: n // 3]
            assert (b.doc_id, b.n_chars, b.edited_sha256) == (a.doc_id, n, hashlib.sha256(edited.encode()).hexdigest())
            assert by_text.setdefault(a.text, b.fingerprint) == b.fingerprint
            assert 0 <= b.near_next <= 1 and 0 <= b.near_edited <= 1
            if edited == a.text:
                assert b.near_edited == 1.0 and b.edited_fingerprint == b.fingerprint
    assert imatch.imatch_edits(odd_docs.where("false")).count() == 0
    one = imatch.imatch_edits(odd_docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    near = imatch.imatch_edits(documents).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > 5 * near[1]


def test_imatch_fingerprints_are_plain_counts(spark, documents):
    """Only the hash function is asked of Spark."""
    rows = [r.text for r in documents.orderBy("doc_id").select(F.coalesce("text", F.lit("")).alias("text")).collect()]
    own = [list(dict.fromkeys(w for w in re.split(r"[ \n\t\r,.]", t.lower()) if w)) for t in rows]
    every = sorted({w for ws in own for w in ws})
    df = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("t"))
    hashed = df.select("w", "t", *(F.pmod(F.xxhash64("t", F.lit(k)), F.lit(m)).alias(f"m{k}") for k, m in imatch.subsets())).collect()
    term = {r.w: r.t for r in hashed}
    inside = {r.t: [k for k, _ in imatch.subsets() if r[f"m{k}"] == 0] for r in hashed}
    count: dict = {}
    for ws in own:
        for t in {term[w] for w in ws}:
            count[t] = count.get(t, 0) + 1
    n = len(rows)
    words = {t for t, c in count.items() if c >= 2 and imatch.BAND[0] * n <= c <= imatch.BAND[1] * n}
    lists = []
    for ws in own:
        band = sorted({term[w] for w in ws} & words)
        whole = sorted({term[w] for w in ws})
        lists.append(([[t for t in band if k in inside[t]] for k, _ in imatch.subsets()], whole, bool(band)))
    parts = spark.createDataFrame([(i, *x) for i, x in enumerate(lists)], "i int, parts array<array<bigint>>, whole array<bigint>, some boolean")
    each = F.array(*[F.xxhash64(F.get("parts", k)) for k, _ in imatch.subsets()])
    other = F.array(*[F.xxhash64("whole", F.lit(k)) for k, _ in imatch.subsets()])
    signed = {r.i: r.s for r in parts.select("i", F.when(F.col("some"), each).otherwise(other).alias("s")).collect()}
    shown = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in s)
    got = [r for r in imatch.imatch_edits(documents).orderBy("doc_id").collect()]
    assert [r.fingerprint for r in got] == [shown(signed[i]) for i in range(n)]
    empty = spark.range(1).select(F.xxhash64(F.array().cast("array<bigint>"))).first()[0]
    for i, r in enumerate(got):
        a, b = signed[i], signed[(i - 1) % n]
        told = [(x, y) for x, y in zip(a, b) if not x == y == empty]
        assert r.near_next == pytest.approx(sum(x == y for x, y in told) / len(told) if told else 0.0)


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("a.example.net", "/", "allow"), ("com", "/de/", "block"), ("Sub.Example.com", "/", "allow")]
    hosts = ["net", "example.net", "xexample.net", "a.example.net", "b.a.example.net", "com", "example.com", "sub.example.com", "q.sub.example.com", "org", "", "net.", "a..net", "EXAMPLE.NET"]
    paths = ["", "/", "/en/", "/en/x?y#z", "/de/a", "?q=/en/", "#f", "/EN/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://a.net/://b"] + ["http://example.net/en/"] * 300
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id bigint, url string, host string")

    def plain(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    got = {r.page_id: r for r in url_rules.judge_urls(df, spark.createDataFrame(rules, url_rules.RULE_SCHEMA)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain(u)
        fit = [(len(h) + len(p), h.lower() + p, v) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best[1:]), u
    none = url_rules.judge_urls(df, spark.createDataFrame([], url_rules.RULE_SCHEMA), default="block")
    assert none.where("verdict = 'block' and rule is null").count() == len(urls)
    assert url_rules.judge_urls(df.where("false"), spark.createDataFrame(rules, url_rules.RULE_SCHEMA)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans(documents):
    rng = random.Random(2)
    texts = ["".join(rng.choice("12 0.-+()a@b.%_25") for _ in range(rng.randint(0, 60))) for _ in range(5000)] + [r.text or "" for r in documents.collect()]
    for t in texts:
        base, every = pii.find(t)
        assert base == brute_pii(t) and set(base) <= set(every)


def test_disguises():
    cases = {
        "mail john [at] example [dot] com now": ("email", "john [at] example [dot] com"), "mail john at example dot com now": ("email", "john at example dot com"), "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
        "call +1 two zero two five five five zero one two three": ("phone", "+1 two zero two five five five zero one two three"), "ip one nine two dot one six eight dot zero dot one ok": ("ip", "one nine two dot one six eight dot zero dot one"),
        "４０４１８９４９７４６０８７９５": ("card", "４０４１８９４９７４６０８７９５"), "j​ohn@ex​ample.com": ("email", "j​ohn@ex​ample.com"), "192[.]168[.]0[.]1": ("ip", "192[.]168[.]0[.]1"),
    }
    for text, (kind, part) in cases.items():
        _, every = pii.find(text)
        assert [(k, text[a:b]) for k, a, b in every] == [(kind, part)], text
    for plain in ("look at the dot", "one two three", "at one dot", "all [the] (dots) <at> rest"):
        assert pii.find(plain)[1] == []


def test_shortcut_skips_nothing(monkeypatch):
    rng = random.Random(10)
    words = ["192", "168", "0", "4", "1", "2 2", "point", "dot", "Point", "oh", "nine", "plus", "at", "joe", "mail", "com", "[at]", "(dot", "{.}", "+49", "-", ",", "pointed", "f\u0130ve"]
    texts = ["ip 192 point 168 point 0 point 12 ok", "card oh " + " ".join("4018949746087950"), "call plus 4 oh 1 2 3 4 5 6 7 8 9"]
    texts += [" ".join(rng.choice(words[:24 if i % 2 else 10]) for _ in range(rng.randint(2, 14))) for i in range(40_000)]
    gated = [pii.find(t) for t in texts]
    assert [(k, texts[0][a:b]) for k, a, b in gated[0][1]] == [("ip", "192 point 168 point 0 point 12")]
    monkeypatch.setattr(pii, "_may_spell", lambda text: True)
    assert gated == [pii.find(t) for t in texts]


def test_many_spans_take_linear_time():
    import time

    for unit in ("joe at example dot com, ", "joe@example.com jane at example dot com "):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            base, every = pii.find(unit * n)
            took.append(time.process_time() - began)
            assert len(every) == n * (1 + ("@" in unit)) and set(base) <= set(every)
        assert took[1] < 8 * took[0]


def test_pii_rows(odd_docs):
    rows = {r.doc_id: r for r in pii.find_pii(odd_docs).collect()}
    text = odd_docs.where("doc_id = 9").first().text
    at = text.index("a@b")
    assert rows[9].spans == f"email:{at}:{len(text)}" and rows[9].n_email == 1 and rows[9].base_sha256 == hashlib.sha256(rows[9].spans.encode()).hexdigest()
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in pii.redact_pii(odd_docs).collect()}
    assert clean[9].text.endswith("mail <EMAIL>") and clean[9].n_chars == len(clean[9].text) and clean[2].text is None
    assert pii.redact("ab cd ef", [("ip", 0, 4), ("card", 3, 5), ("email", 6, 8)]) == "<IP> <EMAIL>"
    assert pii.find_pii(odd_docs.where("false")).count() == 0


def test_grammar():
    made = toxicity.Grammar({"idiot": 6.0, "lowe*": 5.0}).prepare()
    found = lambda t: {k: len(v) for k, v in run(t).items() if v}

    def run(text):
        out = {k: [] for k in toxicity.PATTERNS}
        for clause in toxicity._CLAUSE.split(text):
            made.clause(clause, out)
        return out

    assert found("an idiot here") == {"insult": 1} and found("you are an idiot") == {"targeted": 1}
    assert found("you are not an idiot") == {"negated": 1} and found("he said idiot") == {"reported": 1}
    assert found("someone said: idiot") == {"insult": 1} and found("someone said idiot") == {"reported": 1}
    assert found("we will hurt you") == {"threat": 1} and found("it will hurt") == {}
    assert found("loweient (idiot)") == {"insult": 2} and found("not at all so very much an idiot") == {"insult": 1}


def plain_clause(grammar, clause):
    """The grammar said as one loop: what a clause matches."""
    words = toxicity.split_words(clause)
    target = any(w in toxicity.TARGETS for w in words)
    out, negated, reported = [], 0, False
    for w in words:
        weight = max([grammar.lexicon.get(e, 0.0) for e in toxicity.entries(w)])
        if w in toxicity.NEGATIONS:
            negated = toxicity.NEGATED_WORDS + 1
        elif w in toxicity.REPORTS:
            reported = True
        elif w in toxicity.THREATS and target or weight:
            threat = w in toxicity.THREATS and target
            out.append(("negated" if negated else "reported" if reported else "threat" if threat else "targeted" if target else "insult", 1.0 if threat else weight))
        negated -= negated > 0
    return out


def test_composed_grammar_is_the_plain_one():
    made = toxicity.Grammar({"idiot": 6.0, "lowe*": 5.0, "kill": 2.5, "they": 1.5}).prepare()
    rng = random.Random(14)
    words = ["idiot", "lowering", "kill", "hurt", "they", "you", "not", "said", "never", "the", "a", "very", "calls", "(stab)", "we"]
    for _ in range(20_000):
        clause = " ".join(rng.choice(words) for _ in range(rng.randrange(9)))
        found = {k: [] for k in toxicity.PATTERNS}
        made.clause(clause, found)
        want = {k: [x for n, x in plain_clause(made, clause) if n == k] for k in toxicity.PATTERNS}
        assert found == want, clause
        row = made.features(clause)
        assert row[1::3][:5].tolist() == [pytest.approx(np.log1p(len(want[k]))) for k in toxicity.PATTERNS]
        assert row[3::3][:5].tolist() == [pytest.approx(np.log1p(sum(want[k]))) for k in toxicity.PATTERNS]


def test_transducers_alone():
    read = toxicity.negation().read([("negation", False), ("other", True), ("insult", False), ("threat", False), ("insult", False)])
    assert [[sorted(m) for _, _, m in outs] for outs, _ in read] == [[[], [], ["negated"], ["negated"], []]]
    none = frozenset()
    told = toxicity.reported_speech().read([("insult", False, none), ("report", False, none), ("insult", False, none)])
    assert [sorted(x[2]) for x in told[0][0]] == [[], [], ["reported"]]
    for late, marks in ((True, {"targeted"}), (False, set())):
        paths = toxicity.target_in_clause().read([("insult", False, none), ("other", late, none)])
        assert len(paths) == 1 and paths[0][0][0] == ("insult", marks)
    assert toxicity.pattern_names().read([("threat", frozenset({"targeted"})), ("threat", none), ("both", none)]) == [([("threat", False), None, ("insult", True)], 1.0)]
    chained = toxicity.negation() @ toxicity.reported_speech()
    for symbols in ([("negation", False), ("insult", True)], [("report", False), ("both", False), ("negation", True), ("threat", False)]):
        [(mid, _)] = toxicity.negation().read(symbols)
        assert chained.read(symbols) == toxicity.reported_speech().read(mid)
    assert len(toxicity.COMPOSED.starts) == 2 and all(len(x) == 1 for own in toxicity.COMPOSED.arcs.values() for x in own.values())


def test_toxicity_of_no_rows(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nothing = odd_docs.where("false")
    assert toxicity.score_toxicity(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert toxicity.reject_toxic(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_word_beginnings_need_many_words():
    rows = {"loser": 100, "lose*": 110, "loser*": 20, "vequ*": 90, "vequju": 30, "vequno": 35}
    assert [e for e in rows if toxicity.explained(e, rows)] == ["lose*"]


def test_toxicity(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    made = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, made).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.93
    kept = toxicity.reject_toxic(docs, made)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in toxicity.score_toxicity(docs, made).collect())
    odd = toxicity.score_toxicity(odd_docs, made).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        flat = {r.score for r in toxicity.score_toxicity(odd_docs, toxicity.fit(docs, some)).collect()}
        assert len(flat) == 1 and flat.pop() < 0.5


def test_pipeline(spark, tmp_path):
    """Each stage does what its plain version does to what came before."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "pii", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        if name == "simhash_near_dedup":
            own = {r.doc_id: r.text or "" for r in before.collect()}
            shingles = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in own.items() if (w := t.lower().split()) or True}
            pairs = [(a, b) for a in own for b in own if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
            groups = brute_components(pairs, set(own))
            kept = {r.doc_id for r in after.collect()}
            alone = {k for k in own if not any(k in p for p in pairs)}
            assert alone <= kept and {groups[k] for k in own} == {groups[k] for k in kept}
            exact: dict = {}
            for k, t in own.items():
                exact.setdefault(t, []).append(k)
            assert all(sum(k in kept for k in same) <= 1 for same in exact.values())
        if name == "pii":
            assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: pii.redact(r.text, pii.find(r.text)[1]) for r in before.collect()}
        if name == "best_fit_packing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after
    assert corpus_pipeline.run(spark, sf).count() == before.count()
