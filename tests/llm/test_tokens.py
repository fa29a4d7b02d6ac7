import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from binsieve.llm import words
from binsieve.llm.bpe_automaton import MergeAutomaton, bpe_round_trip, compile_file
from binsieve.llm.bpe_automaton import encoder as automaton_encoder
from binsieve.llm.common import sliced
from binsieve.llm.encoding import byte_encoder, word_encoder
from binsieve.llm.packing import pack_documents, places, plan
from binsieve.llm.token_counts import token_counts
from binsieve.llm.token_files import EliasFano, block_bytes, read_block, read_token_files, shard_bounds, token_files_round_trip, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {BYTE: Tokenizer.from_file(BYTE), WORD: Tokenizer.from_file(WORD)}
TABLE = words.classes()
MAKE = {BYTE: byte_encoder, WORD: word_encoder}


def num(x):
    return -1 if x is None else x


def library(path, text):
    return np.array(LIBRARY[path].encode(text or "", add_special_tokens=False).ids, "<u4")


def odd_texts(n):
    rng = random.Random(5)
    parts = ["'", " ", "\n", "\t", "s", "re", "'ll", "d", "ve", "A", "é", "Σ", "ß", "1", "²", "!", "--", "__", " ", "　", "漢", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "é", "\r\n", "  ", " '", "''", "aaaa", "====", "the", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["a" * 300, "-=" * 100, " " * 50, ""]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoders_match_the_library(path, documents):
    texts = odd_texts(3000) + [r.text or "" for r in documents.select("text").collect()]
    for text, got in zip(texts, MAKE[path](path, TABLE).encode(texts)):
        assert np.array_equal(np.frombuffer(got, "<u4"), library(path, text)), text[:100]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for path, make in MAKE.items():
        assert np.array_equal(np.frombuffer(make(path, TABLE).encode([text])[0], "<u4"), library(path, text))


def test_automaton_matches_and_decodes():
    compiled = compile_file(BYTE)
    encode, automaton = automaton_encoder("test", TABLE, compiled)
    texts = odd_texts(2000)
    for text, got in zip(texts, encode.encode(texts)):
        ids = np.frombuffer(got, "<u4")
        assert np.array_equal(ids, library(BYTE, text))
        assert automaton.decode(ids).decode() == LIBRARY[BYTE].decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.text("abc", max_size=24))
def test_automaton_of_any_merges(pairs, word):
    labels, merges = [b"a", b"b", b"c"], []
    for u, v in pairs:
        u, v = u % len(labels), v % len(labels)
        if labels[u] + labels[v] not in labels:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    made = MergeAutomaton(labels, merges)
    ids = [labels.index(c.encode()) for c in word]
    for u, v, w in merges:  # byte-pair encoding, said plainly
        out = []
        for x in ids:
            if out and out[-1] == u and x == v:
                out[-1] = w
            else:
                out.append(x)
        ids = out
    assert made.encode(word.encode()) == ids


def test_table_of_arcs():
    """The compiled table alone: its size, and that an arc is where the library keeps two tokens apart."""
    automaton, _ = compile_file(BYTE)
    assert automaton.states == 14639 and len(automaton.table) == 10482 * automaton.stride and len(automaton.table) < 20e6
    assert automaton.arcs() == 713_346_705
    rng = random.Random(3)
    model = LIBRARY[BYTE].model
    vocab = {t: i for t, i in LIBRARY[BYTE].get_vocab().items() if i != 50256}
    shown = {i: t for t, i in vocab.items()}
    for _ in range(20_000):
        a, b = rng.randrange(50_256), rng.randrange(50_256)
        apart = [t.id for t in model.tokenize(shown[a] + shown[b])] == [a, b]
        assert (automaton.step(automaton.state[a], b) >= 0 if automaton.state[a] >= 0 else False) == apart


def test_long_words_take_linear_time():
    automaton, _ = compile_file(BYTE)
    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        ids = automaton.encode(b"xqa" * n)
        took.append(time.process_time() - began)
        assert b"".join(automaton.labels[i] for i in ids) == b"xqa" * n
    assert took[1] < 3.5 * took[0]


def test_round_trip_query(odd_docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(odd_docs, BYTE).collect())
    want = []
    for r in odd_docs.collect():
        ids = library(BYTE, r.text)
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(LIBRARY[BYTE].decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    kept = {r.doc_id: (r.ids, r.decoded) for r in bpe_round_trip(odd_docs.where("doc_id = 9"), BYTE, keep_ids=True).collect()}
    assert kept[9][1] == odd_docs.where("doc_id = 9").first().text
    assert bpe_round_trip(odd_docs.where("false"), BYTE).count() == 0


def test_counts(odd_docs, monkeypatch):
    for path in (BYTE, WORD, public_tokenizers.path("piece_bpe_32k.model")):
        got = sorted((num(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd_docs, path, 100).collect())
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda t: len(model.encode(t))
        else:
            count = lambda t: len(library(path, t))
        assert got == sorted((num(r.doc_id), len((r.text or "").encode()), n := count(r.text or ""), n > 100) for r in odd_docs.collect())
    assert token_counts(odd_docs.where("false"), BYTE).count() == 0


def test_long_texts_of_every_kind_of_file(spark, monkeypatch):
    """Cut into short pieces, texts count as the library counts them whole."""
    import sentencepiece

    from binsieve.llm import token_counts as module

    monkeypatch.setattr(module, "PIECE_CHARS", 40)
    rng = random.Random(9)
    parts = ["word", " ", "\n", "  ", "'s", ",", "é", "<|endoftext|>", "\t", "a1 b2", "e\u0301 \u0301x", "Σ ", "\u2581", " the end", "漢字"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["x" * 1000, "a b " * 300]
    for path in (BYTE, WORD, public_tokenizers.path("piece_bpe_32k.model")):
        kind = module.kind_of(path)
        if kind == "piece":
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            assert module._spaces_part(model)
            want = [len(model.encode(t)) for t in texts]
        else:
            want = [len(library(path, t)) for t in texts]
        assert module._counter(path, kind, TABLE)(texts) == want


def test_slices_are_balanced_by_bytes():
    import pyarrow as pa

    texts = [None, "", "é" * 30, "a" * 500, "b", "c" * 39, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["text", "n"])
    got = [x.to_pydict() for x in sliced([batch, batch.slice(0, 0)], "text", 100)]
    assert [t for g in got for t in g["text"]] == texts and [n for g in got for n in g["n"]] == list(range(7))
    assert [len(g["n"]) for g in got] == [3, 1, 3]


def test_safe_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "\n", "  ", "'s", ",", "é"]) for _ in range(3000))
    pieces = words.safe_pieces(text, 50)
    assert "".join(pieces) == text and len(pieces) > 50
    assert sum(len(library(BYTE, p)) for p in pieces) == len(library(BYTE, text))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_uses_the_histogram_up(histogram):
    made = plan(histogram, 64)
    used: dict[int, int] = {}
    for pattern, n in made:
        assert n > 0 and sum(pattern) <= 64
        for length in pattern:
            used[length] = used.get(length, 0) + n
    assert used == histogram
    sequences = sum(n for _, n in made)
    assert sequences >= -(-sum(k * n for k, n in histogram.items()) // 64)
    first, before, sequence, offset = places(made, 64)
    assert len(before) == sum(len(p) for p, _ in made)


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        k = min(1024, max(1, int(rng.lognormvariate(5.5, 1))))
        histogram[k] = histogram.get(k, 0) + 1
    bound = -(-sum(k * n for k, n in histogram.items()) // 1024)
    assert sum(n for _, n in plan(histogram, 1024)) <= 1.002 * bound + 1


def test_packing(odd_docs):
    rows = pack_documents(odd_docs, BYTE, limit=64, end_id=2, keep_ids=True).collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(ids.tobytes()) == r.ids_crc32
    for places_ in by_sequence.values():
        at = 0
        for offset, length in sorted(places_):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted((num(r.doc_id), *np.append(library(BYTE, r.text), 2).tolist()) for r in odd_docs.where("doc_id is null or doc_id <> 5").collect())
    docs: dict = {}
    for r in sorted(rows, key=lambda r: (num(r.doc_id), r.piece)):
        if r.doc_id != 5:
            docs.setdefault(num(r.doc_id), []).extend(r.ids)
    assert sorted((k, *v) for k, v in docs.items()) == want
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * (len(library(BYTE, odd_docs.where("doc_id = 1").first().text)) + 1)
    assert pack_documents(odd_docs.where("false"), BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=1500))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    code = EliasFano.of(values)
    assert np.array_equal(code.values(), values)
    for i in range(0, len(values), 97):
        assert code.select(i) == values[i]


@pytest.mark.parametrize("wide", [False, True])
def test_blocks(wide):
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 300, 2)]
    docs, known, code, tokens = read_block(block_bytes(np.array([4, 0, 9]), np.array([True, False, True]), ids, wide))
    assert docs.tolist() == [4, 0, 9] and known.tolist() == [True, False, True] and code.values().tolist() == [1, 301, 303] and tokens.dtype.itemsize == (4 if wide else 2)
    with pytest.raises(ValueError):
        read_block(b"x" * 60)


def test_token_files(spark, odd_docs, tmp_path):
    rows = token_files_round_trip(odd_docs, WORD).collect()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    want = {r.doc_id: zlib.crc32(np.append(library(WORD, r.text), 2).astype("<u4").tobytes()) for r in odd_docs.collect()}
    assert all(r.ids_crc32 == want[r.doc_id] for r in rows)
    path = str(tmp_path / "files")
    write_token_files(odd_docs.where("doc_id = 1"), path, WORD, wide=True, shards=2)
    assert read_token_files(spark, path, keep_ids=True).first().ids == [*library(WORD, odd_docs.where("doc_id = 1").first().text).tolist(), 2]
    assert token_files_round_trip(odd_docs.where("false"), WORD).count() == 0


def test_single_documents_are_selected(spark, odd_docs, documents, tmp_path):
    """A lookup gives the rows that reading everything gives for these ids, the first and last of a block included."""
    both = odd_docs.select("doc_id", "text").union(documents.select(documents.doc_id + 100, "text"))
    path = str(tmp_path / "files")
    write_token_files(both, path, WORD, shards=3)
    every = read_token_files(spark, path, keep_ids=True).collect()
    for ids in ([1, 5, 8], [r.doc_id for r in every if r.doc_id is not None], [10**9], []):
        got = read_token_files(spark, path, keep_ids=True, only=ids).collect()
        assert sorted(got, key=lambda r: r.start) == sorted((r for r in every if r.doc_id in ids), key=lambda r: r.start)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=700), st.randoms())
def test_select_of_many(steps, rng):
    values = np.cumsum(np.array(steps, np.int64))
    code = EliasFano.of(values)
    numbers = np.array([rng.randrange(len(values)) for _ in range(50 if len(values) else 0)], np.int64)
    assert np.array_equal(code.selects(numbers), values[numbers] if len(values) else values) and np.array_equal(code.selects(np.arange(len(values))), values)
    assert [code.select(i) for i in numbers.tolist()] == code.selects(numbers).tolist()


def test_block_refuses_what_it_cannot_hold():
    one = [np.array([70_000], "<u4").tobytes()]
    with pytest.raises(ValueError):
        block_bytes(np.array([1]), np.array([True]), one, False)
    assert read_block(block_bytes(np.array([1]), np.array([True]), one, True))[3].tolist() == [70_000]
    two = [np.arange(2, dtype="<u4").tobytes()] * 2
    for ids in ([2, 1], [-(2**62), 2**62]):
        with pytest.raises(ValueError):
            block_bytes(np.array(ids), np.array([True, True]), two, False)
    docs = 10**15 + np.arange(5000) * 3
    data = block_bytes(docs, np.ones(5000, bool), [b"\1\0\0\0"] * 5000, False)
    assert np.array_equal(read_block(data)[0], docs) and len(data) < 5000 * (2 + 1.5)


def test_width_comes_from_the_vocabulary(spark, tmp_path):
    """A vocabulary of 70,000 tokens: wide by itself, an error when asked to be narrow."""
    import json

    with open(WORD, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["vocab"] |= {f"unused{k}": 49_408 + k for k in range(70_000 - 49_408)}
    file["added_tokens"][1]["id"] = 69_999
    file["model"]["vocab"].pop("unused20591")
    path = str(tmp_path / "wide.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    docs = spark.createDataFrame([(-(2**62), "a b"), (2**62, "<|endoftext|> c"), (None, None)], "doc_id bigint, text string")
    write_token_files(docs, str(tmp_path / "files"), path, end_id=66_000)
    rows = {r.doc_id: r.ids for r in read_token_files(spark, str(tmp_path / "files"), keep_ids=True).collect()}
    assert rows[2**62][0] == 69_999 and all(ids[-1] == 66_000 for ids in rows.values()) and set(rows) == {None, -(2**62), 2**62}
    for options in ({"tokenizer": path}, {"tokenizer": WORD, "end_id": 70_000}):
        with pytest.raises(ValueError):
            write_token_files(docs, str(tmp_path / "narrow"), wide=False, **options)


def test_shards_have_equal_bytes(spark):
    """Long documents at one end of the ids don't make one shard long."""
    rows = [(i, "x" * (5000 if i < 400 else 10)) for i in range(4000)]
    source = spark.createDataFrame(rows, "id bigint, text string")
    bounds, shard_of = shard_bounds(source, 8)
    size = np.zeros(8, np.int64)
    for i, text in rows:
        size[shard_of[np.searchsorted(bounds, i, side="right")]] += len(text)
    assert size.max() < 1.6 * size.mean() and size.min() > 0
    assert len(np.unique(shard_bounds(source, None)[1])) == 1


def test_shards_are_stored_in_small_parts(spark, tmp_path):
    """Neither a block nor a row group of a shard of 12 MB holds the whole shard, and all documents come back from them."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    with open(WORD, encoding="utf-8") as f:
        vocabulary = [x[:-4] for x in json.load(f)["model"]["vocab"] if x.endswith("</w>") and x[:-4].isascii() and x[:-4].isalpha()]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(vocabulary, 20_000)) for _ in range(300)]
    pq.write_table(pa.table({"doc_id": range(300), "text": texts}), str(tmp_path / "docs.parquet"))
    path = tmp_path / "files"
    write_token_files(spark.read.parquet(str(tmp_path / "docs.parquet")), str(path), WORD, shards=1)
    (file,) = path.glob("*.parquet")
    stored = pq.ParquetFile(file)
    groups = [stored.metadata.row_group(k).total_byte_size for k in range(stored.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 0.8 * sum(groups)
    assert max(len(x) for x in stored.read(["data"])["data"].to_pylist()) < 1 << 19
    rows = sorted(read_token_files(spark, str(path)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(300)) and [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    for k in (0, 149, 299):
        assert rows[k].ids_crc32 == zlib.crc32(np.append(library(WORD, texts[k]), 2).astype("<u4").tobytes())
