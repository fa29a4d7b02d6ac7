"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that accepts exactly the token
sequences BPE produces. It starts as one state with a loop for every byte; each merge (u, v) -> w, in
order of rank, is one gadget: the state that u leads to is copied without its v arc and u is led to
the copy, and every state with a u arc gets a w arc to where u, v led. A token leads to one state
from everywhere, so the transition table says which tokens each state has an arc for, one bit an arc.
States that no token leads to any more are used again, and tokens that the same states have arcs for share a column:
a vocabulary of 50,257 tokens has 14,639 states, 10,482 columns and 7.1e8 arcs in 19 MB.

Words are encoded by table-driven transitions: as a part of an accepted path is accepted too, each place in a
word is reached by one token, the one whose arc leaves the state reached where the token begins. Which tokens end
at a place is told by a second table, of transitions over bytes.
Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of
from binsieve.llm.encoding import WordEncoder, byte_letters, kept, packed, shared_classes, special_tokens

class MergeAutomaton:
    """The automaton of a byte-level BPE vocabulary: ``labels[id]`` bytes and (left, right) id merges.

    ``state[id]`` is where a token leads, -1 for a token that is never made; ``table`` has a column of ``stride``
    bytes for each ``column[id]``, with one bit for each state that has an arc for the token.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self._compile(merges)
        self.by_label = {label: t for t, label in enumerate(labels) if self.state[t] >= 0 and label}
        self._suffixes()

    def _suffixes(self) -> None:
        """Aho-Corasick transitions over the labels' bytes: which tokens end at a place, longest first.

        ``goto`` has a node's arcs by ``node << 8 | byte``, ``fail`` the node of its longest proper suffix, ``token``
        the one whose label it spells or -1, and ``shorter`` the next shorter suffix that is a label.
        """
        self.goto: dict[int, int] = {}
        parent, letter, self.depth, self.token = [0], [0], [0], [-1]
        for label, number in self.by_label.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                if (to := self.goto.get(key)) is None:
                    to = self.goto[key] = len(parent)
                    parent.append(node)
                    letter.append(byte)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = to
            self.token[node] = number
        self.fail, self.shorter = [0] * len(parent), [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=self.depth.__getitem__):
            if parent[node]:
                at = self.fail[parent[node]]
                while (to := self.goto.get(at << 8 | letter[node])) is None and at:
                    at = self.fail[at]
                self.fail[node] = to or 0
            suffix = self.fail[node]
            self.shorter[node] = suffix if self.token[suffix] >= 0 else self.shorter[suffix]

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """Build the table gadget by gadget: ``bits[t >> 3, s]`` has bit ``t & 7`` if state s has an arc for token t."""
        n, made = len(self.labels), set()
        bits = np.zeros(((n + 7) // 8, 1 << 10), np.uint8)
        state, led = np.full(n, -1, np.int64), np.zeros(1 << 10, np.int64)
        for token, label in enumerate(self.labels):
            if len(label) == 1:
                bits[token >> 3, 0] |= 1 << (token & 7)
                state[token] = 0
                led[0] += 1
        free = list(range(len(led) - 1, 0, -1))
        led[0] += 1  # a word begins there
        for u, v, w in merges:
            if w in made:
                raise ValueError(f"two merges make token {w}")
            made.add(w)
            own, target = state[u], state[v]
            # Where a part is never made, or the parts never meet any more, there is no arc to withdraw.
            if own < 0 or target < 0 or not bits[v >> 3, own] >> (v & 7) & 1:
                continue
            if led[own] > 1 or u == v:
                if not free:
                    more = len(led) // 2
                    free = list(range(len(led) + more - 1, len(led) - 1, -1))
                    bits, led = np.pad(bits, ((0, 0), (0, more))), np.pad(led, (0, more))
                copy = free.pop()
                bits[:, copy] = bits[:, own]
                led[own] -= 1
                led[copy] = 1
                state[u] = own = copy
            bits[v >> 3, own] &= 0xFF ^ (1 << (v & 7))
            bits[w >> 3] |= (bits[u >> 3] >> np.uint8(u & 7) & np.uint8(1)) << np.uint8(w & 7)
            state[w] = target
            led[target] += 1
        live, numbers = np.unique(state[state >= 0], return_inverse=True)
        state[state >= 0] = numbers
        bits = np.ascontiguousarray(bits[:, live])
        columns: dict[bytes, int] = {}
        self.column = [columns.setdefault(np.packbits(bits[t >> 3] >> np.uint8(t & 7) & np.uint8(1), bitorder="little").tobytes(), len(columns)) for t in range(n)]
        self.state, self.stride, self.states = state.tolist(), (len(live) + 7) // 8, len(live)
        self.table = b"".join(columns)

    def arcs(self) -> int:
        """How many arcs the table stands for."""
        of_column = [int.from_bytes(self.table[k : k + self.stride], "little").bit_count() for k in range(0, len(self.table), self.stride)] if self.stride else []
        return sum(of_column[c] for c, s in zip(self.column, self.state) if s >= 0)

    def step(self, state: int, token: int) -> int:
        """Where the arc for a token leads from a state, -1 if there is none."""
        if self.state[token] < 0 or not self.table[self.column[token] * self.stride + (state >> 3)] >> (state & 7) & 1:
            return -1
        return self.state[token]

    def encode(self, word: bytes) -> list[int]:
        """The one accepted path whose labels spell the word: at each place, of the tokens that end there the one that the table allows."""
        whole = self.by_label.get(word)
        if whole is not None:
            return [whole]
        state, column, table, stride = self.state, self.column, self.table, self.stride
        goto, fail, shorter, token_of, depth = self.goto, self.fail, self.shorter, self.token, self.depth
        into, node = [0], 0
        for at, byte in enumerate(word, 1):
            while (to := goto.get(node << 8 | byte)) is None:
                if not node:
                    raise ValueError(f"no token for byte {byte}")
                node = fail[node]
            node = to
            end = node if token_of[node] >= 0 else shorter[node]
            while (length := depth[end]) < at:
                token, before = token_of[end], state[into[at - length]]
                if table[column[token] * stride + (before >> 3)] >> (before & 7) & 1:
                    break
                if not (end := shorter[end]):
                    raise ValueError(f"no token for byte {byte}")
            into.append(token_of[end])
        path, at = [], len(word)
        while at:
            path.append(into[at])
            at -= len(self.labels[into[at]])
        return path[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, in order."""
        return b"".join(map(self.labels.__getitem__, ids.tolist()))


def compile_file(path: str) -> tuple[MergeAutomaton, dict[str, int]]:
    """The automaton of a byte-level BPE file, with its special tokens as arcs of their own."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = {c: b for b, c in byte_letters().items()}
    vocab, special = file["model"]["vocab"], special_tokens(path)
    labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for shown, number in vocab.items():
        if shown not in special:
            labels[number] = bytes(letters[c] for c in shown)
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in file["model"]["merges"]]
    made = MergeAutomaton(labels, merges)
    for name, number in special.items():
        made.labels[number] = name.encode()
    return made, special


def encoder(path: str, classes: np.ndarray, compiled) -> tuple[WordEncoder, MergeAutomaton]:
    automaton, special = compiled

    def ask(word: str) -> bytes:
        return packed(automaton.encode(word.encode()))

    return kept(("automaton", path), lambda: (WordEncoder(ask, classes, "byte", special), automaton))


def bpe_round_trip(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns the id column, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256`` (the decoded text in UTF-8), and with ``keep_ids`` also ``ids`` and
    ``decoded``. One row out for each row in, in no order; a null or empty text has no tokens; other
    columns are dropped, whatever their names. No shuffle; the automaton is compiled by the driver
    and its table, of a size that the vocabulary alone fixes, is sent to the executors.
    """
    spark = df.sparkSession
    compiled = spark.sparkContext.broadcast(kept(("compiled", tokenizer), lambda: compile_file(tokenizer)))
    classes = shared_classes(spark)
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        words, automaton = encoder(tokenizer, classes.value, compiled.value)
        for batch in sliced(batches, "text"):
            rows: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for ids in words.encode(texts_of(batch, "text")):
                numbers = np.frombuffer(ids, "<u4")
                decoded = automaton.decode(numbers).decode("utf-8", "replace")
                rows["n_tokens"].append(len(numbers))
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    rows["ids"].append(numbers.astype(np.int32))
                    rows["decoded"].append(decoded)
            out = [batch.column("id"), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema + (", ids array<int>, decoded string" if keep_ids else ""))
