"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word is read as a symbol: the kinds of the closed word lists it is in,
and whether a learned lexicon of words and word beginnings has it. Four transducers rewrite symbols:
negation marks an insult or threat for some words after it, reported speech to the clause's end, a
target anywhere in the clause, which is guessed at its begin and accepted only if it comes true, and
the last one names the pattern that a marked symbol is: a plain, targeted, negated or reported insult, or a
threat. They are composed into one, whose arcs carry the weights; a match weighs its arcs and its word's
entry in the lexicon. What a text scores is a learned sum over its matched clauses.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of, written

#: Labelled rows the grammar is fitted on: those of smallest hash, so the same ones every time.
LABEL_ROWS = 20_000
#: Lengths of the word beginnings that may stand in the lexicon, besides whole words.
STEMS = (4, 5, 6)
#: A lexicon entry is in this share of the toxic rows at least, and so many times likelier there than elsewhere.
SUPPORT, ODDS, LEAST_ROWS = 0.01, 8.0, 8
#: Different words that an entry comes after in toxic rows, or half as many as it has rows.
CONTEXTS = 10
#: A word beginning has so many times the toxic rows of any longer entry.
GENERAL = 1.5
#: Words for which a negation stays in force.
NEGATED_WORDS = 3

# The closed-class words of the grammar.
TARGETS = frozenset("you your yours yourself u ur they them their he him his she her these those people tu toi vous du dich ihr euch usted vosotros".split())
NEGATIONS = frozenset("not no never nor neither without isn't aren't wasn't don't doesn't didn't ain't nicht kein keine pas jamais nunca".split())
REPORTS = frozenset("said says say called calls claimed claims quoted wrote writes told reported reportedly sagte dit dijo".split())
THREATS = frozenset("kill hurt destroy beat burn shoot stab punch murder hang bomb".split())
# End of fixed values.

_CLAUSE = re.compile(r"[.!?;:\n]+")
_MARKS = b'.!?;:",()[]{}<>*&%$#|=+/\\_~`'
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_QUOTES = "“”„«»"
PATTERNS = ("insult", "targeted", "negated", "reported", "threat")
#: First letters by which a word is looked up: as many as the shortest beginning has.
HEAD = min(STEMS)


def split_words(text: str) -> list[str]:
    """Words between white space and marks."""
    if not text.isascii():
        for c in _QUOTES:
            text = text.replace(c, " ")
    return text.encode("utf-8", "replace").translate(_TO_SPACE).decode().split()


def entries(word: str) -> list[str]:
    """The lexicon entries a word can match: itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Transducer:
    """A weighted finite-state transducer: ``arcs[state][symbol]`` lists (output, next state, weight).

    More arcs than one for a symbol are alternatives; a path counts only if it ends in a final state.
    """

    starts: list
    finals: set
    arcs: dict

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what the other one makes of this one's output; weights add up. States that can't be reached are left out."""
        starts = [(p, q) for p in self.starts for q in other.starts]
        arcs: dict = {}
        open_states = list(starts)
        while open_states:
            if (state := open_states.pop()) in arcs:
                continue
            own = arcs[state] = {}
            p, q = state
            for symbol, firsts in self.arcs[p].items():
                found = [(out, (p2, q2), w + w2) for mid, p2, w in firsts for out, q2, w2 in other.arcs[q].get(mid, ())]
                if found:
                    own[symbol] = found
                    open_states += [to for _, to, _ in found]
        return Transducer(starts, {(p, q) for p, q in arcs if p in self.finals and q in other.finals}, arcs)

    def numbered(self) -> Transducer:
        """The same with states numbered, for speed."""
        number = {state: k for k, state in enumerate(self.arcs)}
        return Transducer([number[s] for s in self.starts], {number[s] for s in self.finals}, {number[s]: {x: [(o, number[t], w) for o, t, w in found] for x, found in own.items()} for s, own in self.arcs.items()})

    def read(self, symbols: list) -> list[tuple[list, float]]:
        """(outputs, weight) of every path that reads all symbols to a final state."""
        paths = [(s, [], 0.0) for s in self.starts]
        for x in symbols:
            paths = [(to, [*outs, out], weight + w) for state, outs, weight in paths for out, to, w in self.arcs[state].get(x, ())]
        return [(outs, weight) for state, outs, weight in paths if state in self.finals]


#: A symbol is (kind, is it a target too, marks so far). ``both`` is a threat that the lexicon has as well.
KINDS = ("other", "negation", "report", "threat", "insult", "both")
SYMBOLS = tuple((kind, target) for kind in KINDS for target in (False, True))
_STRONG = ("threat", "insult", "both")


def negation() -> Transducer:
    """Marks what stands within ``NEGATED_WORDS`` words after a negation; the state counts the words left."""
    arcs: dict = {}
    for left in range(NEGATED_WORDS + 1):
        arcs[left] = {}
        for kind, target in SYMBOLS:
            marks = frozenset({"negated"}) if left and kind in _STRONG else frozenset()
            arcs[left][kind, target] = [((kind, target, marks), NEGATED_WORDS if kind == "negation" else max(0, left - 1), 0.0)]
    return Transducer([0], set(arcs), arcs)


def _marked(*names: str) -> list:
    """Symbols with every choice of these marks."""
    sets = [frozenset(n for k, n in enumerate(names) if chosen >> k & 1) for chosen in range(1 << len(names))]
    return [(kind, target, marks) for kind, target in SYMBOLS for marks in sets]


def reported_speech() -> Transducer:
    """Marks what comes after a word of reported speech."""
    arcs: dict = {False: {}, True: {}}
    for told in arcs:
        for kind, target, marks in _marked("negated"):
            more = marks | {"reported"} if told and kind in _STRONG else marks
            arcs[told][kind, target, marks] = [((kind, target, more), told or kind == "report", 0.0)]
    return Transducer([False], {False, True}, arcs)


def target_in_clause() -> Transducer:
    """Marks everything strong in a clause with a target: ``none`` reads none, ``awaited`` has to come to ``met``."""
    arcs: dict = {"none": {}, "awaited": {}, "met": {}}
    for state in arcs:
        for kind, target, marks in _marked("negated", "reported"):
            if state == "none" and target:
                continue
            more = marks if state == "none" or kind not in _STRONG else marks | {"targeted"}
            arcs[state][kind, target, marks] = [((kind, more), "met" if target else state, 0.0)]
    return Transducer(["none", "awaited"], {"none", "met"}, arcs)


def pattern_names() -> Transducer:
    """Names the pattern: a threat needs a target, and is an insult without one if the lexicon has it; a negation goes before reported speech.

    Outputs are (pattern, does the lexicon's weight count) or None; a threat's arc weighs one by itself.
    """
    arcs: dict = {}
    for kind, _, marks in _marked("negated", "reported"):
        for seen in (marks, marks | {"targeted"}):
            aimed = "targeted" in seen
            threat = kind in ("threat", "both") and aimed
            plain = "threat" if threat else "targeted" if aimed else "insult"
            name = "negated" if "negated" in seen else "reported" if "reported" in seen else plain
            out = (name, not threat) if threat or kind in ("insult", "both") else None
            arcs[kind, seen] = [(out, 0, 1.0 if threat else 0.0)]
    return Transducer([0], {0}, {0: arcs})


#: The composed grammar: each word of a clause to the pattern it matches.
COMPOSED = (negation() @ reported_speech() @ target_in_clause() @ pattern_names()).numbered()


@dataclass
class Grammar:
    """Weights of the insult lexicon, and of the matched patterns in a text's score."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    heads: frozenset = frozenset()

    def prepare(self) -> Grammar:
        """The first letters of everything that can start a match: a word without them has no arc."""
        self.heads = frozenset(x.rstrip("*")[:HEAD] for x in [*self.lexicon, *THREATS])
        return self

    def insult(self, word: str) -> float:
        get = self.lexicon.get
        return max((get(x, 0.0) for x in entries(word)), default=0.0)

    def symbol(self, word: str) -> tuple[tuple[str, bool], float]:
        """A word's symbol, and its weight in the lexicon."""
        target = word in TARGETS
        if word in NEGATIONS:
            return ("negation", target), 0.0
        if word in REPORTS:
            return ("report", target), 0.0
        weight = self.insult(word)
        return ("both" if weight and word in THREATS else "threat" if word in THREATS else "insult" if weight else "other", target), weight

    def clause(self, clause: str, found: dict[str, list[float]]) -> None:
        """Run the composed transducer over one clause; matched patterns and weights go to found."""
        read = [self.symbol(word) for word in split_words(clause)]
        arcs = COMPOSED.arcs
        for start in COMPOSED.starts:
            state, matches = start, []
            for symbol, weight in read:
                # From each start there is one path: only the choice of the start is a guess.
                if (arc := arcs[state].get(symbol)) is None:
                    break
                (out, state, own) = arc[0]
                if out is not None:
                    matches.append((out[0], own + (weight if out[1] else 0.0)))
            else:
                if state in COMPOSED.finals:
                    for name, weight in matches:
                        found[name].append(weight)

    def features(self, text: str) -> np.ndarray:
        """For each pattern, how many matches and their weight, damped, and an intercept."""
        found: dict[str, list[float]] = {k: [] for k in PATTERNS}
        low = text.lower()
        heads = self.heads
        if not heads.isdisjoint([w[:HEAD] for w in split_words(low)]):
            for clause in _CLAUSE.split(low):
                if not heads.isdisjoint([w[:HEAD] for w in split_words(clause)]):
                    self.clause(clause, found)
        row = [1.0]
        for k in PATTERNS:
            row += [math.log1p(len(found[k])), min(1.0, max(0, len(found[k]) - 1)), math.log1p(sum(found[k]))]
        every = sum(map(len, found.values()))
        return np.array([*row, float(every > 0), float(every > 1), math.log1p(sum(map(sum, found.values())))])

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        z = float(self.features(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0.

    The labels that are kept are those of smallest hash of the id, a document labelled twice counts
    as toxic if one label says so, and null labels or ids don't count. Their number is bounded, so
    they are broadcast and the documents are scanned once.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def _count_entries(batches):
    """Documents that have each entry, by label, and as a bit set the words it came after; added up before they leave the worker."""
    held: dict[tuple[str, int], list[int]] = {}

    def out():
        keys = list(held)
        after = np.array([x[1] for x in held.values()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array(after)], names=["entry", "toxic", "n", "after"])

    for batch in batches:
        for text, toxic in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist()):
            words = split_words(text.lower())
            mine: dict[str, int] = {}
            for before, word in zip(["", *words], words):
                bit = 1 << (zlib.crc32(before.encode()) & 63)
                for e in entries(word):
                    mine[e] = mine.get(e, 0) | bit
            for e, bits in mine.items():
                if (x := held.get((e, toxic))) is None:
                    held[e, toxic] = [1, bits]
                else:
                    x[0] += 1
                    x[1] |= bits
            if len(held) > 1_000_000:
                yield out()
                held.clear()
    if held:
        yield out()


def explained(entry: str, rows_with: dict[str, int]) -> bool:
    """Whether a word beginning owes most of its toxic rows to one longer entry, and so tells nothing of other words."""
    if not entry.endswith("*"):
        return False
    begin = entry[:-1]
    longer = [n for e, n in rows_with.items() if e.startswith(begin) and len(e.rstrip("*")) > len(begin)]
    return max(longer, default=0) * GENERAL > rows_with[entry]


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> Grammar:
    """Learn the lexicon and the pattern weights; without both kinds of label every score is the toxic share."""
    train = written(training_rows(docs, labels, rows).repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism)), "toxicity-training")
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1) if bad + good else 0.0
        empty = Grammar().prepare()
        empty.weights = np.append(math.log(share / (1 - share)) if share else -40.0, np.zeros(len(empty.features("")) - 1))
        return empty
    least = max(LEAST_ROWS, math.ceil(SUPPORT * bad))
    bad_rows, good_rows = F.col("toxic") == 1, F.col("toxic") == 0
    counts = train.mapInArrow(_count_entries, "entry string, toxic int, n bigint, after bigint").groupBy("entry")
    counts = counts.agg(F.sum(F.when(bad_rows, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(good_rows, F.col("n")).otherwise(0)).alias("good"), F.bit_count(F.bit_or(F.when(bad_rows, F.col("after")).otherwise(F.lit(0).cast("bigint")))).alias("contexts"))
    # At most (entries of a row) / SUPPORT entries can reach this support, however many rows there are. A word that
    # copies of one text share always comes after the same words; an insult comes after many.
    often = (F.col("bad") >= least) & (F.col("contexts") >= F.least(F.lit(CONTEXTS), F.col("bad") / 2))
    chosen = counts.where(often).where((F.col("bad") + 0.5) / (bad + 1) >= ODDS * (F.col("good") + 0.5) / (good + 1)).collect()
    rows_with = {r["entry"]: r["bad"] for r in chosen}
    chosen = [r for r in chosen if not explained(r["entry"], rows_with)]
    grammar = Grammar({r["entry"]: math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1)) for r in chosen}).prepare()

    def rows_of(batches):
        for batch in batches:
            x = np.array([grammar.features(t) for t in texts_of(batch, "text")])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic")], names=["x", "y"])

    table = train.mapInArrow(rows_of, "x array<double>, y int").toArrow()
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(table.num_rows, -1)
    grammar.weights = _logistic(x, table.column("y").to_numpy().astype(float))
    return grammar


def score_toxicity(df: DataFrame, grammar: Grammar, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score each whole text: id column, ``held_out`` (crc32 of the id mod 5 is 0), ``score``, ``predicted``.

    The score depends on the text alone. One row out for each row in; null and empty texts score as
    texts without a match; a null id is not held out; other columns are dropped. No shuffle; the
    grammar, of bounded size, goes to the executors.
    """
    model = df.sparkSession.sparkContext.broadcast(grammar)
    source = df.select(F.col(id_column).alias("id"), F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        own = model.value
        for batch in sliced(batches, "text"):
            score = np.array([own.score(t) for t in texts_of(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_column, "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"`{id_column}` {source.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def reject_toxic(df: DataFrame, grammar: Grammar, text_column: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns."""
    model = df.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        own = model.value
        for batch in sliced(batches, text_column):
            yield batch.filter(pa.array([own.score(t) < 0.5 for t in texts_of(batch, text_column)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
