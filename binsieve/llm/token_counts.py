"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of
from binsieve.llm.encoding import byte_encoder, kept, shared_classes, word_encoder
from binsieve.llm.words import safe_pieces

#: Longest piece of a text that is encoded at once, in characters, and bytes of texts in one step.
PIECE_CHARS, STEP_BYTES = 1 << 18, 1 << 20


def _spaced_pieces(text: str, most: int) -> list[str]:
    """Cut a long text at single spaces between ASCII letters or digits, and leave those spaces out."""
    pieces, begin = [], 0
    plain = lambda c: c.isascii() and c.isalnum()
    while len(text) - begin > most:
        at = begin + most
        while 0 <= (at := text.find(" ", at)) and not (at + 1 < len(text) and plain(text[at - 1]) and plain(text[at + 1])):
            at += 1
        if at < 0:
            break
        pieces.append(text[begin:at])
        begin = at + 1
    pieces.append(text[begin:])
    return pieces


def _spaces_part(model) -> bool:
    """Whether a model begins a piece at every space, and puts a space before a text: then texts may be cut at spaces."""
    mark = "\u2581"
    return all(mark not in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size())) and model.encode("ab cd") == model.encode("ab") + model.encode("cd")


def _counter(path: str, kind: str, classes: np.ndarray):
    """A function from texts to token counts."""
    if kind == "piece":
        import sentencepiece

        model = kept(("piece", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))
        cut = _spaced_pieces if kept(("spaces", path), lambda: _spaces_part(model)) else None
        lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        encoder = (byte_encoder if kind == "byte" else word_encoder)(path, classes)
        # Cuts are before white space, so they go through a special string only if it holds some.
        cut = None if any(c.isspace() for name in encoder.special for c in name) else safe_pieces
        lengths = lambda texts: [len(x) // 4 for x in encoder.encode(texts)]

    def count(texts: list[str]) -> list[int]:
        pieces, owner = [], []
        for i, text in enumerate(texts):
            mine = cut(text, PIECE_CHARS) if cut and len(text) > PIECE_CHARS else [text]
            pieces += mine
            owner += [i] * len(mine)
        return np.bincount(owner, lengths(pieces), len(texts)).astype(np.int64).tolist()

    return count


def kind_of(path: str) -> str:
    """``piece`` for a sentencepiece model, else ``byte`` or ``word`` as the file's word ends tell."""
    if path.endswith(".model"):
        return "piece"
    import json

    with open(path, encoding="utf-8") as f:
        return "word" if json.load(f)["model"].get("end_of_word_suffix") else "byte"


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Count each whole text's bytes and tokens.

    Returns the id column, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``),
    one row for each row in; a null or empty text counts zero. Within an Arrow batch, texts are
    gathered into steps of ``STEP_BYTES`` rather than of equal row counts, and a long text is cut where a
    word is sure to begin, so one long document neither stretches a step nor is encoded as a whole. A stretch without
    such a place stays whole, and so do texts for a sentencepiece model whose pieces go over spaces.
    Ids never leave the worker. No shuffle; other columns are dropped.
    """
    classes = shared_classes(df.sparkSession)
    kind = kind_of(tokenizer)
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        count = _counter(tokenizer, kind, classes.value)
        for batch in sliced(batches, "text", STEP_BYTES):
            texts = texts_of(batch, "text")
            tokens = np.array(count(texts), np.int64)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(tokens), pa.array(tokens > limit)], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"`{id_column}` {source.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
