"""Vectorised pre-splitting of texts into the words that byte-pair merges work within.

Two published patterns are covered, both as runs of four character classes:

* ``byte``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``word``: ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` with white space dropped

The class of each code point is asked of the tokenizer library's own expression engine, so that
both agree on every Unicode version.
"""

from __future__ import annotations

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library's expressions see it (1.1 MB)."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        hit = np.ones(len(points), bool)
        for _, (a, b) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
            hit[a:b] = False
        table[points[hit]] = kind
    return table


def _contractions(points, kinds, cut, begins, ends, joined):
    """Where a lone apostrophe starts a contraction, take its letters over from the next word."""
    k = np.flatnonzero((kinds == OTHER) & (points[begins] == 39) & (ends - begins == 1) & joined & cut[begins])
    if not len(k):
        return
    k = k[kinds[k + 1] == LETTER]
    p, stop = begins[k], ends[k + 1]
    one = points[p + 1]
    two = points[np.minimum(p + 2, len(points) - 1)]
    two = np.where(p + 2 < stop, two, 0)
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    taken = np.where(np.isin(one, (115, 116, 109, 100)), 1, np.where(long, 2, 0))
    some = taken > 0
    p, stop, taken = p[some], stop[some], taken[some]
    cut[p + 1] = False
    rest = p + 1 + taken
    cut[rest[rest < stop]] = True


def split(texts: list[str], table: np.ndarray, pattern: str) -> tuple[str, list[int], list[int], np.ndarray]:
    """The joined texts, the begin and end of each word in them, and each text's first word number.

    The last array has one more entry than there are texts. Every text is split as if alone.
    """
    whole = "".join(texts)
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=firsts[1:])
    n = len(whole)
    if not n:
        return whole, [], [], np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table[points]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    inner = firsts[1:-1][firsts[1:-1] < n]
    cut[inner] = True
    fresh = np.zeros(n + 1, bool)
    fresh[inner] = True
    fresh[n] = True
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], n)
    kinds = kind[begins]
    joined = ~fresh[ends]  # another run of the same text follows
    if pattern == "byte":
        space = (kinds == SPACE) & joined
        last = ends[space] - 1
        cut[last] = True
        cut[last[points[last] == 32] + 1] = False
        _contractions(points, kinds, cut, begins, ends, joined)
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], n)
    else:
        cut |= kind == NUMBER
        _contractions(points, kinds, cut, begins, ends, joined)
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], n)
        keep = kind[starts] != SPACE
        starts, stops = starts[keep], stops[keep]
    return whole, starts.tolist(), stops.tolist(), np.searchsorted(starts, firsts)


def safe_pieces(text: str, most: int) -> list[str]:
    """Cut a long text after a non-space character that a space, tab or newline follows.

    At such a place a word always begins, whatever stands on either side, so that pieces split as
    the whole does. A stretch without such a place stays whole.
    """
    pieces, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while at < len(text) and not (text[at] in " \t\n" and not text[at - 1].isspace()):
            at += 1
        if at >= len(text):
            break
        pieces.append(text[begin:at])
        begin = at
    pieces.append(text[begin:])
    return pieces
