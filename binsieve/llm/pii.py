"""Personal data by pattern, in plain and in disguised form.

Two transducers rewrite a text and remember where each rewritten stretch came from: the first maps
look-alike characters to ASCII and drops invisible ones; the second, over its output, turns spelled
digits into digits and at/dot disguises into ``@`` and ``.``. The patterns then run over the rewritten
text, and spans that hold a rewritten stretch are mapped back to source characters through both.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import sliced, texts_of
from binsieve.llm.encoding import kept

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ODD = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping ``local@label(.label)+``, found from each ``@`` in linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind. Of digit parts joined by dots, leftmost matching takes four at a time."""
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGITS.search(text):
        return found
    for m in _PARTS.finditer(text):
        if m.end() - m.start() > 6 and len(parts := m.group().split(".")) > 3:
            at = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(map(_part, four)):
                    found["ip"].append((at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _ODD.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_ODD.sub("", m.group())) <= 15:
            found["phone"].append(m.span())
    return found


# Letters of other scripts that look like an ASCII letter, and invisible characters.
LOOK_ALIKES = {
    "а": "a", "А": "A", "В": "B", "е": "e", "Е": "E", "і": "i", "І": "I", "ј": "j", "К": "K", "к": "k", "М": "M", "Н": "H", "о": "o", "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C", "ѕ": "s", "Т": "T", "у": "y", "х": "x", "Х": "X", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "ο": "o", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "ν": "v", "ι": "i",
    "ɑ": "a", "ı": "i", "ⅼ": "l", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "．": ".", "＠": "@", "﹫": "@",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# End of fixed values.


def _plain_letter(c: str) -> str | None:
    """What a single character looks like in ASCII, None if it is no disguise."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in INVISIBLE:
        return ""
    if c.isdigit():
        value = unicodedata.digit(c, None)
        return None if value is None or unicodedata.category(c) != "Nd" else str(value)
    as_ascii = unicodedata.normalize("NFKC", c)
    return as_ascii if len(as_ascii) == 1 and as_ascii.isascii() and as_ascii.isalnum() and c.isalpha() else None


def _letters() -> dict[str, str]:
    """The first transducer's alphabet: full-width forms, mathematical letters, other digits, look-alikes."""
    arcs = {}
    for points in (range(0xA0, 0x3000), range(0xA000, 0xD800), range(0xF900, 0x10000), range(0x10000, 0x1F000)):
        for c in map(chr, points):
            if unicodedata.category(c) in ("Lu", "Ll", "Lm", "Lo", "Nd", "Pd", "Po", "Sm", "Cf") and c not in "ªº":
                if (to := _plain_letter(c)) is not None:
                    arcs[c] = to
    arcs |= {chr(p): chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F)} | {"．": ".", "＠": "@", "。": "."}
    return arcs


_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_GAP = r"(?:[\x20,]+|\x20?-\x20?)"
_BRACKET_AT = r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?"
_BRACKET_DOT = r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?"
_WORD_AT = r"(?<=[A-Za-z0-9])\x20at\x20(?=[A-Za-z0-9-]+(?:\x20dot\x20|\x20?[\[({<]\x20?dot))"
_WORD_DOT = r"(?<=[A-Za-z0-9])\x20dot\x20(?=[A-Za-z0-9-])"
_POINT = rf"(?<=[0-9])\x20(?:dot|point)\x20(?=[0-9]|{_DIGIT}\b)"
_SECOND = re.compile(rf"(?P<at>{_BRACKET_AT}|{_WORD_AT})|(?P<spelled>\b(?:plus\x20)?{_DIGIT}(?:(?:{_GAP}|\x20(?:dot|point)\x20)(?:{_DIGIT}\b|[0-9]))+\b)|(?P<dot>{_BRACKET_DOT}|{_POINT}|{_WORD_DOT})", re.I)
#: Every rewriting but that of a bracketed sign has one of these, as a word.
_HINTS = frozenset(DIGIT_WORDS) | {"dot", "point"}
_BRACKETED = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]", re.I)
_UNIT = re.compile(rf"{_DIGIT}\b|[0-9]|dot|point|plus", re.I)


def _may_spell(text: str) -> bool:
    """Whether the second transducer can rewrite anything: a spelled digit, a dot or point, or a bracketed sign."""
    if any(x in text for x in "[({<") and _BRACKETED.search(text):
        return True
    low = text.replace("İ", "i").lower()
    for word in _HINTS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if not low[at - 1 : at].isalpha() and not low[end : end + 1].isalpha():
                return True
            at = low.find(word, end)
    return False


def _spelled(text: str) -> str:
    """Spelled digits as digits."""
    signs = {"dot": ".", "point": ".", "plus": "+"} | DIGIT_WORDS
    return "".join(signs.get(m.group().lower(), m.group()) for m in _UNIT.finditer(text))


class Rewritten:
    """A rewritten text with the source stretch of each of its own."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        out, self.at, self.stretch, here = [], [], [], 0
        length = 0
        for begin, end, to in edits:
            if begin > here:
                self.at.append(length)
                self.stretch.append((here, begin, False))
                out.append(source[here:begin])
                length += begin - here
            self.at.append(length)
            self.stretch.append((begin, end, True))
            out.append(to)
            length += len(to)
            here = end
        self.at.append(length)
        self.stretch.append((here, len(source), False))
        out.append(source[here:])
        self.text = "".join(out)

    def back(self, begin: int, end: int) -> tuple[int, int, bool]:
        """The source span of [begin, end), and whether it holds a rewritten stretch."""
        first = bisect_right(self.at, begin) - 1
        last = bisect_right(self.at, end - 1) - 1
        a, _, odd = self.stretch[first]
        a = a if odd else a + begin - self.at[first]
        c, d, other = self.stretch[last]
        d = d if other else c + end - self.at[last]
        return a, d, any(x[2] for x in self.stretch[first : last + 1])


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source characters."""
    arcs = kept("look-alikes", _letters)
    edits = []
    if not text.isascii() and (odd := arcs.keys() & set(text)):
        edits = [(m.start(), m.end(), arcs[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, sorted(odd))) + "]", text)]
    first = Rewritten(text, edits)
    more = []
    if _may_spell(first.text):
        for m in _SECOND.finditer(first.text):
            to = "@" if m.lastgroup == "at" else "." if m.lastgroup == "dot" else _spelled(m.group())
            more.append((m.start(), m.end(), to))
    if not edits and not more:
        return []
    second = Rewritten(first.text, more)
    found = []
    for kind, spans in detect(second.text).items():
        for begin, end in spans:
            a, b, odd = second.back(begin, end)
            a, b, too = first.back(a, b)
            if odd or too:
                while a < b and text[a].isspace():
                    a += 1
                found.append((kind, a, b))
    return found


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind as listed and start. Added spans never overlap one of their kind."""
    base = detect(text)
    added: dict[str, list] = {k: [] for k in KINDS}
    # Both lists are in order and without overlaps of their own, so only neighbours can overlap.
    for kind, a, b in sorted(disguised(text), key=lambda s: s[1]):
        own, at = base[kind], bisect_left(base[kind], (a,))
        if (not at or own[at - 1][1] <= a) and (at == len(own) or b <= own[at][0]) and (not added[kind] or added[kind][-1][1] <= a):
            added[kind].append((a, b))
    return [(k, a, b) for k in KINDS for a, b in base[k]], [(k, a, b) for k in KINDS for a, b in sorted(base[k] + added[k])]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in angle brackets."""
    out, here = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= here:
            out += [text[here:a], f"<{kind.upper()}>"]
        here = max(here, b)
    return "".join([*out, text[here:]])


def _shown(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Find personal data in each whole text.

    Returns the id column, counts of all spans ``n_email``, ``n_ip``, ``n_card``, ``n_phone``,
    ``base_sha256`` (of the plain patterns' spans), ``spans`` (all spans, ``kind:start:end`` joined by
    commas, in code points with the end excluded), ``n_disguised`` and the ``redacted`` text. One row
    out for each row in; a null or empty text has no spans; other columns are dropped. No shuffle;
    time is linear in the text, long words and digit runs included.
    """
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                base, every = find(text)
                counts = [sum(k == kind for k, _, _ in every) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every), len(every) - len(base), redact(text, every)))
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_column, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised", "redacted"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_disguised bigint, redacted string")


def redact_pii(df: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The rows with personal data in the text replaced by its kind, and the text's length made right; null stays null."""

    def run(batches):
        for batch in sliced(batches, text_column):
            texts = [t if t is None else redact(t, find(t)[1]) for t in batch.column(text_column).to_pylist()]
            own = {text_column: pa.array(texts, batch.schema.field(text_column).type)}
            if length_column in batch.schema.names:
                lengths = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                own[length_column] = lengths.cast(batch.schema.field(length_column).type)
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

    return df.mapInArrow(run, df.schema)
