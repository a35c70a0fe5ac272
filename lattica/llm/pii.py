"""Personal data, found in plain and in disguised form, with spans in the source text.

Base matches are taken on the text itself, leftmost and non-overlapping per kind. Then a chain of
transducers rewrites the text while each output character keeps the source range it came from:
homoglyphs and full-width forms become ASCII and invisible characters go; spelled digits become
digits; ``[at]``, ``(dot)`` and their spoken forms become ``@`` and ``.``. What the same detectors
find in the rewritten text is mapped back to source characters, and is added where it overlaps no
base match of its kind.

A rewritten text is only looked at where it differs: a match counts if its range holds a rewritten
character. Spoken forms ask for more: a lone ``at`` counts only between words with a ``dot`` after
it, a spelled digit only in a run of seven digits or more, so that prose is left alone.

Defined cases: null and empty texts have no span (n_* 0, empty digest string hashed); null doc_id
passes through; repeated rows are judged each for itself; an empty table gives no row. Every
pattern takes time in proportion to the text: local parts of addresses are read from their ``@``
backwards, runs of digits are never entered in the middle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bound_arrow, map_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15]


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind as listed."""
    found = [(a, KINDS.index(kind), b) for kind, f in zip(KINDS, (emails, ips, cards, phones), strict=True) for a, b in f(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


# --- transducers -------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin one (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "·": ".",
}
_INVISIBLE = "​‌‍⁠﻿­"
#: Spelled digits (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): "" for c in _INVISIBLE}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " ", 0xA0: " ", 0x202F: " ", 0x2007: " "}
    for c in range(0x80, 0x1FBFA):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = str(d)
    return table


_FOLD = _fold_table()
_FOLDABLE = frozenset(map(chr, _FOLD))
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: A run of digits, spelled ones among them, parted by spaces, hyphens or commas; seven or more.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_DIGIT})(?!\w)|[0-9])(?:[ ,.()-]{{0,2}}(?:(?<!\w)(?:{_DIGIT})(?!\w)|[0-9])){{6,}}", re.I)
_ONE = re.compile(rf"{_DIGIT}|[0-9]", re.I)
#: Dotted quads with spelled digits, parted by a space or hyphen within a number.
_NUMBER = rf"(?:(?:{_DIGIT})(?!\w)|[0-9])(?:[ -]?(?:(?<!\w)(?:{_DIGIT})(?!\w)|[0-9])){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![\w.]){_NUMBER}(?:(?: dot |\.){_NUMBER}){{3}}(?!\w)", re.I)
_SPELLED_NUMBER = re.compile(_NUMBER, re.I)
#: A spoken at before a host with a real dot counts only after a local part that is no plain word.
_ADDRESS_LIKE = re.compile(r"[A-Za-z0-9]+(?:[._+][A-Za-z0-9]+)+")
_SPOKEN_AT = re.compile(r"[._+][A-Za-z0-9]+ at [A-Za-z0-9-]+\.[A-Za-z]", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ ]+(?=[0-9])", re.I)
_OPEN_AT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}at[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_OPEN_DOT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|punkt|point|punto)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{1,64})(?P<at> at |@)(?P<host>[A-Za-z0-9-]{1,63}(?:(?: dot |\.)[A-Za-z0-9-]{1,63}){1,8})", re.I)
_SPOKEN_DOT = re.compile(r" dot ", re.I)
_IP_DOT = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: dot |\.)[0-9]{1,3}(?: dot |\.)[0-9]{1,3}(?: dot |\.)[0-9]{1,3}(?![0-9])", re.I)
_BRACKETED = re.compile(r"[\[({<][ \t]{0,3}(?:at|dot|punkt|point|punto)[ \t]{0,3}[\])}>]", re.I)


class Rewritten:
    """A text with, for each character, the source range that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts strings in the place of ranges, which are in order and don't overlap."""
        text, starts, ends, changed, last = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a])
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            changed += self.changed[last:a]
            if new:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
                changed += [True] * len(new)
            last = b
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed

    def fold(self) -> None:
        edits = [(i, i + 1, _FOLD[ord(c)]) for i, c in enumerate(self.text) if c in _FOLDABLE]
        removed = [i for i, _, new in edits if not new]
        self.replace(edits)
        if removed:  # a character next to one that went stands in a changed place
            gone = set(removed)
            for i, s in enumerate(self.starts):
                if s - 1 in gone or self.ends[i] in gone:
                    self.changed[i] = True

    def spell(self) -> None:
        edits = []
        for m in _SPELLED_IP.finditer(self.text):
            for d in _SPELLED_NUMBER.finditer(m.group()):
                if not d.group().isdigit() and any(c.isalpha() for c in m.group()):
                    edits.append((m.start() + d.start(), m.start() + d.end(), "".join(DIGIT_WORDS.get(w.lower(), w) for w in _ONE.findall(d.group()))))
        self.replace(edits)
        edits = []
        for m in _SPELLED.finditer(self.text):
            if any(c.isalpha() for c in m.group()):
                edits += [(m.start() + d.start(), m.start() + d.end(), DIGIT_WORDS.get(d.group().lower(), d.group())) for d in _ONE.finditer(m.group()) if not d.group().isdigit()]
        self.replace(edits)
        self.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(self.text)])

    def undisguise(self) -> None:
        for pattern, new in ((_OPEN_AT, "@"), (_OPEN_DOT, ".")):
            self.replace([(m.start(), m.end(), new) for m in pattern.finditer(self.text)])
        edits = []
        for m in _SPOKEN.finditer(self.text):
            dots = [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _SPOKEN_DOT.finditer(m.group("host"))]
            if m.group("at") == "@" or dots or _ADDRESS_LIKE.fullmatch(m.group("local")):
                edits += [(m.start("at"), m.end("at"), "@")] * (m.group("at") != "@") + dots
        self.replace(edits)
        self.replace([(m.start() + d.start(), m.start() + d.end(), ".") for m in _IP_DOT.finditer(self.text) for d in _SPOKEN_DOT.finditer(m.group())])

    def found(self) -> list[tuple[int, str, int]]:
        return [(self.starts[a], kind, self.ends[b - 1]) for a, kind, b in spans_of(self.text) if any(self.changed[a:b])]


def disguised(text: str) -> bool:
    """Whether rewriting may change what is found: a cheap look at the whole text."""
    if not text.isascii() and not _FOLDABLE.isdisjoint(text):
        return True
    lower = text.lower()
    if " dot " in lower or _BRACKETED.search(lower) or (" at " in lower and _SPOKEN_AT.search(lower)):
        return True
    return not _WORD_SET.isdisjoint(re.split(r"[\s,.()-]+", lower))


_WORD_SET = frozenset(DIGIT_WORDS)


def all_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Base spans and those that only the rewritten text shows."""
    if not disguised(text):
        return base
    r = Rewritten(text)
    r.fold()
    r.spell()
    r.undisguise()
    order = {k: i for i, k in enumerate(KINDS)}
    out = list(base)
    for a, kind, b in r.found():
        if not any(k == kind and s < b and a < e for s, k, e in out):
            out.append((a, kind, b))
    return sorted(out, key=lambda x: (x[0], order[x[1]]))


def _finding(batches):
    for batch in batches:
        counts, digests, joined = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            base = spans_of(text) if text else []
            every = all_spans(text, base) if text else []
            for c, kind in zip(counts, KINDS, strict=True):
                c.append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
            joined.append(",".join(f"{k}:{a}:{b}" for a, k, b in every))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(joined)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added)."""
    bound_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, _finding, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, last = [], 0
    for a, kind, b in all_spans(text, spans_of(text)):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with masked texts."""
    bound_arrow(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(docs, run, docs.schema)


def op9_pii(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None  # leftmost matches with offsets aren't SQL; tests hold the rows against plain re.finditer
