"""Personal data: patterns over the text, and over its deobfuscated form with offsets kept.

Plain spans come from four patterns over the text itself. Then transducers rewrite
the text (homoglyphs and full-width forms, spelled-out digits, at/dot disguises),
each keeping for every character it writes the span of source characters it stands
for; the patterns run again, and what they find maps back to source characters.
A found span counts as added when it touches a rewritten place and overlaps no
plain span of its kind. Added spans never replace plain ones.

Nulls and edges: a null or empty text has no spans; offsets are code points, end
exclusive; texts of any length take linear time; repeated rows are searched each.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

KINDS = ("email", "ip", "card", "phone")

# Matches begin where a run begins, which finds the leftmost matches without trying each start of a long run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _ip_ok(part: str) -> bool:
    return len(s := part.lstrip("0")) <= 3 and int(s or "0") <= 255


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The four patterns over the text as it is."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_ip_ok, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---------------------------------------------------------------- transducers

# Cyrillic and Greek letters that look like Latin ones, and other stand-ins.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ", "﹫": "@", "․": ".", "。": ".", "·": ".", "﹒": ".",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_TABLE = {c: n for c in (*range(0x2000, 0x3100), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}  # full-width, circled, mathematical forms
_TABLE |= {ord(k): v for k, v in _LOOKS.items()}
_TABLE |= {c: str(d) for c in range(0x80, 0x20000) if (d := unicodedata.digit(chr(c), None)) is not None}
_ODD_CHARS = frozenset(map(chr, _TABLE))
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_TABLE)) + "]")

_NUMBER = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_N = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(plus)[ -])?({_N}(?:[ ,-]{{1,3}}{_N})*+)(?![A-Za-z])", re.I)
_PAIR = re.compile(rf"{_N}[ ,-]{{1,3}}{_N}\b")
_BRACKET = re.compile(r"[ ]?[\[({<][ ]?(?:(at|@)|(dot|\.|punkt|point))[ ]?[\])}>][ ]?", re.I)
_WORDY = re.compile(r"(?<=[A-Za-z0-9])(?:[ ]at[ ]|[ ]?@[ ]?)(?=[A-Za-z0-9-]++(?:(?:[ ]dot[ ]|[ ]?\.[ ]?|\.)[A-Za-z0-9-]++)++)", re.I)
_DOT = re.compile(r"(?<=[A-Za-z0-9])[ ]+dot[ ]+(?=[A-Za-z0-9])", re.I)
_UNDERLINED = re.compile(r"(?<=[A-Za-z0-9])[_-](?:(at)|dot)[_-](?=[A-Za-z0-9])", re.I)
_HAS_DOT = re.compile(r"[ ]dot[ ]", re.I)
_SPACED_OCTETS = re.compile(r"(?<=[0-9])[ ]dot[ ](?=[0-9])", re.I)


#: Letters that stand for digits, in a token that has digits.
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[0-9]*[OoIl])(?=[OoIl]*[0-9])[0-9OoIl]{2,}(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OoIl", "0011")


class Tape:
    """A text with the source span of each of its characters, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.start, self.end, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the tape; each new character stands for its whole span (or nothing is left of it)."""
        if not edits:
            return
        text, starts, ends, new, at = [], [], [], [], 0
        for a, b, into in edits:
            text += [self.text[at:a], into]
            k = len(into)
            span = (int(self.start[a]), int(self.end[b - 1]))
            starts += [self.start[at:a], np.full(k, span[0])]
            ends += [self.end[at:a], np.full(k, span[1])]
            new += [self.new[at:a], np.ones(k, bool)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.new = (np.concatenate([*x, y[at:]]) for x, y in ((starts, self.start), (ends, self.end), (new, self.new)))


def _digits(tape: Tape) -> None:
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = list(re.finditer(_N, m[2], re.I))
        if len(words) == 1 and not re.search(r"(?:[0-9][ -]?|dot )\Z", tape.text[max(0, m.start() - 4) : m.start()], re.I) and not re.match(r"(?:[ -]?[0-9]| dot )", tape.text[m.end() : m.end() + 5], re.I):
            continue  # a number word in prose
        if m[1]:
            edits.append((m.start(1), m.end(1) + 1, "+"))
        for k, w in enumerate(words):
            stop = words[k + 1].start() if k + 1 < len(words) else w.end()
            edits.append((m.start(2) + w.start(), m.start(2) + stop, _NUMBER[w[0].lower()]))
    tape.rewrite(edits)


def _letters(tape: Tape) -> None:
    tape.rewrite([(m.start() + k, m.start() + k + 1, c.translate(_AS_DIGITS)) for m in _MIXED.finditer(tape.text) for k, c in enumerate(m[0]) if not c.isdigit()])


def _signs(tape: Tape) -> None:
    tape.rewrite([(*m.span(), "@" if m[1] else ".") for m in _UNDERLINED.finditer(tape.text)])
    tape.rewrite([(*m.span(), "@" if m[1] else ".") for m in _BRACKET.finditer(tape.text)])
    tape.rewrite([(*m.span(), ".") for m in _SPACED_OCTETS.finditer(tape.text)])
    found = [m for m in _WORDY.finditer(tape.text) if m[0] != "@"]
    edits = []
    for m in found:
        stop = re.compile(r"[A-Za-z0-9-]++(?:(?:[ ]dot[ ]|\.)[A-Za-z0-9-]++)*+", re.I).match(tape.text, m.end())
        dots = [d for d in _DOT.finditer(tape.text, m.end(), stop.end())] if stop else []
        if m[0] == "@" or dots or "." in (stop[0] if stop else ""):
            # a bare " at " needs a spelled or real dot in the next word
            if m[0].strip().lower() == "at" and not dots:
                continue
            edits.append((*m.span(), "@"))
            edits += [(*d.span(), ".") for d in dots]
    tape.rewrite(sorted({e[:2]: e for e in edits}.values()))
    # name@host dot tld
    tape.rewrite([(*m.span(), ".") for m in _DOT.finditer(tape.text) if re.search(r"@[A-Za-z0-9.-]+\Z", tape.text[max(0, m.start() - 80) : m.start()])])


#: A number word with a digit or a spelled dot beside it, as `_digits` takes single ones.
_BESIDE = re.compile(rf"(?:[0-9][ -]?|dot )(?:plus[ -])?{_N}|{_N}(?:[ -]?[0-9]| dot )", re.I)
#: An @ with a space beside it, as `_WORDY` takes it.
_AT_SIGN = re.compile(r"[A-Za-z0-9](?:[ ]@|@[ ])")


def _spelled(text: str) -> bool:
    """Whether number words follow each other or stand by a digit or dot; by plain searches, which are far faster than the pattern alone."""
    low = text.lower()
    for word in _NUMBER:
        at = low.find(word)
        while at >= 0:
            if (not at or not (low[at - 1].isascii() and low[at - 1].isalpha())) and (_PAIR.match(low, at) or _BESIDE.search(low, max(0, at - 9), at + 10)):
                return True
            at = low.find(word, at + 1)
    return False


def disguised(text: str) -> bool:
    """Whether anything in the text calls for the transducers: never narrower than they are."""
    if not text.isascii() and not _ODD_CHARS.isdisjoint(set(text)):
        return True
    if any(c in text for c in "[({<") and _BRACKET.search(text):
        return True
    if "@" in text and _AT_SIGN.search(text):
        return True
    low = text.lower()
    if ("dot" in low or "_at" in low or "-at" in low) and (_HAS_DOT.search(text) or _UNDERLINED.search(text)):
        return True
    return bool(_DIGIT.search(text) and _MIXED.search(text)) or _spelled(text)


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans and added spans of a text, by kind."""
    if not text:
        return {k: [] for k in KINDS}, {k: [] for k in KINDS}
    base, added = plain_spans(text), {k: [] for k in KINDS}
    if disguised(text):
        tape = Tape(text)
        tape.rewrite([(*m.span(), _TABLE[ord(m[0])]) for m in _ODD.finditer(text)])
        _letters(tape)
        _digits(tape)
        _signs(tape)
        for kind, spans in plain_spans(tape.text).items():
            for a, b in spans:
                if tape.new[a:b].any():
                    s, e = int(tape.start[a:b].min()), int(tape.end[a:b].max())
                    while e > s and text[e - 1] == " ":
                        e -= 1
                    if all(e <= x or y <= s for x, y in base[kind]):
                        added[kind].append((s, e))
            added[kind] = [x for x, before in zip(added[kind], [(-1, -1), *added[kind]], strict=False) if x[0] >= before[1]]
    return base, added


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redact(text: str | None) -> str | None:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    base, added = find(text)
    spans = sorted((a, b, k) for found in (base, added) for k in KINDS for a, b in found[k])
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of all spans by kind, digest of the plain spans, all spans."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text)
                every = {k: base[k] + added[k] for k in KINDS}
                rows.append([*(len(every[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True)))] if rows else [batch.column(0), *[pa.array([], pa.int64())] * 4, *[pa.array([], pa.string())] * 2], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the personal data in their texts replaced; n_chars, if there, is made anew."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
