"""Personal data in texts, also where it is disguised, with spans in source characters.

Plain identifiers are found in the text itself. Disguised ones are found in a normalised
text: a chain of transducers replaces lookalike characters, drops invisible ones, writes
spelled digits as digits and at/dot disguises as ``@`` and ``.``. Each transducer keeps its
edits, so a span of the normalised text is mapped back through the chain to the characters
that it came from. Only spans that an edit took part in, and that overlap no plain span of
their kind, are added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import as_strings, lean, text_or_empty, text_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's number, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each ``@``: the run of local characters before it, the dotted name after it. This
    is the leftmost match, without a second look at long runs that no ``@`` follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from each dotted chain of numbers."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def plain(text: str) -> list[Span]:
    """The identifiers that the text shows as they are."""
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


class Transduced:
    """A text after a list of edits (start, end, replacement) of its source, in order."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        out, at, length = [], 0, 0
        self.begin: list[int] = []  # of each replacement, in the new text
        self.end: list[int] = []
        self.source: list[tuple[int, int]] = []
        for a, b, new in edits:
            out += (source[at:a], new)
            length += a - at
            self.begin.append(length)
            length += len(new)
            self.end.append(length)
            self.source.append((a, b))
            at = b
        out.append(source[at:])
        self.text = "".join(out)

    def _character(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.begin, i) - 1
        if k < 0:
            return i, i + 1
        if i < self.end[k]:
            return self.source[k]
        at = i - self.end[k] + self.source[k][1]
        return at, at + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of a non-empty span of the new text."""
        return self._character(start)[0], self._character(end - 1)[1]

    def touched(self, start: int, end: int) -> bool:
        """Whether an edit lies inside the span of the new text."""
        k = bisect_right(self.begin, end - 1) - 1
        return k >= 0 and self.end[k] >= start and (self.begin[k] > start or self.end[k] > start)


#: Letters of other scripts drawn like ASCII ones, and full stops.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορ" "。｡․‐‑‒–−",
        "ABESIJKMHOPCTYXaesijopcyxdqwh" "ABEZHIKMNOPTYXop" "...-----",
    )
)
INVISIBLE = "­​‌‍⁠﻿"
#: Blocks of characters that are compatibility forms of ASCII, or digits of other scripts.
_FORMS = ((0x0660, 0x066A), (0x06F0, 0x06FA), (0x0966, 0x0970), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))


def folded(char: str) -> str | None:
    """The ASCII character that ``char`` looks like or stands for, if there is one."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    digit = unicodedata.decimal(char, None)
    form = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
    return form if len(form) == 1 and form.isascii() else None


_FOLD = {ord(c): f for c in [*LOOKALIKES, *(chr(i) for a, b in _FORMS for i in range(a, b))] if (f := folded(c))}
_INVISIBLE = re.compile(f"(?<=[^\\s{INVISIBLE}])[{INVISIBLE}]+(?=[^\\s{INVISIBLE}])")

#: Digits as words, in English, Spanish, French and German.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
_AT, _DOT, _PLUS = "at|arroba|arobase", "dot|punto|point|punkt", "plus|más|mas"
#: Last labels that make words with "at" and "dot" between them an address.
ENDINGS = "com|org|net|edu|gov|info|biz|io|dev|app|co|us|uk|eu|de|fr|es|it|nl|ch|at|mx|ca|in|test|example"
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _SHUT, _GAP = r"[(\[{<]\x20{0,2}", r"\x20{0,2}[)\]}>]", r"(?:\x20{1,2}|-)"
#: Four or more digits, at least two of them words, said one after the other, with dots between and a plus before.
_SPOKEN = re.compile(
    rf"(?:(?<!\w)(?:{_PLUS})\x20{{1,2}})?(?<!\w)(?:{_WORD})(?:{_GAP}(?:(?:{_DOT}){_GAP})?(?:{_WORD}|[0-9])(?!\w)){{3,}}",
    re.I,
)
_SPOKEN_PART = re.compile(rf"(?P<word>(?<!\w)(?:{_WORD})(?!\w))|(?P<dot>{_GAP}(?:{_DOT}){_GAP})|(?P<plus>(?:{_PLUS})\x20{{1,2}})|(?P<gap>{_GAP})", re.I)
_MARK = re.compile(rf"\x20{{0,2}}{_OPEN}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.)){_SHUT}\x20{{0,2}}", re.I)
_SAID = re.compile(
    rf"(?<=[A-Za-z0-9])(?P<at>\x20{{1,2}}(?:{_AT})\x20{{1,2}})[A-Za-z0-9-]++(?:(?:\x20{{1,2}}(?:{_DOT})\x20{{1,2}})[A-Za-z0-9-]++)*"
    rf"\x20{{1,2}}(?:{_DOT})\x20{{1,2}}(?:{ENDINGS})(?![A-Za-z0-9-])",
    re.I,
)
_SAID_DOT = re.compile(rf"(?<=[A-Za-z0-9])\x20{{1,2}}(?:{_DOT})\x20{{1,2}}(?=[A-Za-z0-9])", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\x20{1,2}@\x20{1,2}(?=[A-Za-z0-9-]+\.[A-Za-z]{2})|(?<=[A-Za-z0-9])@\x20(?=[A-Za-z0-9-]+\.[A-Za-z]{2})|(?<=[A-Za-z0-9])\x20@(?=[A-Za-z0-9-]+\.[A-Za-z]{2})")


def lookalikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    edits = [(i, i + 1, _FOLD[ord(c)]) for i, c in enumerate(text) if ord(c) in _FOLD]
    return sorted(edits + [(*m.span(), "") for m in _INVISIBLE.finditer(text)])


def spoken_digits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPOKEN.finditer(text):
        for part in _SPOKEN_PART.finditer(text, *m.span()):
            kind = part.lastgroup
            new = DIGIT_WORDS[part[0].lower()] if kind == "word" else {"dot": ".", "plus": "+", "gap": ""}[kind]
            edits.append((*part.span(), new))
    return edits


def bracketed(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m.lastgroup == "at" else ".") for m in _MARK.finditer(text)]


def said(text: str) -> list[tuple[int, int, str]]:
    """"name at host dot com": the words are marks only where the whole address is there."""
    edits = [(*m.span(), "@") for m in _SPACED_AT.finditer(text)]
    for m in _SAID.finditer(text):
        edits.append((*m.span("at"), "@"))
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, m.end("at"), m.end())]
        # "first dot last at ...": the name before it.
        start = m.start("at")
        while d := re.search(rf"(?<=[A-Za-z0-9])\x20{{1,2}}(?:{_DOT})\x20{{1,2}}(?=[A-Za-z0-9_+-]+$)", text[max(0, start - 80) : start], re.I):
            start = max(0, start - 80) + d.start()
            edits.append((start, start + len(d[0]), "."))
    return sorted(set(edits))


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (lookalikes, spoken_digits, bracketed, said)


def disguised(text: str, shown: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, in characters of ``text``."""
    chain: list[Transduced] = []
    for transducer in TRANSDUCERS:
        now = chain[-1].text if chain else text
        if edits := transducer(now):
            chain.append(Transduced(now, edits))
    if not chain:
        return []
    out = []
    for a, kind, b in plain(chain[-1].text):
        changed = False
        for layer in reversed(chain):
            changed |= layer.touched(a, b)
            a, b = layer.back(a, b)
        if changed and not any(k == kind and x < b and a < y for x, k, y in shown):
            out.append((a, kind, b))
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and those that normalising adds."""
    shown = plain(text)
    return shown, disguised(text, shown)


#: What a text must hold for any of the above to find something, for a fast first look.
_SHOWN = r"@|[0-9]\.[0-9]|[0-9][\x20-]?[0-9]|\+[0-9]"
_FORM_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b - 1:X}}}" for a, b in _FORMS)
_HIDDEN = (
    f"[{''.join(LOOKALIKES)}{INVISIBLE}{_FORM_CLASS}]|(?i:{_OPEN}(?:{_AT}|{_DOT}|@|\\.){_SHUT}|\\x20(?:{_AT})\\x20"
    f"|(?:{_WORD}){_GAP}(?:(?:{_DOT}){_GAP})?(?:{_WORD}|[0-9]))|\\x20@|@\\x20"
)
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_strings(batch.column("text"))
        for a, b in text_slices(texts):
            some = texts.slice(a, b - a)
            look = pc.match_substring_regex(some, _SHOWN).to_pylist()
            hidden = pc.match_substring_regex(some, _HIDDEN).to_pylist()
            rows = []
            for i in range(b - a):
                if not (look[i] or hidden[i]):
                    rows.append([])
                    continue
                text = some[i].as_py()
                shown = plain(text) if look[i] else []
                added = disguised(text, shown) if hidden[i] else []
                rows.append(sorted([(*s, False) for s in shown] + [(*s, True) for s in added]))
            listed = [[dict(zip(("start", "kind", "end", "added"), s)) for s in row] for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(listed, FOUND)], names=["doc_id", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found) with found an array of (start, kind, end, added), sorted, per row.

    ``kind`` is a place in KINDS, ``start`` and ``end`` count source characters, ``added`` marks
    what only the normalised text shows. A null text is empty; rows may repeat, doc_ids may
    be null; other columns are not read; an empty table gives no rows. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        lean(_scanned), "doc_id long, found array<struct<start:int,kind:int,end:int,added:boolean>>"
    )


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
