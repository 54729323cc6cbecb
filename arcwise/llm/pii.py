"""Personal data with offset-preserving deobfuscation.

Emails, IPv4 addresses, card numbers and phone numbers are found in the text as it is (the base spans). Then a chain
of transducers rewrites the text and keeps, for every character it writes, where in the source it came from: homoglyphs
and full-width forms become ASCII, invisible characters go, `[at]`, ` at ` with a spelled ` dot `, `(dot)` and their
like become @ and ., runs of spelled digits become digits, `plus` before them a plus sign. Identifiers in the result
map back to spans of the source; those that don't lie within a base span of their kind are added. So a base span that is
only a fragment of an identifier stands beside the whole one.

Base patterns are matched leftmost and without overlaps for each kind; all scans are linear in the text.
Nulls: a null text counts as empty and has no spans. Rows are judged each by itself; equal texts get equal spans. An
empty table gives an empty result; other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive digits and the look-behind change no match: a run of digits that fails from its start fails from within.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield m.span()


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def find(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind in KINDS for a, b in _FINDERS[kind](text)]


# Look-alikes of ASCII letters and digits in Cyrillic, Greek and Armenian. Forms that Unicode itself calls
# compatible with one ASCII character (full-width, small, mathematical, circled, letter-like) go by its tables.
_LOOKS = dict(zip("аеорсухіјѕһԁԛԝгкмптвнАВЕКМНОРСТХІЈЅУΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικυαցհոսօ", "aeopcyxijshdqwrkmntbhABEKMHOPCTXIJSYABEZHIKMNOPTYXovpikuaghnuo", strict=True))
_ODD = re.compile("[­Ͱ-ϿЀ-ԯԱ-֏٠-٩۰-۹०-९​-‏‐-―․⁠℀-⅏Ⓐ-ⓩ。﹐-﹫﻿！-～｡\U0001d400-\U0001d7ff]")
_GONE = frozenset("­​‌‍‎‏⁠﻿")
_AS = {"。": ".", "｡": ".", "․": ".", "﹒": "."} | {chr(c): "-" for c in range(0x2010, 0x2016)}
_AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", re.I)
# With plain words for at, the domain's dots must be spelled too: "look at example.com" is prose.
_PLAIN = re.compile(r"(?<![\w.%+-])([A-Za-z0-9_%+-]+(?:(?: dot |\.)[A-Za-z0-9_%+-]+)*)( at )([A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)(?![\w-])", re.I)
#: What _AT and _DOT need; _PLAIN and _SPELLED_DOT need "dot".
_CLOAK = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]", re.I)
_SPELLED_DOT = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z]{2,})", re.I)
#: Digits and plus in English, German, French and Spanish.
_SPELLED = (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {name: str(k) for names in _SPELLED for k, name in enumerate(names.split())} | {"zwo": "2", "fuenf": "5"}
_NAMES = "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w)))
_SOME = re.compile(rf"(?<![a-z])(?:{_NAMES})(?![a-z])")
_RUN = re.compile(rf"(?<![A-Za-z])(?:(?:plus|más|mas)[ -]+)?(?:(?:{_NAMES}|[0-9]+|oh)(?:[ .-]+(?:point |dot |punkt |punto )?|(?![A-Za-z]))){{4,}}", re.I | re.A)
_NAME = re.compile(rf"({_NAMES})|(oh)|((?:plus|más|mas)[ -]+)|( *(?:point|dot|punkt|punto) *)", re.I | re.A)


class Traced:
    """A text and, for each character, the span of the source that it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, edits) -> Traced:
        """edits: (start, end, replacement) in order, apart from each other; a replacement stands for its whole span."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        if not at:
            return self
        return Traced("".join(text) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])


def _glyphs(text: str):
    for m in _ODD.finditer(text):
        c = m[0]
        if c in _GONE:
            new = ""
        else:
            digit, plain = unicodedata.decimal(c, None), unicodedata.normalize("NFKC", c)
            new = str(digit) if digit is not None else _LOOKS.get(c) or _AS.get(c) or (plain if len(plain) == 1 and plain.isascii() else None)
        if new is not None:
            yield m.start(), m.end(), new


def _disguises(text: str):
    found = [(m.start(), m.end(), "@") for m in _AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]
    for m in _PLAIN.finditer(text):
        found.append((*m.span(2), "@"))
        for part in (1, 3):
            found += [(m.start(part) + d.start(), m.start(part) + d.end(), ".") for d in re.finditer(" dot ", m[part], re.I)]
    if any(x[2] == "@" for x in found) or "@" in text:
        found += [(m.start(), m.end(), ".") for m in _SPELLED_DOT.finditer(text)]
    done = 0
    for a, b, new in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if a >= done:
            yield a, b, new
            done = b


def _spelled(text: str):
    for run in _RUN.finditer(text):
        names = list(_NAME.finditer(text, run.start(), run.end()))
        if sum(bool(m[1]) for m in names) < 2:
            continue
        for k, m in enumerate(names):
            end = m.end()
            if m[1] and k + 1 < len(names) and names[k + 1][1] and text[end : names[k + 1].start()] == " ":
                end += 1  # spelled digits side by side are one number
            yield m.start(), end, _DIGITS[m[1].lower()] if m[1] else "0" if m[2] else "+" if m[3] else "."


def deobfuscated(text: str) -> Traced | None:
    """The rewritten text with its trace; None if nothing changes."""
    out = Traced(text)
    if not text.isascii():
        out = out.rewrite(_glyphs(out.text))
    low = out.text.lower()
    if "dot" in low or _CLOAK.search(out.text):
        out = out.rewrite(_disguises(out.text))
        low = out.text.lower()
    if len(_SOME.findall(low)) >= 2:  # _spelled rewrites no run with fewer
        out = out.rewrite(_spelled(out.text))
    return out if out.text != text else None


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all): spans by kind as in KINDS, then by start."""
    base = find(text)
    other = deobfuscated(text)
    if other is None:
        return base, base
    extra = []
    for kind, a, b in find(other.text):
        start, end = other.starts[a], other.ends[b - 1]
        if not any(k == kind and x <= start and end <= y for k, x, y in base):
            extra.append((kind, start, end))
    if not extra:
        return base, base
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def merged(found) -> list[tuple[str, int, int]]:
    """Spans by start, those that overlap made one of the kind of the longest of them."""
    out, longest = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
            longest = b - a
            continue
        k, start, end = out[-1]
        out[-1] = (kind if b - a > longest else k, start, max(end, b))
        longest = max(longest, b - a)
    return out


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end of all), n_added."""
    rows = text_of(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base, every = spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                for column, value in zip(out, (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)), strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span, added ones too, replaced by its kind in angle brackets, overlapping ones as one; null texts stay null."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                for k, a, b in reversed(merged(spans(text)[1])) if text else ():
                    text = f"{text[:a]}<{k}>{text[b:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=names)

    return docs.mapInArrow(run, docs.schema)
