"""Operator 1, personal data with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it stands.  Then a chain of
transducers rewrites disguises: look-alike letters and digits of other scripts, invisible
characters, letters that stand for digits ("4l11 O123"), spelled digits ("five five five", mixed
with numerals), and at/dot disguises ("name [at] host (dot) org", "name at host dot org",
"10 dot 0 dot 0 dot 7").  Every transducer looks at every text; what it rewrites depends on the
characters near by alone, so other text never changes what is found.  Each keeps its edits, and
identifiers found in the rewritten text are mapped back through them to source spans.

A span of the rewritten text is added if its source reads differently and it holds every base span
of its kind that it overlaps: a disguise around a base match gives the longer span, and the base
span stays.

Spans are code points with an exclusive end.  Defined results: null text is empty text; matches
that fail a check (ip parts over 255, card without Luhn's sum, phone length) are dropped without
another try; equal starts are ordered by kind as listed, then by end; a number that is a phone or
card as it stands isn't lengthened by one digit word beside it.  Memory follows the longest text
and its edits.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int, int]  # start, kind number, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """finditer of the email pattern, searched from each "@" outward: words without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> list[Span]:
    """Base spans of a text, sorted."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return out


# -- transducers ------------------------------------------------------------------------------
#: Letters of other scripts that look like ASCII letters (fixed values, by sight).
_ALIKE = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυχɑɡıոօӏ", "ABEKMHOPCTYXaeopcyxijsdqwhABEZHIKMNOPTYXavoptuxaginol", strict=True))
_DIGIT_WORDS = {w: str(d) for d, words in enumerate(("zero oh null", "one eins uno", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in words.split()}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + r")(?!\w)"
_BETWEEN = r"(?:[\x20,-]{1,3}|\.(?=\w)|[\x20-]?[()][\x20-]?)"
#: A run of digit words and numerals; what it stands for is left to the detectors.
_RUN = re.compile(r"(?i)(?<!\w)(?=[0-9p" + "".join(sorted({w[0] for w in _DIGIT_WORDS})) + rf"])(?:plus\x20{{1,3}})?(?:{_WORD}|[0-9]++)(?:{_BETWEEN}(?:{_WORD}|[0-9]++(?!\w)))*+")
_TOKEN = re.compile(r"[^\W_]+")
_DOT = r"(?:dot|punkt|punto|point)"
_BRACKET_AT = re.compile(r"(?i)\x20?[\[({<]\x20?(?:at|@|arroba|ät)\x20?[\])}>]\x20?")
_BRACKET_DOT = re.compile(rf"(?i)\x20?[\[({{<]\x20?(?:{_DOT}|\.)\x20?[\])}}>]\x20?")
_DIGIT_DOT = re.compile(rf"(?i)(?<=[0-9])\x20{{1,3}}{_DOT}\x20{{1,3}}(?=[0-9])")
_AT = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])(?:\x20++at\x20++|@)(?=[A-Za-z0-9-])")
_HOST = re.compile(r"(?i)[A-Za-z0-9-]++(?:(?:\x20++dot\x20++|\.)[A-Za-z0-9-]++)++")
#: A host whose last label has anything but letters: an address or a number, at which things are.
_NO_NAME = re.compile(r"[^A-Za-z.\x20][A-Za-z0-9-]*\Z|[.\x20][A-Za-z]\Z")
_SPOKEN_DOT = re.compile(r"(?i)\x20++dot\x20++")
_DOT_BACK = re.compile(r"(?i)\x20{1,4}dot\x20{1,4}\Z")
_DOT_BEFORE = re.compile(rf"(?i)(?:\w\.|\x20{_DOT}\x20{{1,3}}|[\])}}>]\x20?)\Z")
_DOT_AFTER = re.compile(rf"(?i)\.\w|\x20{{1,3}}{_DOT}\x20|\x20?[\[({{<]")
#: Numerals with letters that look like digits, and dotted quads of such.
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?:(?<!\.)[0-9OolI]{1,3}(?:\.[0-9OolI]{1,3}){3}(?![\w.])|(?=[OolI]*[0-9])(?=[0-9]*[OolI])[0-9OolI]++(?![A-Za-z0-9]))")
_LETTER = re.compile("[OolI]")


class Tape:
    """A text after some rewriting, with the edits that lead back to its source."""

    __slots__ = ("text", "layers")

    def __init__(self, text: str):
        self.text, self.layers = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the given ranges (start, end, new text); they are sorted and do not overlap."""
        if not edits:
            return
        out, done, size = [], 0, 0
        layer: tuple[list[int], ...] = ([], [], [], [])  # start and end in the new text, start and end in the old one
        for a, b, put in edits:
            out += [self.text[done:a], put]
            size += a - done
            for held, x in zip(layer, (size, size + len(put), a, b), strict=True):
                held.append(x)
            size += len(put)
            done = b
        self.text = "".join([*out, self.text[done:]])
        self.layers.append(layer)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source range that characters a to b stand for; an edit counts whole."""
        b -= 1
        for start, end, old_start, old_end in reversed(self.layers):
            i, j = bisect_right(start, a) - 1, bisect_right(start, b) - 1
            a = a if i < 0 else old_start[i] if a < end[i] else a - end[i] + old_end[i]
            b = b if j < 0 else old_end[j] - 1 if b < end[j] else b - end[j] + old_end[j]
        return a, b + 1


@lru_cache(maxsize=1 << 16)
def _plain(c: str) -> str:
    """The ASCII character that c looks like, nothing if c can't be seen, or c."""
    if c in _ALIKE:
        return _ALIKE[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() and wide > " " else c


def lookalikes(tape: Tape) -> None:
    """Look-alikes become ASCII; characters that can't be seen vanish."""
    if tape.text.isascii():
        return
    put = {c: _plain(c) for c in set(tape.text) if c > "\x7f" and _plain(c) != c}
    if put:
        tape.rewrite([(m.start(), m.end(), put[m[0]]) for m in re.finditer("[" + re.escape("".join(sorted(put))) + "]", tape.text)])


def letter_digits(tape: Tape) -> None:
    """O and o become 0, l and I become 1, where they stand among digits."""
    edits = []
    for m in _MIXED.finditer(tape.text):
        if _DIGIT.search(m[0]):
            edits += [(x.start(), x.end(), "0" if x[0] in "Oo" else "1") for x in _LETTER.finditer(tape.text, m.start(), m.end())]
    tape.rewrite(edits)


def spelled_digits(tape: Tape) -> None:
    """Runs of digit words and numerals become numerals; blanks, commas and hyphens beside digit words vanish, "plus" before them is "+"."""
    text, edits = tape.text, []
    held: list[Span] | None = None
    for run in _RUN.finditer(text):
        tokens = [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text, run.start(), run.end())]
        if tokens[-1][2].isdecimal() and all(t[2].isdecimal() for t in tokens):
            continue
        n = sum(1 if t[2] in _DIGIT_WORDS else t[1] - t[0] for t in tokens if t[2] != "plus")
        if n < 9 and run[0].count(".") < 3 and not _beside_dot(text, run.start(), run.end()):
            continue  # too few for any kind
        if any(t[2].isdecimal() for t in tokens):
            held = [s for s in detect(text) if s[1] >= 2] if held is None else held
            tokens = _without_stray(tokens, held)
        last = None
        for k, (a, b, t) in enumerate(tokens):
            spelled = not t.isdecimal()
            if last is not None:
                gap = text[last[1] : a]
                if spelled or not last[2].isdecimal():
                    put = "".join(c for c in gap if c in "().")
                else:
                    put = gap.replace(",", "") or " "
                if put != gap:
                    edits.append((last[1], a, put))
            if spelled:
                edits.append((a, b, "+" if t == "plus" else _DIGIT_WORDS[t]))
            last = (a, b, t)
    tape.rewrite(edits)


def _beside_dot(text: str, a: int, b: int) -> bool:
    """Whether the run is next to a written or spoken dot between numbers."""
    return bool(_DOT_BEFORE.search(text[max(0, a - 12) : a]) or _DOT_AFTER.match(text, b))


def _without_stray(tokens: list[tuple[int, int, str]], held: list[Span]) -> list[tuple[int, int, str]]:
    """The tokens without single digit words at an end beside a number that is a phone or card as it stands."""
    for end in (0, -1):
        if len(tokens) > 1 and tokens[end][2] in _DIGIT_WORDS:
            a, b, t = tokens[1 if end == 0 else -2]
            i = bisect_right(held, (a, 9, 0)) - 1
            if t.isdecimal() and i >= 0 and held[i][2] >= b:
                tokens = tokens[1:] if end == 0 else tokens[:-1]
    return tokens


def _dotted_local(text: str, end: int, floor: int) -> tuple[int, list[tuple[int, int, str]]]:
    """(start of the local part that ends at ``end``, edits of its spoken dots)."""
    edits, at = [], end
    while True:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:  # nothing before a dot
            return (edits[0][1], edits[1:]) if edits else (end, [])
        m = _DOT_BACK.search(text, max(floor, start - 12), start)
        if not m or m.start() <= floor:
            return start, edits
        edits.insert(0, (m.start(), start, "."))
        at = m.start()


def at_and_dot(tape: Tape) -> None:
    """Bracketed and spoken disguises of "@" and "."."""
    tape.rewrite([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(tape.text) if 0 < m.start() and m.end() < len(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(tape.text) if 0 < m.start() and m.end() < len(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(tape.text)])
    text, edits, floor = tape.text, [], 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end()) if m.start() >= floor else None
        spoken = m[0] != "@"
        if host and not (spoken and _NO_NAME.search(host[0])):
            start, dots = _dotted_local(text, m.start(), floor)
            if start < m.start():
                at = [(m.start(), m.end(), "@")] if spoken else []
                edits += [*dots, *at, *((x.start(), x.end(), ".") for x in _SPOKEN_DOT.finditer(text, host.start(), host.end()))]
                floor = host.end()
    tape.rewrite(edits)


TRANSDUCERS = (lookalikes, letter_digits, spelled_digits, at_and_dot)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text."""
    if not text:
        return [], []
    base = detect(text)
    tape = Tape(text)
    for transduce in TRANSDUCERS:
        transduce(tape)
    if not tape.layers:
        return base, base
    own = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    done = [0] * len(KINDS)
    added: list[Span] = []
    for a, k, b in detect(tape.text):
        start, end = tape.source(a, b)
        if tape.text[a:b] == text[start:end] or start < done[k]:
            continue
        i = max(bisect_left(own[k], (start, 0)) - 1, 0)  # base spans of a kind are sorted and apart
        i += i < len(own[k]) and own[k][i][1] <= start
        j = bisect_left(own[k], (end, 0))
        if all(start <= x and y <= end for x, y in own[k][i:j]) and own[k][i:j] != [(start, end)]:
            added.append((start, k, end))
            done[k] = end
    return base, sorted(base + added)


def label(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row; one narrow pass."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t.as_py()) for t in batch.column("text")]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(label(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([label(spans) for _, spans in found], pa.string())],
            ["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"],
        )

    return map_arrow(documents.select("doc_id", "text"), work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    _, spans = find(text)
    if not spans:
        return text
    out, done = [], 0
    for a, k, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"<{KINDS[k]}>"]
        done = b
    return "".join([*out, text[done:]])


def redact_documents(documents: DataFrame) -> DataFrame:
    """The same rows and columns with ``text`` redacted and ``n_chars``, if there, counted anew."""
    names = documents.columns

    def run(batches):
        for batch in batches:
            texts = [redact(t.as_py()) for t in batch.column("text")]
            put = {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in names:
                old = batch.column("n_chars")
                put["n_chars"] = pa.array([None if t is None else len(t) for t in texts], old.type)
            yield pa.RecordBatch.from_arrays([put.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return documents.mapInArrow(run, documents.schema)
