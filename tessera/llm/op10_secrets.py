"""Operator 10, secret scan with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every match must contain.
The index is document-partitioned: each slice of texts gets postings (trigram to texts) for the
trigrams that any rule asks for, the queries intersect and unite them, and only the candidates
are verified by the regex, over their whole text.  Rules without mandatory trigrams scan all
texts; one that can only match inside a run of given bytes says so (``Rule.run``), and the scan for
such runs is a pass over the bytes.  Trigrams are of UTF-8 bytes with A-Z folded, so a posting never
misses a match; letters that a pattern folds beyond ASCII are taken for anything.

Patterns are written so that a match is tried at most once for each run of the characters they
begin with: the time for one text follows its length.

Kinds, in the order that breaks ties of equal start: ``KINDS``.  Spans are code points with an
exclusive end.  Defined results: null text is empty text; matches of one kind never overlap
(leftmost first); different kinds may.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre  # the regex parser of the standard library
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vec
from .common import map_arrow

#: More alternatives than this are given up for "anything".
_MOST = 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` for which ``holds`` is true.

    ``run``: bytes and a number; every match that holds lies in a run of at least so many of these bytes.
    """

    kind: str
    pattern: str
    holds: Callable[[re.Match], bool] = lambda m: True
    run: tuple[bytes, int] | None = None


BASE = (
    Rule("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 24, (b"0123456789abcdef", 24)),
)
ADDED = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("chat", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("payment", r"[prs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?ai:authorization: bearer) [A-Za-z0-9._~+/-]{16,}"),
    Rule("login", r"(?<![a-z])[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._~!*-]{4,}@[A-Za-z0-9.-]+"),
)
KINDS = tuple(r.kind for r in BASE + ADDED)

# -- regex to trigram query -------------------------------------------------------------------
#: A query is True (anything), a trigram, or ("and" | "or", queries).
Query = object


def _join(op: str, parts: list) -> Query:
    if op == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of(strings: set[bytes]) -> Query:
    """What texts that hold one of the strings must contain."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else True for s in sorted(strings)])


@dataclass
class _Part:
    """All strings a part can match (or None), the strings it can begin and end with, and its query."""

    exact: set[bytes] | None
    prefix: set[bytes]
    suffix: set[bytes]
    match: Query = True


def _anything() -> _Part:
    return _Part(None, {b""}, {b""})


def _open(p: _Part) -> _Part:
    """The same without exact strings."""
    if p.exact is None:
        return p
    return _Part(None, {s[:2] for s in p.exact}, {s[-2:] if s else s for s in p.exact}, _join("and", [p.match, _of(p.exact)]))


def _cross(a: set[bytes], b: set[bytes]) -> set[bytes]:
    return {x + y for x, y in product(a, b)} if len(a) * len(b) <= 4 * _MOST else {b""}


def _concat(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST:
        return _Part(_cross(a.exact, b.exact), set(), set())
    middle = _of(_cross(a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix))
    prefix = {s[:2] for s in (_cross(a.exact, b.exact if b.exact is not None else b.prefix) if a.exact is not None else a.prefix)}
    suffix = {s[-2:] if s else s for s in (_cross(a.exact if a.exact is not None else a.suffix, b.exact) if b.exact is not None else b.suffix)}
    return _Part(None, prefix, suffix, _join("and", [_open(a).match, _open(b).match, middle]))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST:
        return _Part(set().union(*(p.exact for p in parts)), set(), set())
    parts = [_open(p) for p in parts]
    return _Part(None, set().union(*(p.prefix for p in parts)), set().union(*(p.suffix for p in parts)), _join("or", [p.match for p in parts]))


def _literal(points: list[int], folded: bool) -> _Part:
    """One of the characters; ``folded`` if the pattern ignores case beyond ASCII, where k, s and i have relatives."""
    if folded and any(c > 127 or chr(c) in "kKsSiI" for c in points):
        return _anything()
    return _Part({chr(c).encode().lower() for c in points}, set(), set())  # lower() of bytes is that of A-Z


def _walk(seq, flags: int) -> _Part:
    out = _Part({b""}, set(), set())
    folded = bool(flags & re.IGNORECASE) and not flags & re.ASCII
    for op, arg in seq:
        if op is sre.LITERAL:
            part = _literal([arg], folded)
        elif op is sre.IN and arg[0][0] is not sre.NEGATE and all(k is sre.LITERAL for k, _ in arg):
            part = _literal([c for _, c in arg], folded)
        elif op is sre.SUBPATTERN:
            part = _walk(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is sre.BRANCH:
            part = _either([_walk(p, flags) for p in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _walk(inner, flags)
            if low == 0:
                part = _either([one, _Part({b""}, set(), set())]) if high == 1 else _anything()
            elif low == high == 1:
                part = one
            else:
                part = _open(one)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue  # takes no characters
        else:
            part = _anything()
        out = _concat(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """The trigrams that every match of the pattern contains, as a Boolean query over folded bytes."""
    tree = parser.parse(pattern)
    return _open(_walk(tree, tree.state.flags)).match


def _leaves(q: Query) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*(_leaves(x) for x in q[1]))


# -- index and scan ---------------------------------------------------------------------------
class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED):
        self.rules = rules
        self.regex = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*(_leaves(q) for q in self.queries)))
        self.codes = np.array([int.from_bytes(g, "big") for g in self.grams], dtype=np.int64)
        self.table = np.zeros(1 << 24, dtype=bool)
        self.table[self.codes] = True
        self.fold = np.arange(256, dtype=np.int32)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each trigram of the queries, which texts of the slice hold it."""
        n = len(offsets) - 1
        out = {g: np.zeros(n, dtype=bool) for g in self.grams}
        if len(data) < 3:
            return out
        f = self.fold[data]
        code = f[:-2] << 16 | f[1:-1] << 8 | f[2:]
        at = np.flatnonzero(self.table[code])
        text = np.searchsorted(offsets, at, side="right") - 1
        k = np.searchsorted(self.codes, code[at])
        for i in np.unique(k):
            out[self.grams[i]][text[k == i]] = True
        return out

    def candidates(self, query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.ones(n, dtype=bool)
        if isinstance(query, bytes):
            return postings[query]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def __call__(self, texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, kind number, end), sorted."""
        n = len(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        postings = self.postings(data, offsets)
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regex, self.queries, strict=True)):
            maybe = self.candidates(query, postings, n)
            if rule.run is not None:
                maybe = maybe & _long_runs(data, offsets, *rule.run)
            for i in np.flatnonzero(maybe).tolist():
                found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i] or "") if rule.holds(m)]
        for spans in found:
            spans.sort()
        return found


def _long_runs(data: np.ndarray, offsets: np.ndarray, of: bytes, least: int) -> np.ndarray:
    """Which texts may have a run of ``least`` of the given bytes (runs across two texts give a false candidate only)."""
    inside = np.zeros(256, dtype=bool)
    inside[np.frombuffer(of, dtype=np.uint8)] = True
    edge = np.r_[-1, np.flatnonzero(~inside[data]), len(data)]
    long = np.flatnonzero(np.diff(edge) > least)
    n = len(offsets) - 1
    first = np.maximum(np.searchsorted(offsets, edge[long] + 1, side="right") - 1, 0)
    last = np.minimum(np.searchsorted(offsets, edge[long + 1], side="left"), n)
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, last, -1)
    return np.cumsum(mark)[:n] > 0


def label(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; one narrow pass."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    scanner: list[Scanner] = []

    def work(batch: pa.RecordBatch):
        if not scanner:
            scanner.append(Scanner())
        texts = batch.column("text")
        for lo, hi, data, offsets in vec.slices(texts):
            found = scanner[0](texts.slice(lo, hi - lo).to_pylist(), data, offsets)
            base = [[s for s in x if s[1] < len(BASE)] for x in found]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(len(BASE))]
            digest = [hashlib.sha256(label(x, KINDS).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *counts, pa.array(digest, pa.string()), pa.array([label(x, KINDS) for x in found], pa.string())], ["doc_id", *(f"n_{r.kind}" for r in BASE), "base_sha256", "spans"])

    return map_arrow(documents.select("doc_id", "text"), work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
