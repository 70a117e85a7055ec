"""Similarity of strings and token lists.

Everything but the subsequence scores is a column expression.  The four subsequence scores of
names and of addresses come from one Arrow function (``fuzzy``), whose kernel is the bit-parallel
longest common subsequence: over machine words for a whole batch at a time, and over Python integers
where the shorter string has more than 64 characters, so strings may have any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements over all distinct elements; 0 if a list is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct elements over those of the smaller set; 0 if a list is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return _ratio(F.size(F.array_intersect(a, b)), least)


def grams3(c: Column) -> Column:
    """Distinct three-character pieces without blanks; one or two characters are one piece."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3))))
    return F.when(F.length(s) >= 1, many).otherwise(F.array().cast("array<string>"))


def soundex(c: Column) -> Column:
    """Four-character sound code in which every letter without a code separates; empty unless all letters are A-Z."""
    codes = F.translate(F.upper(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    rest = F.replace(F.substr(F.regexp_replace(codes, r"(.)\1+", "$1"), F.lit(2)), F.lit("0"), F.lit(""))
    return F.when(c.rlike("^[A-Za-z]+$"), F.rpad(F.substring(F.concat(F.substring(F.upper(c), 1, 1), rest), 1, 4), 4, "0")).otherwise("")


def _initials(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(c, lambda t: t.rlike("^[a-zA-Z]")), lambda t: F.substring(t, 1, 1)), "")


def acronym(a: Column, b: Column) -> Column:
    """1 if one side is a single token made of the other's initials (two tokens or more)."""
    one = (F.size(a) == 1) & (F.size(b) >= 2) & (F.try_element_at(a, F.lit(1)) == _initials(b))
    other = (F.size(b) == 1) & (F.size(a) >= 2) & (F.try_element_at(b, F.lit(1)) == _initials(a))
    return F.when(F.coalesce(one, F.lit(False)) | F.coalesce(other, F.lit(False)), 1.0).otherwise(0.0)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    return F.size(places)


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[0-9]{1,6}\b"), F.lit(0)))


def cosine_of_units(a: Column, b: Column) -> Column:
    """Dot product of two vectors of length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


# -- subsequence scores -----------------------------------------------------------------------
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer string's words."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = where.get(c)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


_WORD, _ROWS = 64, 2048


def _numbered(strings: list[str]) -> np.ndarray:
    """Rows of code points, padded with 0."""
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    out = np.zeros((len(strings), int(sizes.max(initial=0))), dtype=np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of symbol numbers of either side, how many numbers there are); 0 is padding."""
    x, y = _numbered(a), _numbered(b)
    most = int(max(x.max(initial=0), y.max(initial=0)))
    if most < 128:
        return x, y, 128
    seen = np.unique(np.concatenate([[0], x.ravel(), y.ravel()]))
    return np.searchsorted(seen, x), np.searchsorted(seen, y), len(seen)


def _masks(x: np.ndarray, symbols: int) -> np.ndarray:
    """For each row and symbol a machine word of the places that have it."""
    at, where = np.arange(len(x)), np.zeros((len(x), symbols), dtype=np.uint64)
    for j in range(x.shape[1]):
        where[at, x[:, j]] |= np.uint64(1 << j)
    where[:, 0] = 0
    return where


def _lcs_rows(where: np.ndarray, size: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``lcs`` of each row's masks with its row of y."""
    at, full = np.arange(len(y)), np.uint64(0xFFFFFFFFFFFFFFFF) >> (_WORD - size).astype(np.uint64)
    v = full.copy()
    for j in range(y.shape[1]):
        u = v & where[at, y[:, j]]
        v = (v + u) | (v - u)
    return size - np.bitwise_count(v & full)


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of many pairs: one machine word for each pair whose shorter string fits it, and all pairs a step at a time."""
    out = np.zeros(len(a), dtype=np.int64)
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if a else ((), ())
    size = np.array([len(x) for x in short], dtype=np.int64)
    for i in np.flatnonzero(size > _WORD).tolist():
        out[i] = lcs(short[i], long[i])
    fits = np.flatnonzero((size > 0) & (size <= _WORD))
    fits = fits[np.argsort([len(long[i]) for i in fits.tolist()], kind="stable")]  # rows of one chunk take as many steps as its longest
    for lo in range(0, len(fits), _ROWS):
        rows = fits[lo : lo + _ROWS]
        x, y, symbols = _codes([short[i] for i in rows], [long[i] for i in rows])
        out[rows] = _lcs_rows(_masks(x, symbols), size[rows], y)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of many pairs."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.float64)
    both = np.array([bool(x) and bool(y) for x, y in zip(a, b, strict=True)], dtype=bool)
    return np.where(total == 0, 100.0, np.where(both, 200.0 * lcs_many(a, b) / np.maximum(total, 1), 0.0))


def ratio(a: str, b: str) -> float:
    """Indel similarity, 0 to 100."""
    return float(ratios([a], [b])[0])


def _in_order(x: str) -> str:
    return " ".join(sorted(x.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_in_order(a), _in_order(b))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio among the shared tokens and the shared tokens with each side's rest, of many pairs."""
    shared, rest_a, rest_b, empty = [], [], [], []
    for p, q in zip(a, b, strict=True):
        x, y = set(p.split()), set(q.split())
        shared.append(" ".join(sorted(x & y)))
        rest_a.append(" ".join(sorted(x - y)))
        rest_b.append(" ".join(sorted(y - x)))
        empty.append(not x or not y)
    n, p, q = (np.array([len(x) for x in side], dtype=np.float64) for side in (shared, rest_a, rest_b))
    gap = (n > 0).astype(np.float64)
    n_a, n_b = n + gap + p, n + gap + q
    best = 100.0 * (1 - (p + q - 2 * lcs_many(rest_a, rest_b)) / np.maximum(n_a + n_b, 1))
    best = np.where(n > 0, np.maximum(best, np.maximum(200.0 * n / np.maximum(n + n_a, 1), 200.0 * n / np.maximum(n + n_b, 1))), best)
    best = np.where((n > 0) & ((p == 0) | (q == 0)), 100.0, best)
    return np.where(empty, 0.0, best)


def token_set_ratio(a: str, b: str) -> float:
    return float(token_set_ratios([a], [b])[0])


def _best_window(short: str, long: str) -> float:
    """Best ratio of the shorter string with a window; windows are tried by what their letters allow, until none can be better."""
    n, need, have, shared = len(short), Counter(short), Counter(), 0
    bounds = []
    for end in range(1, len(long) + n):
        if end <= len(long):
            c = long[end - 1]
            have[c] += 1
            shared += have[c] <= need[c]
        if end > n:
            c = long[end - n - 1]
            shared -= have[c] <= need[c]
            have[c] -= 1
        if shared:
            lo, hi = max(end - n, 0), min(end, len(long))
            bounds.append((200.0 * shared / (n + hi - lo), -lo, -hi))
    best = 0.0
    bounds.sort(reverse=True)
    for bound, lo, hi in bounds:
        if bound <= best:
            break
        best = max(best, 200.0 * lcs(short, long[-lo:-hi]) / (n + lo - hi))
    return best


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """``_best_window`` of many pairs of at most ``_WORD`` characters on the shorter side, all pairs a window at a time."""
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (short, long))
    x, y, symbols = _codes(short, long)
    where, at = _masks(x, symbols), np.arange(len(n))[:, None]
    used = np.unique(x[x > 0])
    y_used = np.where(np.isin(y, used), np.searchsorted(used, y), len(used))
    so_far = np.zeros((len(n), y.shape[1] + 1, len(used)), dtype=np.int16)
    np.cumsum(y_used[:, :, None] == np.arange(len(used)), axis=1, out=so_far[:, 1:])
    need = np.bitwise_count(where[:, used]).astype(np.int16)
    end = np.arange(1, int((n + m).max()))[None, :]
    lo, hi = np.maximum(end - n[:, None], 0), np.minimum(end, m[:, None])
    shared = np.minimum(so_far[at, hi] - so_far[at, np.minimum(lo, m[:, None])], need[:, None, :]).sum(axis=2)
    bound = np.where(end < (n + m)[:, None], 200.0 * shared / np.maximum(n[:, None] + hi - lo, 1), 0.0)
    order = np.argsort(-bound, axis=1, kind="stable")
    best, rows, step = np.zeros(len(n)), np.arange(len(n)), np.arange(x.shape[1])
    for k in range(bound.shape[1]):
        w = order[rows, k]
        open_ = bound[rows, w] > best[rows]
        rows, w = rows[open_], w[open_]
        if not len(rows):
            break
        first, last = lo[rows, w], hi[rows, w]
        place = first[:, None] + step
        window = np.where(place < last[:, None], y[rows[:, None], np.minimum(place, y.shape[1] - 1)], 0)
        found = 200.0 * _lcs_rows(where[rows], n[rows], window) / (n[rows] + last - first)
        best[rows] = np.maximum(best[rows], found)
    return best


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``partial_ratio`` of many pairs."""
    out = np.zeros(len(a))
    short, long, at = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if x == y or not x or len(x) > _WORD:
            out[i] = 100.0 if x == y else partial_ratio(x, y)
            continue
        for p, q in ((x, y), (y, x)) if len(x) == len(y) else ((x, y),):
            short.append(p)
            long.append(q)
            at.append(i)
    by = np.argsort([len(x) for x in long], kind="stable")
    lo = 0
    while lo < len(by):  # chunks of bounded memory: windows x letters
        rows = by[lo : lo + 512]
        rows = rows[: max(1, (1 << 16) // max(len(long[rows[-1]]), 1))]
        found = _best_windows([short[i] for i in rows], [long[i] for i in rows])
        np.maximum.at(out, np.array(at)[rows], found)
        lo += len(rows)
    return out


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with the windows of the longer, cut windows at the ends included."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(*sorted((a, b), key=len))


_FUZZY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ratio", "partial", "sort", "set")])


def _distinct(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """The distinct pairs of a batch, and which of them each row has."""
    seen: dict[tuple[str, str], int] = {}
    at = np.fromiter((seen.setdefault((x or "", y or ""), len(seen)) for x, y in zip(a, b, strict=True)), dtype=np.int64, count=len(a))
    return [x for x, _ in seen], [y for _, y in seen], at


class _Held:
    """Scores of pairs that a worker has met before, as names repeat from batch to batch: a bounded number of short pairs, the longest unused of which go first."""

    def __init__(self, make: Callable[[list[str], list[str]], np.ndarray], most: int = 16_000, chars: int = 160):
        self.make, self.most, self.chars = make, most, chars
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, key: str, score: bytes) -> None:
        if len(key) <= self.chars:
            if len(self.new) >= self.most:
                self.new, self.old = {}, self.new
            self.new[key] = score

    def __call__(self, a: pd.Series, b: pd.Series) -> np.ndarray:
        """A row of scores for each pair; equal pairs of a batch are scored once."""
        x, y, at = _distinct(a, b)
        keys = [f"{len(p)} {p}{q}" for p, q in zip(x, y, strict=True)]
        out, missing = [b""] * len(x), []
        for i, key in enumerate(keys):
            if (score := self.new.get(key)) is None:
                if (score := self.old.get(key)) is None:
                    missing.append(i)
                    continue
                self.keep(key, score)
            out[i] = score
        if missing:
            for i, row in zip(missing, np.asarray(self.make([x[i] for i in missing], [y[i] for i in missing]), dtype=np.float64), strict=True):
                out[i] = row.tobytes()
                self.keep(keys[i], out[i])
        return np.frombuffer(b"".join(out), dtype=np.float64).reshape(len(x), -1 if x else 0)[at]


def _fuzzy_rows(x: list[str], y: list[str]) -> np.ndarray:
    out = np.ones((len(x), 4))  # what equal names have
    rows = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if not p == q != ""]
    x, y = [x[i] for i in rows], [y[i] for i in rows]
    if rows:
        out[rows] = np.stack([ratios(x, y), partial_ratios(x, y), ratios([_in_order(p) for p in x], [_in_order(p) for p in y]), token_set_ratios(x, y)], axis=1) / 100
    return out


_fuzzy_held = _Held(_fuzzy_rows)


@F.pandas_udf(_FUZZY)
def fuzzy(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """ratio, partial, sort and set scores of each pair, 0 to 1."""
    return pd.DataFrame(_fuzzy_held(a, b).reshape(-1, 4), columns=["ratio", "partial", "sort", "set"])


@F.pandas_udf(T.DoubleType())
def sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_sort_ratio of each pair, 0 to 1."""
    x, y, at = _distinct(a, b)
    return pd.Series((ratios([_in_order(p) for p in x], [_in_order(p) for p in y]) / 100)[at])


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio of each pair, 0 to 1."""
    x, y, at = _distinct(a, b)
    return pd.Series((ratios(x, y) / 100)[at])


def register(spark) -> None:
    """Makes the scores callable from SQL."""
    for name, f in (("fuzzy_scores", fuzzy), ("token_sort_ratio", sort_ratio), ("indel_ratio", indel_ratio)):
        spark.udf.register(name, f)
