"""Operator 6, substring deduplication by prefix-partitioned suffix trees.

Suffixes start at words.  Two texts share ``size`` consecutive words exactly where their suffixes
lie below one internal node at least that deep, so the deep internal nodes of all subtrees are the
repeats.  A word is removed if it lies in a window whose node has a leaf in a document of smaller id.

Steps, each over all documents:

1. Prefixes of 1, 2, 4 and 8 words are counted in tables of ``1 << _SLOT_BITS`` slots each, whatever
   the size of the input.  A suffix's prefix is the shortest whose slot fits a group, the whole
   window where none does; the group is a hash of that prefix (``Prefixes``).
2. Documents are dealt by a hash of id and text into chunks of bounded text.  Each chunk sends short
   fingerprints of its distinct windows as sorted gaps and gets back a bit for each that another
   chunk has too.  This only spares the trees suffixes that can't meet another: a suffix whose
   window is in one document is a lone leaf.  A false bit costs a leaf in a tree, none is lost.
3. The other suffixes go to the group of their prefix: the codes of their words, a 64-bit check of
   the window, and the smallest doc_id of the chunk that has them, with a mark where the chunk has
   several.  The group sorts its suffixes word by word; the words that neighbours share are the
   depths of the internal nodes of its subtrees.  Below every node at least ``size`` deep, each
   suffix learns whether the node has another document, and whether it has a smaller one.
4. Each chunk removes the words that these answers cover, and no others.

A passage that a third of all documents share is one suffix for each chunk and word, never a group
of documents.  Rows between chunks and groups are made for pairs that have suffixes, so there are
never more than suffixes.  Words are compared by 64-bit hashes; within a chunk windows are one if
their 64-bit hashes are, in a tree if the codes of all words and the hashes are.

Defined results: null text is empty; rows of one doc_id never remove each other's words; rows with
null doc_id come after all others and keep out of each other's way (null counts as 2^63 - 1); fewer
words than a window remove nothing; an empty table gives an empty result; a doc_id that isn't an
integer is refused with a TypeError.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import stash

WINDOW = 13
#: Text of a chunk; windows of a bucket of fingerprints; suffixes of a group.
CHUNK_BYTES, BUCKET_WINDOWS, GROUP_SUFFIXES = 4 << 20, 2_000_000, 500_000
_LEVELS, _SLOT_BITS = (1, 2, 4, 8), 14
_NULL_ID = (1 << 63) - 1


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as a first value and gaps of the fewest whole bytes."""
    if not len(sorted_values):
        return b""
    gaps = np.diff(sorted_values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return struct.pack("<BQ", width, int(sorted_values[0])) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    width, first = struct.unpack_from("<BQ", blob)
    raw = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(raw) + 1, 8), dtype=np.uint8)
    out[1:, :width] = raw
    out = out.reshape(-1).view(np.uint64)
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Numbers in any order, above their smallest, in the fewest whole bytes."""
    low = int(ids.min())
    rest = ids.astype(np.int64).view(np.uint64) - np.uint64(low % (1 << 64))
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return struct.pack("<Bq", width, low) + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    width, low = struct.unpack_from("<Bq", blob)
    raw = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return (out.reshape(-1).view(np.uint64) + np.uint64(low % (1 << 64))).view(np.int64)


def _pack_marks(*marks: np.ndarray) -> bytes:
    return b"".join(np.packbits(m).tobytes() for m in marks)


def _unpack_marks(blob: bytes, n: int, many: int) -> list[np.ndarray]:
    bits = np.frombuffer(blob, dtype=np.uint8).reshape(many, -1)
    return [np.unpackbits(b, count=n).astype(bool) for b in bits]


def _places(doc: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows that lie inside one text; ``doc`` is the text of each word."""
    return np.flatnonzero(doc[: max(len(doc) - size + 1, 0)] == doc[size - 1 :])


def _slots(prefix: np.ndarray) -> np.ndarray:
    return (prefix >> vec.U64(64 - _SLOT_BITS)).astype(np.int64)


class Prefixes:
    """Which prefix of a suffix decides its group: the shortest that isn't too full, else the whole window."""

    def __init__(self, size: int, groups: int, heavy: dict[int, np.ndarray]):
        self.size, self.groups, self.heavy = size, groups, heavy

    def group(self, runs: vec.Runs, at: np.ndarray) -> np.ndarray:
        key, left = runs(at, self.size), np.arange(len(at))
        for level, heavy in sorted(self.heavy.items()):
            p = runs(at[left], level)
            light = ~heavy[_slots(p)]
            key[left[light]] = p[light]
            left = left[~light]
        return (vec.mix(key) % vec.U64(self.groups)).astype(np.int64)


def count_prefixes(documents: DataFrame, size: int) -> tuple[int, dict[int, np.ndarray]]:
    """(windows of all documents, counts by slot for each prefix length); tables of fixed size."""
    levels = [n for n in _LEVELS if n < size] or [size]

    def work(batches):
        total = {n: np.zeros(1 << _SLOT_BITS, dtype=np.int64) for n in levels}
        for batch in batches:
            for _, _, data, offsets in vec.slices(batch.column("text")):
                words = vec.Words(data, offsets, vec.BLANK_WORDS)
                at, runs = _places(words.text_of(), size), vec.Runs(words.hash)
                for n, counts in total.items():
                    counts += np.bincount(_slots(runs(at, n)), minlength=len(counts))
        for n, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, dtype=np.int32)), pa.array(at), pa.array(counts[at])], ["level", "slot", "n"])

    found = documents.select("text").mapInArrow(work, "level int, slot long, n long").groupBy("level", "slot").agg(F.sum("n").alias("n")).toArrow()
    out = {n: np.zeros(1 << _SLOT_BITS, dtype=np.int64) for n in levels}
    level, slot, n = (found[c].to_numpy() for c in ("level", "slot", "n"))
    for k, counts in out.items():
        counts[slot[level == k]] = n[level == k]
    return int(out[levels[0]].sum()), out


class Chunk:
    """The distinct windows of one chunk, sorted by hash: ``value``, with ``low``, the smallest doc_id, and ``many``, whether there are others."""

    def __init__(self, docs: pa.Table, size: int):
        self.size, self.texts = size, docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string())
        ids = docs["id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_NULL_ID).to_numpy()
        hashes, counts = [np.zeros(0, dtype=vec.U64)], [np.zeros(0, dtype=np.int64)]
        for _, _, data, offsets in vec.slices(self.texts):
            words = vec.Words(data, offsets, vec.BLANK_WORDS)
            hashes.append(words.hash)
            counts.append(words.counts())
        self.hash, self.counts = np.concatenate(hashes), np.concatenate(counts)
        doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.at, self.runs = _places(doc, size), vec.Runs(self.hash)
        full = self.runs(self.at, size)
        order = np.argsort(full)
        full = full[order]
        new = np.r_[True, full[1:] != full[:-1]][: len(full)]
        first = np.flatnonzero(new)
        self.value, self.some = full[first], self.at[order[first]]
        self.number = np.empty(len(order), dtype=np.int32)
        self.number[order] = np.cumsum(new) - 1
        self.owner = self.ids[doc[self.at]]
        own = self.owner[order]
        self.low = np.minimum.reduceat(own, first) if len(first) else own
        self.many = (np.maximum.reduceat(own, first) if len(first) else own) > self.low

    def fingerprints(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct fingerprints, sorted; the number of each window's)."""
        short = self.value >> vec.U64(64 - bits)
        new = np.r_[True, short[1:] != short[:-1]][: len(short)]
        return short[new], np.cumsum(new) - 1

    def suffixes(self, bits: int, buckets: int, prefixes: Prefixes, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, dict[int, slice]]:
        """(the windows whose suffixes aren't lone leaves, by group and hash; the range of each group)."""
        short, number = self.fingerprints(bits)
        cut = _bucket_cuts(short, bits, buckets)
        met = np.zeros(len(short), dtype=bool)
        for b, blob in answers:
            met[cut[b] : cut[b + 1]] = _unpack_marks(blob, cut[b + 1] - cut[b], 1)[0]
        inner = np.flatnonzero(self.many | met[number])
        group = prefixes.group(self.runs, self.some[inner])
        order = np.argsort(group, kind="stable")
        group, inner = group[order], inner[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        return inner, {int(group[a]): slice(int(a), int(b)) for a, b in zip(first, np.r_[first[1:], len(group)])}

    def codes(self, windows: np.ndarray) -> np.ndarray:
        """One byte for each word of each window."""
        return (self.hash >> vec.U64(56)).astype(np.uint8)[self.some[windows][:, None] + np.arange(self.size)]


def _bucket_cuts(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    edges = (np.arange(buckets + 1, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64)
    cut = np.searchsorted(values, edges)
    cut[0], cut[-1] = 0, len(values)
    return cut


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(schema.items())})


def _to_buckets(size: int, bits: int, buckets: int):
    """Step 2, chunk side."""

    def run(key, docs):
        values, _ = Chunk(docs, size).fingerprints(bits)
        cut = _bucket_cuts(values, bits, buckets)
        rows = [(b, key[0].as_py(), pack(values[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut)).tolist()]
        return _rows({"bucket": pa.int32(), "chunk": pa.int64(), "blob": pa.binary()}, rows)

    return run


def _met(key, entries):
    """Step 2, bucket side: a bit for each fingerprint of each chunk, set if another chunk has it."""
    values = [unpack(x) for x in entries["blob"].to_pylist()]
    both = np.concatenate(values)
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    rows = []
    for chunk, v in zip(entries["chunk"].to_pylist(), values, strict=True):
        hit = twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v if len(twice) else np.zeros(len(v), dtype=bool)
        if hit.any():
            rows.append((chunk, key[0].as_py(), _pack_marks(hit)))
    return _rows({"chunk": pa.int64(), "part": pa.int32(), "blob": pa.binary()}, rows)


def _to_trees(size: int, bits: int, buckets: int, prefixes: Prefixes):
    """Step 3, chunk side."""

    def run(key, docs, answers):
        rows = []
        if docs.num_rows:
            chunk = Chunk(docs, size)
            inner, ranges = chunk.suffixes(bits, buckets, prefixes, list(zip(answers["part"].to_pylist(), answers["blob"].to_pylist(), strict=True)))
            for g, at in ranges.items():
                windows = inner[at]
                rows.append((g, key[0].as_py(), pack(chunk.value[windows]), chunk.codes(windows).tobytes(), pack_ids(chunk.low[windows]), _pack_marks(chunk.many[windows])))
        return _rows({"group": pa.int32(), "chunk": pa.int64(), "full": pa.binary(), "codes": pa.binary(), "ids": pa.binary(), "many": pa.binary()}, rows)

    return run


def suffix_order(codes: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The order of suffixes by their words' codes, first word first; equal ones by their check."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : codes.shape[1]] = codes
    keys = wide.view(">u8").astype(np.uint64)
    return np.lexsort((full, *keys.T[::-1]))


def depths(codes: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Words that each sorted suffix shares with the one before; whole windows only if their checks agree too."""
    size = codes.shape[1]
    out = np.zeros(len(codes), dtype=np.int64)
    same = codes[1:] == codes[:-1]
    out[1:] = np.where(same.all(axis=1), size, same.argmin(axis=1))
    out[1:][(out[1:] == size) & (full[1:] != full[:-1])] = size - 1
    return out


def _subtrees(size: int):
    """Step 3, group side: for each suffix, whether its node of depth ``size`` has another document, and whether it has a smaller one."""

    def run(key, entries):
        values = [unpack(x) for x in entries["full"].to_pylist()]
        sizes = [len(x) for x in values]
        full = np.concatenate(values)
        codes = np.frombuffer(b"".join(entries["codes"].to_pylist()), dtype=np.uint8).reshape(-1, size)
        ids = np.concatenate([unpack_ids(x) for x in entries["ids"].to_pylist()])
        many = np.concatenate([_unpack_marks(x, n, 1)[0] for x, n in zip(entries["many"].to_pylist(), sizes, strict=True)])
        order = suffix_order(codes, full)
        deep = depths(codes[order], full[order]) >= size
        first = np.flatnonzero(~deep)
        node = np.cumsum(~deep) - 1
        own = ids[order]
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        other = ((high > low) | np.logical_or.reduceat(many[order], first))[node]
        smaller = own > low[node]
        back = np.empty((2, len(order)), dtype=bool)
        back[:, order] = other, smaller
        rows, done = [], 0
        for chunk, n in zip(entries["chunk"].to_pylist(), sizes, strict=True):
            part = back[:, done : done + n]
            done += n
            if part.any():
                rows.append((chunk, key[0].as_py(), _pack_marks(*part)))
        return _rows({"chunk": pa.int64(), "part": pa.int32(), "blob": pa.binary()}, rows)

    return run


def _remove(size: int, bits: int, buckets: int, prefixes: Prefixes):
    """Step 4."""

    def run(key, docs, answers):
        schema = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "runs": pa.string()}
        if not docs.num_rows:
            return _rows(schema, [])
        chunk = Chunk(docs, size)
        told: dict[bool, list[tuple[int, bytes]]] = {False: [], True: []}
        for tree, part, blob in zip(*(answers[c].to_pylist() for c in ("tree", "part", "blob")), strict=True):
            told[tree].append((part, blob))
        inner, ranges = chunk.suffixes(bits, buckets, prefixes, told[False])
        other, smaller = np.zeros((2, len(chunk.value)), dtype=bool)
        for g, blob in told[True]:
            windows = inner[ranges[g]]
            other[windows], smaller[windows] = _unpack_marks(blob, len(windows), 2)
        gone = chunk.at[smaller[chunk.number] | (other[chunk.number] & (chunk.owner > chunk.low[chunk.number]))]
        mark = np.zeros(len(chunk.hash) + 1, dtype=np.int32)
        mark[gone] += 1  # places are distinct, and so are ends
        mark[gone + size] -= 1
        removed = np.cumsum(mark)[:-1] > 0
        begin = np.r_[0, np.cumsum(chunk.counts)].tolist()
        many = np.add.reduceat(np.r_[removed, False].astype(np.int64), begin[:-1]) * (chunk.counts > 0)
        hashes, runs = [], []
        for i, n in enumerate(many.tolist()):
            words = (chunk.texts[i].as_py() or "").encode().split()
            if n:
                out = removed[begin[i] : begin[i + 1]]
                words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                edge = np.flatnonzero(np.diff(np.r_[0, out.astype(np.int8), 0])).tolist()
                runs.append(",".join(f"{a}:{b}" for a, b in zip(edge[::2], edge[1::2], strict=True)))
            else:
                runs.append("")
            hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table([pa.array(chunk.ids, pa.int64(), mask=chunk.no_id), pa.array(chunk.counts, pa.int64()), pa.array(many, pa.int64()), pa.array(hashes, pa.string()), pa.array(runs, pa.string())], list(schema))

    return run


def remove_repeats(documents: DataFrame, size: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, runs) of each row; doc_id must be an integer.

    ``runs`` are the removed words as "first:end" (word numbers, end exclusive), comma-joined.
    """
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows, counts = count_prefixes(documents, size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, math.ceil(total / chunk_bytes))
    buckets = max(parts, math.ceil(windows / BUCKET_WINDOWS))
    groups = max(parts, math.ceil(windows / GROUP_SUFFIXES))
    bits = min(63, max(24, windows.bit_length() + 7))
    prefixes = Prefixes(size, groups, {n: c > windows / (2 * groups) for n, c in counts.items() if n < size})
    dealt = documents.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    answer = "chunk long, part int, blob binary"
    met = stash(dealt.groupBy("chunk").applyInArrow(_to_buckets(size, bits, buckets), "bucket int, chunk long, blob binary").groupBy("bucket").applyInArrow(_met, answer), "met")
    suffixes = dealt.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_to_trees(size, bits, buckets, prefixes), "group int, chunk long, full binary, codes binary, ids binary, many binary")
    told = suffixes.groupBy("group").applyInArrow(_subtrees(size), answer)
    both = met.withColumn("tree", F.lit(False)).union(told.withColumn("tree", F.lit(True)))
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_remove(size, bits, buckets, prefixes), "doc_id long, n_words long, n_removed long, kept_sha256 string, runs string")
