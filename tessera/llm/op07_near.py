"""Operator 7, near-duplicates by a MinHash LSH forest.

A document's set holds its distinct shingles of ``words`` words.  Documents with equal sets are one
class from the start (128-bit set key), with the number of one of its rows.  Each class gets ``TREES``
sort keys of ``DEPTH`` min-hashes; every tree is one sorted order of all classes.  Candidates of a
class are its neighbours in each order, those with the longest common prefix first: up to
``REACH`` predecessors that share at least ``LEAST_DEPTH`` min-hashes.  In a sparse region that is
a shallow prefix and hence high recall; in a dense region the window holds only deep prefixes, so
the depth adapts to the region.  A sketch of two bits per min-hash discards candidates far below
the threshold.

Links are confirmed on the full sets.  First each class checks its most alike candidate; components
of the confirmed links are found; then every remaining candidate link between different components
is checked, and the components are found again.  Links inside a component need no check, so a
group of n copies costs some n links and never n squared.

Where a window was cut (more candidates than are kept, more predecessors than ``REACH``, or a border
of a partition), the classes on both sides are marked, and all marked classes of different components
are joined exactly.  Shingles are ordered by how often the marked classes hold them, rarest first;
sets that are alike enough share a shingle among the first of each, and at the first they share both
have enough left.  Pairs that meet are held to a further bound that loses nothing: the parities of a
set's shingles in ``_PARITY`` buckets differ in no more buckets than the sets differ in shingles.
Shingles of one component alone, or too late for the smaller set of any pair, are left out; those of more than ``_BLOCK`` classes are dealt to
pairs of blocks, so no task holds more than two blocks of one shingle.

Orders are dealt by range over (tree, key, set key): equal keys of a large group spread over
partitions.  Full sets are made of documents that stand for a class with candidates: a bit table of
bounded size turns most others away before their texts are touched, and a join decides.

Defined results: a text without words (or null) has an empty set, is linked with nothing and kept;
fewer words than a shingle make the whole sequence the one shingle; all rows with words of one doc_id
share a component, which links what any of their texts is linked with; rows with null doc_id are judged
as not linked, with null component_id and kept true.  Only doc_id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .bits import Bits
from .common import map_arrow, stash
from .graph import components

WORDS, PERCENT = 5, 80
TREES, DEPTH, LEAST_DEPTH, REACH = 16, 8, 2, 64
_HASHES = TREES * DEPTH
#: Of 128 two-bit fields 19.2 differ at similarity 0.8, with deviation 4.04; 4.5 deviations more are let through.
_MISMATCHES = 37
#: Candidates that a class keeps in one order: all of a few, else the most alike.
_FEW, _BEST = 5, 3
_PARITY = 1024
#: Slots of the table that orders the shingles of marked classes; classes in a block.
_COUNTS, _BLOCK = 1 << 19, 2048
_PAIR = "a long, b long, miss int"


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    c = vec.constants(2 * _HASHES, 23)
    return (c[:_HASHES] >> vec.U64(32)).astype(np.uint32), (c[_HASHES:] >> vec.U64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text of a slice its distinct shingle hashes, sorted."""
    words = vec.Words(data, offsets, vec.BLANK_WORDS_FOLDED)
    h, at = words.windows(k)
    cut = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.counts().tolist()):
        if n >= k:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        else:
            out.append(vec.sequence_hash(words.hash, words.first[i : i + 1], n) if n else h[:0])
    return out


def _minima(s: np.ndarray) -> np.ndarray:
    """The min-hash values of a set."""
    xor, mul = _functions()
    x = (s >> vec.U64(32)).astype(np.uint32)
    best = np.full(_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 1024):
        v = x[lo : lo + 1024, None] ^ xor
        v *= mul
        np.minimum(best, v.min(axis=0), out=best)
    return best


def _set_key(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return vec.mix(s ^ vec.U64(0x6A09E667F3BCC909)).sum(), vec.mix(s ^ vec.U64(0xBB67AE8584CAA73B)).sum()


def sign(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, keys, sketch, parity): set size, 128-bit set key, sort keys, sketch and bucket parities."""

    def work(batch: pa.RecordBatch):
        for lo, hi, data, offsets in vec.slices(batch.column("text")):
            sets = shingle_sets(data, offsets, k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            key = np.zeros((hi - lo, 2), dtype=vec.U64)
            best = np.zeros((hi - lo, _HASHES), dtype=np.uint32)
            parity = np.zeros((hi - lo, _PARITY // 8), dtype=np.uint8)
            for i, s in enumerate(sets):
                if len(s):
                    key[i] = _set_key(s)
                    best[i] = _minima(s)
                    bucket = (vec.mix(s ^ vec.U64(0x3C6EF372FE94F82B)) % vec.U64(_PARITY)).astype(np.int64)
                    parity[i] = np.packbits((np.bincount(bucket, minlength=_PARITY) & 1).astype(bool))
            high = ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
            two = ((best * np.uint32(0x85EBCA6B)) >> np.uint32(30)).astype(np.uint8).reshape(hi - lo, _HASHES // 4, 4)
            packed = (two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), _binary(high), _binary(packed), _binary(parity)],
                ["doc_id", "n_shingles", "k1", "k2", "keys", "sketch", "parity"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), work, f"doc_id {kind}, n_shingles long, k1 long, k2 long, keys binary, sketch binary, parity binary")


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows[0].nbytes if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    data, offsets, _ = vec.buffers(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=kind).reshape(len(column), width)


def _orders(batch: pa.RecordBatch):
    """One row for each tree: (tree, key, salt, id, sketch)."""
    n = batch.num_rows
    keys = _matrix(batch.column("keys"), "u1", 2 * _HASHES).reshape(n, _HASHES, 2)
    names = ["salt", "id", "sketch"]
    for t in range(TREES):
        key = keys[:, t * DEPTH : (t + 1) * DEPTH]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, dtype=np.int32)), _binary(key.reshape(n, 2 * DEPTH)), *(batch.column(c) for c in names)], ["tree", "key", *names])


def _windows(batches):
    """For each run of sorted rows: (ids, row and predecessor of each candidate, differing fields of the sketches, rows of cut windows)."""
    held: tuple | None = None
    low = vec.U64(0x5555555555555555)
    for batch in batches:
        if not batch.num_rows:
            continue
        run = (batch.column("tree").to_numpy(), _matrix(batch.column("key"), ">u2", DEPTH), batch.column("id").to_numpy(), _matrix(batch.column("sketch"), "<u8", _HASHES // 32))
        old, begins = 0, held is None
        if held is not None:
            old = len(held[0])
            run = tuple(np.concatenate([x, y]) for x, y in zip(held, run, strict=True))
        tree, key, ids, sketch = run
        n = len(tree)
        same = np.cumprod(key[1:] == key[:-1], axis=1).sum(axis=1)
        step = np.r_[0, np.where(tree[1:] == tree[:-1], same, 0)]
        at = np.arange(old, n)
        depth = np.full(len(at), DEPTH)
        rows, froms, far, cut = [at[:0]], [at[:0]], [np.zeros(0, dtype=np.int32)], []
        for back in range(1, REACH + 1):
            inside = at >= back
            if begins:
                cut.append(at[~inside])  # what is before the first row is in another partition
            at, depth = at[inside], depth[inside]
            depth = np.minimum(depth, step[at - back + 1])
            deep = depth >= LEAST_DEPTH
            at, depth = at[deep], depth[deep]
            if not len(at):
                break
            x = sketch[at] ^ sketch[at - back]
            miss = np.bitwise_count((x | x >> vec.U64(1)) & low).sum(axis=1)
            ok = miss <= _MISMATCHES
            rows.append(at[ok])
            froms.append(at[ok] - back)
            far.append(miss[ok].astype(np.int32))
        # any two rows of a region that no window holds are both marked: one is full, the other REACH before a full one
        cut += [at, at - REACH]
        held = tuple(x[-REACH:].copy() for x in run)
        yield ids, np.concatenate(rows), np.concatenate(froms), np.concatenate(far), np.concatenate(cut)
    if held is not None:  # what follows the last row is in another partition
        tree, key, ids, _ = held
        near = (tree == tree[-1]) & (key[:, :LEAST_DEPTH] == key[-1, :LEAST_DEPTH]).all(axis=1)
        none = np.zeros(0, dtype=np.int64)
        yield ids, none, none, none, np.flatnonzero(near)


def _candidates(a: np.ndarray, b: np.ndarray, miss: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(miss.astype(np.int32))], ["a", "b", "miss"])


def _neighbours(batches):
    """The most alike candidates within each sorted run: (a, b, differing fields), and (id, id, -1) of the classes of a cut window."""
    for ids, r, f, m, cut in _windows(batches):
        order = np.lexsort((-f, m, r))
        r, f, m = r[order], f[order], m[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else r
        many = np.diff(np.r_[first, len(r)])
        rank = np.arange(len(r)) - np.repeat(first, many)
        more = np.repeat(many, many) > _FEW
        keep = rank < np.where(more, _BEST, _FEW)
        yield _candidates(ids[r[keep]], ids[f[keep]], m[keep])
        cut = np.unique(ids[np.concatenate([r[more], f[more], cut])])
        yield _candidates(cut, cut, np.full(len(cut), -1))


def _sorted(classes: DataFrame) -> DataFrame:
    """The orders of classes (id, k2, keys, sketch), dealt by range."""
    rows = classes.select("id", F.col("k2").alias("salt"), "keys", "sketch")
    trees = map_arrow(rows, _orders, "tree int, key binary, salt long, id long, sketch binary")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return trees.repartitionByRange(parts, "tree", "key", "salt").sortWithinPartitions("tree", "key", "salt")


def _count_slot(s: np.ndarray) -> np.ndarray:
    return (vec.mix(s ^ vec.U64(0xA54FF53A5F1D36F1)) >> vec.U64(20)).astype(np.int64) & (_COUNTS - 1)


def _all_sets(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets, _ = vec.buffers(batch.column("s"))
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=np.uint64)


def _slot_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = np.bincount(_count_slot(_all_sets(batch)), minlength=_COUNTS)
    slot = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n[slot])], ["slot", "n"])


def _first_shingles(counts, percent: int, wanted=None):
    """(token, place, n, id, label, parity) of each set's first shingles in the order of counts; without parity if the rows have none.

    Sets of similarity p share p of the larger one at least, hence one of its first n - pn + 1.
    ``wanted`` are bits of the tokens that are asked for, if not all.
    """

    def work(batch: pa.RecordBatch):
        _, offsets, _ = vec.buffers(batch.column("s"))
        s = _all_sets(batch)
        at = np.asarray(offsets[: batch.num_rows + 1]).astype(np.int64)
        size = np.diff(at - at[0]) // 8
        of = np.repeat(np.arange(batch.num_rows), size)
        order = np.lexsort((s, counts.value[_count_slot(s)], of))
        place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
        keep = place <= (size * (100 - percent) // 100)[of]
        of, token, place = of[keep], s[order][keep], place[keep]
        if wanted is not None:
            keep = wanted.value(token)
            of, token, place = of[keep], token[keep], place[keep]
        names = [c for c in ("id", "label", "parity") if c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(place), pa.array(size[of]), *(batch.column(c).take(pa.array(of)) for c in names)], ["token", "place", "n", *names])

    return work


def _meetings(percent: int):
    """The pairs of different components that meet at a shingle and may be alike enough: (a, b).

    Sets of n and n' shingles of similarity p share p (n + n') / (1 + p) at least, and the first shared
    shingle has the others behind it; sets that differ in d have similarity (n + n' - d) / (n + n' + d).
    """
    names = ("token", "x", "y", "own", "n", "place", "id", "label")

    def work(batches):
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            run = (*(batch.column(c).to_numpy() for c in names), _matrix(batch.column("parity"), "<u8", _PARITY // 64))
            old = 0
            if held is not None:
                old = len(held[0])
                run = tuple(np.concatenate([x, y]) for x, y in zip(held, run, strict=True))
            token, x, y, own, n, place, ids, label, parity = run
            begin = np.r_[True, (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            first = np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))
            rest, found = n - place, []
            early = rest * (100 + percent) >= 2 * percent * n  # the smaller of two sets, which is the former as rows of a shingle are sorted by n
            where = np.flatnonzero(early)
            before = np.cumsum(early) - early
            at, back = np.arange(old, len(token)), 0
            while True:
                back += 1
                at = at[before[at] >= back]
                at = at[where[before[at] - back] >= first[at]]
                to = where[before[at] - back]
                like = 100 * n[to] >= percent * n[at]
                at, to = at[like], to[like]
                if not len(at):
                    break
                both = n[at] + n[to]
                ok = (label[at] != label[to]) & ((x[at] == y[at]) | (own[at] != own[to])) & (np.minimum(rest[at], rest[to]) * (100 + percent) >= percent * both)
                r, f, both = at[ok], to[ok], both[ok]
                if len(r):
                    near = np.bitwise_count(parity[r] ^ parity[f]).sum(axis=1, dtype=np.int64) * (100 + percent) <= both * (100 - percent)
                    found.append(np.stack([ids[r[near]], ids[f[near]]]))
            held = tuple(v[first[-1] :].copy() for v in run)
            if found:
                a, b = np.concatenate(found, axis=1)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return work


def _exact(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of sets (id, label, s, parity) with different labels that may be alike enough; complete."""
    slots = map_arrow(sets.select("s"), _slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2^19 rows at most
    table = np.zeros(_COUNTS, dtype=np.uint32)
    table[slots["slot"].to_numpy()] = np.minimum(slots["n"].to_numpy(), 0xFFFFFFFF)
    counts = sets.sparkSession.sparkContext.broadcast(table)
    first = _first_shingles(counts, percent)
    mixed = map_arrow(sets.select("id", "label", "s"), first, "token long, place long, n long, id long, label long").groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.expr(f"(n - place) * {100 + percent} >= {2 * percent} * n")).alias("early"))
    mixed = stash(mixed.where("least <> most and early").select("token", F.ceil(F.col("many") / _BLOCK).cast("int").alias("blocks")), "tokens")
    asked = sets.sparkSession.sparkContext.broadcast(Bits(mixed, F.col("token")))
    rows = map_arrow(sets.select("id", "label", "s", "parity"), _first_shingles(counts, percent, asked), "token long, place long, n long, id long, label long, parity binary").join(mixed, "token")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(31)), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "n", "place", "id", "label", "parity")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "n").mapInArrow(_meetings(percent), "a long, b long").distinct()


def _similar(percent: int):
    """Keeps the pairs whose full sets are alike enough."""

    def work(batch: pa.RecordBatch):
        da, oa, _ = vec.buffers(batch.column("sa"))
        db, ob, _ = vec.buffers(batch.column("sb"))
        ok = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(da[oa[i] : oa[i + 1]].tobytes(), dtype=np.uint64), np.frombuffer(db[ob[i] : ob[i + 1]].tobytes(), dtype=np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.sort(np.concatenate([x, y]))
            inter = int((both[1:] == both[:-1]).sum())
            ok[i] = 100 * inter >= percent * (len(both) - inter)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return work


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), _similar(percent), f"a {kind}, b {kind}")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).distinct()


def _sets_of(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, s): the full sets, as hashes, of wanted classes (id, low, k1, k2), from the documents of smallest doc_id."""
    held = documents.sparkSession.sparkContext.broadcast(Bits(wanted, F.xxhash64("low")))

    def work(batch: pa.RecordBatch):
        batch = batch.take(pa.array(held.value(batch.column("h").to_numpy().view(np.uint64))))
        for _, _, data, offsets in vec.slices(batch.column("text")):
            found = [s for s in shingle_sets(data, offsets, k) if len(s)]
            key = np.array([_set_key(s) for s in found], dtype=vec.U64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([s.tobytes() for s in found], pa.binary())], ["k1", "k2", "s"])

    rows = map_arrow(documents.where("doc_id is not null").select("text", F.xxhash64("doc_id").alias("h")), work, "k1 long, k2 long, s binary")
    return rows.dropDuplicates(["k1", "k2"]).join(wanted.select("id", "k1", "k2"), ["k1", "k2"]).select("id", "s")


def near_duplicates(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; doc_id must be an integer."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(sign(documents, k).withColumn("row", F.monotonically_increasing_id()), "signed")  # row numbers hold once they are written
    full = signed.where("n_shingles > 0 and doc_id is not null")
    names = stash(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.min_by("row", "doc_id").alias("id")), "classes")
    classes = full.withColumnRenamed("row", "id").join(names.select("id"), "id", "left_semi").select("id", "k2", "keys", "sketch", "parity")
    found = stash(_sorted(classes).mapInArrow(_neighbours, _PAIR).groupBy("a", "b").agg(F.min("miss").alias("miss")), "pairs")
    pairs, dense = found.where("a <> b"), found.where("miss < 0").select(F.col("a").alias("id")).distinct()
    held = stash(_sets_of(documents, stash(names.join(_ends(pairs).toDF("id"), "id", "left_semi"), "wanted"), k), "sets")
    both = pairs.select("a", "b", "miss", F.col("a").alias("of")).union(pairs.select("a", "b", "miss", F.col("b").alias("of")))
    first = both.groupBy("of").agg(F.min(F.struct("miss", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    links = _confirm(first, held, percent)
    several = full.groupBy("doc_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("k1", "k2") for n, f in (("low", F.min), ("high", F.max)))).where("low_k1 <> high_k1 or low_k2 <> high_k2")
    several = stash(several.select("doc_id"), "several")
    if not several.isEmpty():  # texts of one doc_id
        own = full.join(several, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct().join(names, ["k1", "k2"]).select("doc_id", "id")
        links = links.union(own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b")))
    links = stash(links, "links")
    labels = components(links)
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    rest = pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(la, a) <> coalesce(lb, b)").join(first, ["a", "b"], "left_anti")
    more = stash(_confirm(rest, held, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    if not dense.isEmpty():
        missing = stash(names.join(dense.join(held.select("id"), "id", "left_anti"), "id", "left_semi"), "wanted")
        if not missing.isEmpty():
            held = held.union(stash(_sets_of(documents, missing, k), "sets"))
        marked = classes.select("id", "parity").join(dense, "id", "left_semi").join(labels.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        others = stash(_exact(stash(marked.join(held, "id"), "marked"), percent), "pairs")
        others = others.join(pairs, ["a", "b"], "left_anti")
        more = stash(_confirm(others, held, percent), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    labels = labels.toDF("id", "label")
    smallest = labels.join(names, "id").groupBy("label").agg(F.min("low").alias("component"))
    of_class = names.join(labels.join(smallest, "label"), "id", "left").select("k1", "k2", F.coalesce("component", "low").alias("component"))
    joined = signed.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents but those that have a near-duplicate of smaller doc_id in their group; all columns stay."""
    gone = near_duplicates(documents, k, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return documents.join(gone, documents["doc_id"].cast("long") == gone["gone"], "left_anti").select(*(documents[c] for c in documents.columns))
