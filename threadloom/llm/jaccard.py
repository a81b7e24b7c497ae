"""N-gram Jaccard self-join by token-combination prefixes.

A document's *tokens* are its distinct runs of ``GRAM`` words.  Two documents are
near copies if the Jaccard similarity of their token sets is at least
``THRESHOLD``.  The join is exact:

* Frequencies.  The documents of every token are counted, over all documents, in
  a shuffle of 4-byte residues.  Each owner of a range of token hashes gives the
  classes of its range as a table of 2 bits a slot, of bounded size, which is
  broadcast.  Tokens that share a slot get the higher class.
* Classes.  0: in one document; 1: in fewer than ``FREQUENT``; 2: in fewer than
  ``VERY``; 3: the rest.  Tokens are ordered by class, then by hash.
* Index.  Tokens of class 1 are indexed singly; those of classes 2 and 3 only in
  combinations of two and three tokens of one class and hash group; those of
  class 0 not at all, since no other document has them.
* Prefix.  With t = |x| - ceil(THRESHOLD |x|), at most t tokens of x lack in a
  partner.  The prefix is extended until sum over groups of max(0, c - k + 1),
  c being the prefix's tokens in the group, reaches t + l.  Whichever t tokens
  lack, l combinations are then shared by the two prefixes, where l (``_need``)
  grows with the document: a pair counts as a candidate only with that many.
  A document with more than t + l tokens of its own is near no other, and
  indexed nowhere.
* Groups.  Texts that share an index entry with many others are candidates as
  a group, whose entries are all those of its members: two groups are candidates
  if any two members would be, so no pair is lost, and a dense cluster has rows
  for its few groups instead of its pairs.  Each text joins the entry that most
  texts have, and a large group is split into several.
* Verification.  Candidates' token sets are brought together once per cluster of
  candidates (not once per pair) and intersected, each of a group with each of
  the other.  Links are counted where they are found; of the pairs only a
  spanning forest is returned, unless all are asked for.

The hash groups of the frequent classes get finer with the size of a document
(its power of two), which keeps the number of combinations in proportion to the
prefix; partners differ in size class by one at most, so a document is also
indexed under the next class's groups where a partner may be that large.
Small documents (size class <= ``_SMALL``) are indexed singly throughout.
Documents with equal token sets are one node of the join.

Any assignment of classes gives the same pairs: the table's size and collisions
only bear on speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textcore as tc
from threadloom.llm.common import BROADCAST_BYTES, bound_batches, broadcast_if_small, cut, drop_table, partitions, pick, run_size, table, without, write_table
from threadloom.llm.pairs import best_of_each, classes_of, components, pairs_within, roots

GRAM, THRESHOLD = 2, 0.7
FREQUENT, VERY = 64, 4096
_SMALL = 3
_U = np.uint64
#: Slots of the class table: about one for every two words of the corpus, within these powers of two (at most 64 MB).
_SLOT_BITS = (16, 28)
#: Texts that share an index entry from which they are candidates as a group, and texts of a group beyond which it is split.
_GROUP, _GROUP_ROWS = 64, 800
#: Pairs that one verification task takes of a cluster; a larger cluster is split into a grid of blocks.
_BLOCK_PAIRS = 200_000
#: Bytes of token residues, and characters of text behind the index entries, that a bucket holds: what a task has in memory doesn't grow with the input.
_BUCKET_BYTES, _BUCKET_CHARS = 32 << 20, 1 << 28


def token_sets(piece: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each document of a piece, and their ranges (length n + 1)."""
    w = tc.Words(piece)
    n = np.diff(w.first)
    if not len(w.hashes):
        return w.hashes, w.first
    h = w.hashes if GRAM == 1 else np.concatenate([tc.shingle_hashes(w.hashes, GRAM), np.zeros(min(GRAM - 1, len(w.hashes)), dtype=np.uint64)])[: len(w.hashes)]
    count = np.where(n >= GRAM, n - GRAM + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), n)
    keep = np.arange(len(h)) - w.first[doc] < count[doc]
    h = h[keep]
    first = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero((n > 0) & (n < GRAM)):
        h[first[i]] = tc.shingle_hashes(w.hashes[w.first[i] : w.first[i + 1]], GRAM)[0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][count > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[first]


def set_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit keys of the token sets (as int64)."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(tc.mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5)))])
    return tc.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _need(size: int) -> int:
    """Shared combinations that are asked of a pair, from one set's size: 1 for small sets, up to 4."""
    return max(1, min(4, size // 32))


#: A multiple of all numbers that ``_need`` gives.
_ENOUGH = 12


def _size_class(size: int) -> int:
    return int(size).bit_length() - 1


def missing(size: int) -> int:
    """The most tokens of a set of this size that a partner can lack."""
    return size - int(np.ceil(THRESHOLD * size - 1e-9))


def signatures(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """All index entries of one document: singles and combinations of its prefixes, as 64-bit hashes.

    ``tokens`` are distinct and sorted, ``level`` their classes (0 to 3).
    """
    size = len(tokens)
    want = missing(size) + _need(size)
    counts = np.bincount(level, minlength=4)
    if counts[0] >= want:
        return tokens[:0]
    order = np.argsort(level, kind="stable")
    tokens, level = tokens[order], level[order]
    if counts[0] + counts[1] >= want:
        return tokens[counts[0] : want]
    out = []
    for z in range(_size_class(size), _size_class(int(size / THRESHOLD + 1e-9)) + 1):
        if z <= _SMALL:
            out.append(tokens[counts[0] : want])
            continue
        k = np.maximum(level, 1)
        groups = np.where(k == 2, max(1, (1 << z) // 12), max(1, (1 << z) // 16))
        group = np.where(k == 1, 0, (tc.mix(tokens ^ _U(z)) % groups.astype(np.uint64)).astype(np.int64) * 4 + k)
        # The place of each token within its group, in prefix order, tells whether it adds to the coverage.
        by = np.argsort(group, kind="stable")
        g = group[by]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        rank = np.empty(size, dtype=np.int64)
        rank[by] = np.arange(size) - np.repeat(first, np.diff(np.append(first, size)))
        end = min(size, int(np.searchsorted(np.cumsum(rank >= k - 1), want)) + 1)
        out.append(tokens[counts[0] : min(end, counts[0] + counts[1])])
        mixed = tc.mix(tokens[:end] ^ _U(0x51ED270B * (z + 1)))
        # Combinations of all groups at once: each member with those 1, 2, ... places before it in its group.
        inside = by[by < end]
        g, x, r = group[inside], mixed[inside], rank[inside]
        for kind in (2, 3):
            mine = np.flatnonzero(g % 4 == kind)
            if len(mine) < kind:
                continue
            xs, rs = x[mine], r[mine]
            for a in range(1, int(rs.max()) + 1):
                i = np.flatnonzero(rs >= a)
                pair = xs[i] + xs[i - a]
                if kind == 2:
                    out.append(tc.mix(pair))
                else:
                    for b in range(a + 1, int(rs.max()) + 1):
                        j = rs[i] >= b
                        out.append(tc.mix(pair[j] + xs[i[j] - b] + _U(3)))
    return np.unique(np.concatenate(out))


# == frequencies


def _residues(bits: int, run: int):
    """Worker function: (doc_id, text) to rows of a bucket's residues and of the set keys, ids and sizes that it owns, for each ``run`` tokens."""

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, ids, sizes, held = [], [], [], [], 0

        def flush():
            t = np.sort(np.concatenate(tokens))
            at = np.searchsorted((t >> _U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1)) if bits else np.array([0, len(t)])
            low = ((t >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
            k, i, s = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
            by = np.argsort(k.view(np.uint64), kind="stable")
            k, i, s = k[by], i[by], s[by]
            own = np.searchsorted((k.view(np.uint64) >> _U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1)) if bits else np.array([0, len(k)])
            rows = []
            for b in np.flatnonzero(np.diff(at) + np.diff(own)).tolist():
                mine = slice(own[b], own[b + 1])
                rows.append((b, low[at[b] : at[b + 1]].tobytes(), k[mine].tobytes(), i[mine].tobytes(), s[mine].tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "low", "k", "i", "s"])

        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for start, piece in tc.pieces(tc.as_text(batch.column(1))):
                t, first = token_sets(piece)
                some = np.flatnonzero(np.diff(first))
                tokens.append(t)
                keys.append(set_keys(t, first)[some])
                ids.append(doc_ids[start + some])
                sizes.append(np.diff(first)[some].astype(np.int32))
                held += len(t)
                if held > run:
                    yield flush()
                    tokens, keys, ids, sizes, held = [], [], [], [], 0
        if held:
            yield flush()

    return residues


def _classes(bits: int, slot_bits: int, frequent: int, very: int):
    """Worker function: the rows of a bucket to its part of the class table, and to one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, blob, k, i, s in zip(*(batch.column(c).to_pylist() for c in range(5))):
                low.setdefault(b, []).append(np.frombuffer(blob, dtype=np.uint32))
                n = len(k) // 8
                if n:
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(np.frombuffer(k, dtype=np.int64)), pa.array(np.frombuffer(i, dtype=np.int64)), pa.array(np.frombuffer(s, dtype=np.int32))], names=["bucket", "part", "node", "doc_id", "size"])
        for b in sorted(low):
            t = np.sort(np.concatenate(low.pop(b)))
            new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, dtype=np.int64)
            df = np.diff(np.append(new, len(t)))
            many = df > 1
            slot = (t[new[many]] >> np.uint32(32 - (slot_bits - bits))).astype(np.int64)
            part = np.zeros(1 << (slot_bits - bits), dtype=np.uint8)
            np.maximum.at(part, slot, np.where(df[many] < frequent, 1, np.where(df[many] < very, 2, 3)).astype(np.uint8))
            q = part.reshape(-1, 4)
            packed = q[:, 0] | (q[:, 1] << 2) | (q[:, 2] << 4) | (q[:, 3] << 6)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], names=["bucket", "part", "node", "doc_id", "size"])

    return run


def levels(packed: np.ndarray, slot_bits: int, tokens: np.ndarray) -> np.ndarray:
    slot = (tokens >> _U(64 - slot_bits)).astype(np.int64)
    return (packed[slot >> 2] >> ((slot & 3) << 1).astype(np.uint8)) & 3


def frequencies(docs: DataFrame, chars: int) -> tuple[DataFrame, np.ndarray, int]:
    """(members: doc_id, node, size of each document with words; packed class table; bits of its slots), of texts of ``chars`` characters in all."""
    spark = docs.sparkSession
    slot_bits = min(_SLOT_BITS[1], max(_SLOT_BITS[0], int(np.ceil(np.log2(chars / 12 + 1)))))
    # A distinct token for every 5 characters at most, 4 bytes each.
    run = run_size(1_000_000, chars // 5)
    bits = min(slot_bits - 2, max(0, int(np.ceil(np.log2(max(partitions(spark), chars * 4 / 5 / max(_BUCKET_BYTES, 4 * run)))))))
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(tc.releasing(_residues(bits, run)), "bucket int, low binary, k binary, i binary, s binary")
    found = cut(rows.repartitionById(1 << bits, F.col("bucket")).mapInArrow(tc.releasing(_classes(bits, slot_bits, FREQUENT, VERY)), "bucket int, part binary, node bigint, doc_id bigint, size int"))
    packed = np.zeros(1 << (slot_bits - 2), dtype=np.uint8)
    each = 1 << (slot_bits - 2 - bits)
    for r in found.where("bucket is not null").select("bucket", "part").toLocalIterator():
        packed[r["bucket"] * each : (r["bucket"] + 1) * each] = np.frombuffer(r["part"], dtype=np.uint8)
    return found.where("bucket is null").select("doc_id", "node", "size").dropDuplicates(["doc_id", "node"]), packed, slot_bits


# == candidates


def _indexer(shared, slot_bits: int, buckets: int, run: int):
    """Worker function: texts to (bucket, blob) rows, a blob holding set key, size and signatures of many documents, for each ``run`` signatures."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        keys, sizes, sigs = [], [], []

        def flush():
            sig = np.concatenate(sigs)
            doc = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
            bucket = (sig % _U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            sig, doc, bucket = sig[by], doc[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            k, s = np.array(keys, dtype=np.int64), np.array(sizes, dtype=np.int32)
            ids, blobs = [], []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = cuts[b], cuts[b + 1]
                here, n = np.unique(doc[lo:hi], return_counts=True)
                low = np.ascontiguousarray((sig[lo:hi] // _U(buckets)).view(np.uint8).reshape(-1, 8)[:, :6])
                blobs.append(np.array([len(here), hi - lo], dtype=np.int64).tobytes() + k[here].tobytes() + s[here].tobytes() + n.astype(np.int32).tobytes() + low.tobytes())
                ids.append(b)
            return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int32()), pa.array(blobs, type=pa.binary())], names=["bucket", "blob"])

        held, seen = 0, set()
        for batch in batches:
            for _, piece in tc.pieces(tc.as_text(batch.column(0))):
                t, first = token_sets(piece)
                level = levels(packed, slot_bits, t)
                key = set_keys(t, first)
                own = np.concatenate([[0], np.cumsum(level == 0)])
                for i in range(len(piece)):
                    a, b = int(first[i]), int(first[i + 1])
                    size = b - a
                    if not size or own[b] - own[a] >= missing(size) + _need(size) or int(key[i]) in seen:
                        continue
                    sig = signatures(t[a:b], level[a:b])
                    if len(sig):
                        seen.add(int(key[i]))
                        keys.append(key[i])
                        sizes.append(size)
                        sigs.append(sig)
                        held += len(sig)
                if held > run:
                    yield flush()
                    keys, sizes, sigs, held, seen = [], [], [], 0, set()
        if sigs:
            yield flush()

    return index


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sizes and numbers of entries of a blob's documents, and the entries."""
    n, m = np.frombuffer(blob, dtype=np.int64, count=2)
    key = np.frombuffer(blob, dtype=np.int64, count=n, offset=16)
    size = np.frombuffer(blob, dtype=np.int32, count=n, offset=16 + 8 * n)
    each = np.frombuffer(blob, dtype=np.int32, count=n, offset=16 + 12 * n)
    low = np.zeros((m, 8), dtype=np.uint8)
    low[:, :6] = np.frombuffer(blob, dtype=np.uint8, count=6 * m, offset=16 + 16 * n).reshape(-1, 6)
    return key, size, each, low.view(np.uint64).ravel()


def _changes(*sorted_by: np.ndarray) -> np.ndarray:
    """Positions at which any of the arrays differs from the place before; the first is one."""
    n = len(sorted_by[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _entries(node: np.ndarray, each: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (entry, node) sorted by both, and the number of nodes of each entry."""
    node = np.repeat(node, each)
    by = np.lexsort((node, sig))
    sig, node = sig[by], node[by]
    keep = _changes(sig, node)
    sig, node = sig[keep], node[keep]
    return sig, node, np.diff(np.append(_changes(sig), len(sig)))


def _popular(buckets: int, least: int):
    """Worker function: index entries of one bucket to (node, n, entry): the entry that most nodes (n) have, of each node half of whose entries, or more, ``least`` nodes or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bucket = [], 0
        for batch in batches:
            parts += [_unpack(v.as_py()) for v in batch.column(1)]
            bucket = batch.column(0)[0].as_py() if batch.num_rows else bucket
        if not parts:
            return
        key, _, each, sig = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        sig, node, counts = _entries(key, each, sig)
        n = np.repeat(counts, counts)
        # Unrelated texts may share an entry with many; those of a dense cluster share most of theirs.
        names, at = np.unique(node, return_inverse=True)
        often = n >= least
        often &= (2 * np.bincount(at[often], minlength=len(names)) >= np.bincount(at, minlength=len(names)))[at]
        sig, node, n = sig[often], node[often], n[often]
        entry = tc.mix(sig * _U(buckets) + _U(bucket)).view(np.int64)
        by = np.lexsort((-entry, -n, node))
        by = by[_changes(node[by])]
        for lo in range(0, len(by), 50_000):
            at = by[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n[at].astype(np.int32)), pa.array(entry[at])], names=["node", "n", "entry"])

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of one bucket, and the groups of nodes that have one, to (a, b, weight) rows; a < b are groups (a node without one is its own) that have sizes which allow the threshold. A pair has what it needs if its weights come to ``_ENOUGH``."""
    parts, grouped = [], []
    for batch in batches:
        parts += [_unpack(v.as_py()) for v in batch.column(1) if v.is_valid]
        some = batch.filter(batch.column(1).is_null())
        grouped.append((some.column(2).to_numpy(), some.column(3).to_numpy()))
    if not parts:
        return
    key, size, each, sig = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    of, its = (np.concatenate(x).astype(np.int64) for x in zip(*grouped))
    group = key.copy()
    if len(of):
        by = np.argsort(of)
        of, its = of[by], its[by]
        at = np.minimum(np.searchsorted(of, key), len(of) - 1)
        group = np.where(of[at] == key, its[at], key)
    # Groups are numbered by their least size, so the partners of an entry are a run of the entries after it.
    by = np.lexsort((size, group))
    new = _changes(group[by])
    names, sizes, most = group[by][new], size[by][new].astype(np.int64), np.maximum.reduceat(size[by], new).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    number = np.empty(len(new), dtype=np.uint32)
    number[order] = np.arange(len(new), dtype=np.uint32)
    names, sizes, most = names[order], sizes[order], most[order]
    node = np.empty(len(key), dtype=np.uint32)
    node[by] = np.repeat(number, np.diff(np.append(new, len(by))))
    sig, node, counts = _entries(node, each, sig)
    # Entries that stand alone are dropped; of the others only the group and the end of the run is kept.
    node = node[np.repeat(counts > 1, counts)]
    counts = counts[counts > 1]
    ends = np.repeat(np.cumsum(counts), counts)
    del by, sig, counts, key, size, each, group
    held, total = [], (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))

    def merged():
        code = np.sort(np.concatenate(held)) if held else total[0][:0]
        new = _changes(code)
        n = np.concatenate([total[1], np.diff(np.append(new, len(code))).astype(np.int32)])
        code = np.concatenate([total[0], code[new]])
        by = np.argsort(code)
        code, n = code[by], n[by]
        new = _changes(code)
        return code[new], np.add.reduceat(n, new) if len(new) else n

    def rows_of(code, n):
        for lo in range(0, len(code), 50_000):
            i, j = (code[lo : lo + 50_000] >> _U(32)).astype(np.int64), (code[lo : lo + 50_000] & _U(0xFFFFFFFF)).astype(np.int64)
            weight = np.minimum(n[lo : lo + 50_000], 4) * (_ENOUGH // np.maximum(1, np.minimum(4, sizes[i] // 32)))
            a, b = names[i], names[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(weight.astype(np.int8))], names=["a", "b", "weight"])

    upto = np.cumsum(ends - np.arange(len(node)) - 1)
    at = fresh = 0
    while at < len(node):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000)))
        n = ends[at:stop] - np.arange(at, stop) - 1
        x = np.repeat(np.arange(at, stop), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        i, j = node[x], node[y]
        ok = most[i] >= np.ceil(THRESHOLD * sizes[j] - 1e-9)
        held.append((i[ok].astype(np.uint64) << _U(32)) | j[ok])
        fresh += len(held[-1])
        at = stop
        if fresh > 1_000_000:
            total, held, fresh = merged(), [], 0
            if len(total[0]) > 2_000_000:
                yield from rows_of(*total)
                total = (total[0][:0], total[1][:0])
    yield from rows_of(*merged())


def candidates(docs: DataFrame, shared, slot_bits: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """(node, group) of the nodes that are in a group, and (a, b), groups a < b of which two members share as many prefix combinations as they must; ``shared`` is the class table, broadcast.

    A node that isn't in a group stands for itself.
    """
    spark = docs.sparkSession
    # A near pair shares many entries; fewer buckets mean fewer rows for it.
    # About one entry for 64 characters; a bucket holds as many as a run where the input is large.
    run = run_size(300_000, chars // 64)
    buckets = max(4, partitions(spark) // 6, -(-chars // max(_BUCKET_CHARS, 64 * run)))
    blobs, path = write_table(docs.where("text is not null and doc_id is not null").select("text").mapInArrow(tc.releasing(_indexer(shared, slot_bits, buckets, run)), "bucket int, blob binary"), "index")
    popular = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(tc.releasing(_popular(buckets, _GROUP)), "node bigint, n int, entry bigint")
    best = cut(popular.groupBy("node").agg(F.max(F.struct("n", "entry"))["entry"].alias("entry")))
    parts = best.groupBy("entry").agg(F.ceil(F.count("*") / _GROUP_ROWS).alias("parts"))
    group = F.when(F.col("parts") == 1, F.col("entry")).otherwise(F.xxhash64("entry", F.pmod(F.xxhash64("node"), "parts")))
    grouped = cut(best.join(parts, "entry").select("node", group.alias("group")))
    # Every bucket is told, as weights only add up under the same names.
    told = grouped.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "node", "group")
    rows = blobs.select("bucket", "blob", F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("group")).unionByName(told)
    found = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(tc.releasing(_pair_counts), "a bigint, b bigint, weight tinyint")
    near = cut(found.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= _ENOUGH).select("a", "b"))
    drop_table(spark, path)
    return grouped, near


# == verification


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a[i]] and sets[b[i]]."""
    if len(a) < 8 * len(sets) or len(sets) > 2048:
        out = np.zeros(len(a), dtype=np.int64)
        for n, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            out[n] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum() if len(y) else 0
        return out
    # Many pairs of few sets: products of 0/1 matrices over the tokens that two sets have, some thousand columns at a time.
    every = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, col, n = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    keep = n[col] > 1
    doc, col = doc[keep], place[col[keep]]
    by = np.argsort(col, kind="stable")
    doc, col = doc[by], col[by]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int((n > 1).sum()), 2048):
        s, e = np.searchsorted(col, (lo, lo + 2048))
        x = np.zeros((len(sets), 2048), dtype=np.float32)
        x[doc[s:e], col[s:e] - lo] = 1
        total += x @ x.T
    return total[a, b].astype(np.int64)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of bigint arrays (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(off[:-1], off[1:])]


def _verify(expand: bool):
    """Worker function: rows sorted by cluster and, within it, sets (kind 0, a: node, b: its group) before pairs of groups (kind 1), to near pairs of documents, or to links.

    ``ids`` of a set are the documents that have it; for links two numbers instead: how
    many of them have that text only, and how many have several.  Links are a (node),
    b (the least node it is connected with here) and links (near documents of one
    text), and a, b and NULL for near nodes of which either has documents of several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, sets, names, place, sizes, members, pairs = None, [], [], {}, [], [], []

        def near():
            """Near pairs (places of sets, value): large groups one pair of groups at a time, the others together."""
            size, few = np.array(sizes), []
            for g, h in pairs:
                x, y = (np.array(place[k], dtype=np.int64) for k in (g, h))
                i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                if g == h:
                    i, j = i[i < j], j[i < j]
                if len(i) < 256:
                    few.append((i, j))
                    continue
                yield from close(size, i, j)
            if few:
                yield from close(size, *(np.concatenate(c) for c in zip(*few)))

        def close(size, i, j):
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            both = _overlaps([sets[k] for k in some.tolist()], at[: len(i)], at[len(i) :])
            union = size[i] + size[j] - both
            ok = both >= THRESHOLD * union - 1e-9
            if ok.any():
                yield i[ok], j[ok], both[ok] / union[ok]

        def links():
            name, count = np.array(names, dtype=np.int64), np.zeros(len(names), dtype=np.int64)
            one, several = np.array(members, dtype=np.int64).reshape(-1, 2).T
            ends = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
            for i, j, _ in near():
                np.add.at(count, i, one[j])
                np.add.at(count, j, one[i])
                some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                ends.append((some, some[roots(len(some), at[: len(i)], at[len(i) :])]))
                told = (several[i] > 0) | (several[j] > 0)
                for lo in range(0, int(told.sum()), 100_000):
                    x, y = name[i[told][lo : lo + 100_000]], name[j[told][lo : lo + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], names=["a", "b", "links"])
            a, b = (np.concatenate(c) for c in zip(*ends))
            root, some = roots(len(names), a, b), np.unique(a)
            yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(name[root[some]]), pa.array(count[some])], names=["a", "b", "links"])

        def spelled():
            many = np.array([len(m) for m in members], dtype=np.int64)
            for i, j, value in near():
                at = 0
                upto = np.cumsum(many[i] * many[j])
                while at < len(i):
                    stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 100_000)))
                    x = np.concatenate([np.repeat(members[p], many[q]) for p, q in zip(i[at:stop].tolist(), j[at:stop].tolist())])
                    y = np.concatenate([np.tile(members[q], many[p]) for p, q in zip(i[at:stop].tolist(), j[at:stop].tolist())])
                    v = np.repeat(value[at:stop], many[i[at:stop]] * many[j[at:stop]])
                    for lo in range(0, len(x), 1_000_000):
                        p, q, r = x[lo : lo + 1_000_000], y[lo : lo + 1_000_000], v[lo : lo + 1_000_000]
                        own = p != q
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)[own]), pa.array(np.maximum(p, q)[own]), pa.array(r[own])], names=["doc_a", "doc_b", "jaccard"])
                    at = stop

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for c, kind, a, b, size, blob, ids in zip(*columns, _lists(batch.column(6))):
                if c != cluster:
                    if pairs:
                        yield from spelled() if expand else links()
                    cluster, sets, names, place, sizes, members, pairs = c, [], [], {}, [], [], []
                    here = set()
                if kind:
                    pairs.append((a, b))
                elif a not in here:
                    here.add(a)
                    place.setdefault(b, []).append(len(sets))
                    token = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
                    token[:, 2:] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
                    sets.append(token.view(np.uint64).ravel())
                    names.append(a)
                    sizes.append(size)
                    members.append(ids.copy())
        if pairs:
            yield from spelled() if expand else links()

    return run


def verified(docs: DataFrame, nodes: DataFrame, grouped: DataFrame, near: DataFrame, shared, slot_bits: int, expand: bool) -> DataFrame:
    """What :func:`_verify` makes of the candidates ``near`` (a, b: groups) and of the pairs within the groups of ``grouped`` (node, group): pairs of documents, a pair for each pair of nodes, or links of nodes.

    A pair is verified in the cluster of its larger group, so that single texts
    travel to the group and not the reverse; a pair of single texts in that of its
    lesser one's least neighbour.  A large cluster is cut into blocks.  ``nodes`` (node, first: a document, ids) travel
    with the sets, so that pairs are first spelled out after the last shuffle.
    """
    spark = docs.sparkSession
    of = cut(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    several = of.count()
    sized = lambda df, k: df.join(broadcast_if_small(of.select(F.col("group").alias(k), F.col("n").alias(f"n_{k}")), 16, several), k, "left")
    label = near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    pairs = near.unionByName(of.select(F.col("group").alias("a"), F.col("group").alias("b")))
    pairs = sized(sized(pairs, "a"), "b").select("a", "b", F.coalesce("n_a", F.lit(1)).alias("n_a"), F.coalesce("n_b", F.lit(1)).alias("n_b"))
    to = F.when(F.col("n_a") > F.col("n_b"), F.col("a")).when(F.col("n_a") < F.col("n_b"), F.col("b")).when(F.col("n_a") > 1, F.col("a")).otherwise(F.coalesce("label", "a"))
    tagged, tags = write_table(pairs.join(label, F.col("a") == F.col("node"), "left").select(to.alias("label"), "a", "b", (F.col("n_a") * F.col("n_b")).alias("n")), "pairs")
    wide = tagged.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") > _BLOCK_PAIRS).select("label", F.ceil(F.sqrt(F.col("n") / F.lit(_BLOCK_PAIRS))).cast("int").alias("side"))
    part = lambda k: F.pmod(F.xxhash64(k), F.coalesce("side", F.lit(1)))
    blocked, blocks = write_table(tagged.join(wide, "label", "left").select(F.xxhash64("label", part("a"), part("b")).alias("cluster"), "a", "b"), "blocks")
    drop_table(spark, tags)
    ends = blocked.select("cluster", F.explode(F.array("a", "b")).alias("group"))
    named = nodes.join(grouped, "node", "left").select(F.coalesce("group", "node").alias("group"), "node", "first", "ids")
    wanted = cut(ends.groupBy("group").agg(F.collect_set("cluster").alias("clusters")).join(named, "group").select(F.col("first").alias("_id"), "node", "group", "clusters", "ids"))

    def blob(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            keys, sets, sizes = [np.zeros(0, dtype=np.int64)], [], []
            for _, piece in tc.pieces(tc.as_text(text)):
                t, first = token_sets(piece)
                keys.append(set_keys(t, first))
                # Tokens of no other document can't be in an intersection; of the rest 6 bytes tell them apart within a cluster.
                kept = levels(shared.value, slot_bits, t) > 0
                at = np.concatenate([[0], np.cumsum(kept)])[first]
                low = np.ascontiguousarray(t[kept].view(np.uint8).reshape(-1, 8)[:, 2:])
                sizes += np.diff(first).tolist()
                sets += [low[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(sets, type=pa.binary()), pa.array(sizes, type=pa.int64())], names=["key", "blob", "size"])
        tc.release()

    udf = F.arrow_udf(blob, "struct<key bigint, blob binary, size bigint>")
    held = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("clusters") + F.size("ids") + 8), F.lit(0)).alias("words")).first()
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null").join(F.broadcast(wanted) if held["words"] * 8 <= BROADCAST_BYTES else wanted, "_id").select("node", "group", "clusters", "ids", udf("text").alias("s"))
    # An id with several texts brings each of them; only the node's own counts.
    sets = texts.where("s.key = node").select(F.explode("clusters").alias("cluster"), F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("group").alias("b"), "s.size", "s.blob", "ids")
    rows = sets.unionByName(blocked.select("cluster", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("array<bigint>").alias("ids")))
    rows = rows.repartition(partitions(spark), "cluster").sortWithinPartitions("cluster", "kind")
    if expand:
        return rows.mapInArrow(tc.releasing(_verify(True)), "doc_a bigint, doc_b bigint, jaccard double")
    links = cut(rows.mapInArrow(tc.releasing(_verify(False)), "a bigint, b bigint, links bigint"))
    drop_table(spark, blocks)
    return links


def join_nodes(docs: DataFrame, expand: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join of distinct token sets: members (doc_id, node, size), nodes (node, first: the least document, ids), and their links, or near pairs of documents. ``ids`` are a node's documents, or for links how many of them have one text and how many have several."""
    docs = pick(docs, "doc_id", "text")
    spark = docs.sparkSession
    bound_batches(spark)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    members, packed, slot_bits = frequencies(docs, chars)
    if expand:
        ids, of = F.sort_array(F.collect_list("doc_id")), members
    else:
        ids, of = F.array(F.count_if(F.col("texts") == 1), F.count_if(F.col("texts") > 1)), members.groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).select("doc_id", F.explode("nodes").alias("node"), F.size("nodes").alias("texts"))
    nodes = cut(of.groupBy("node").agg(F.min("doc_id").alias("first"), ids.alias("ids")))
    shared = spark.sparkContext.broadcast(packed)
    grouped, near = candidates(docs, shared, slot_bits, chars)
    return members, nodes, verified(docs, nodes, grouped, near, shared, slot_bits, expand)


def near_pairs(docs: DataFrame) -> DataFrame:
    """All pairs doc_a < doc_b with jaccard at least ``THRESHOLD``.

    Null and empty texts, and texts without words, are near nothing; a text of
    fewer than ``GRAM`` words has one token, all its words.  Rows with a NULL
    doc_id take no part.  Equal texts are pairs with jaccard 1.  Repeated rows
    count once; a doc_id with several texts takes part with each of them, never
    with itself, and a pair then has its greatest jaccard.  An empty table gives
    no pairs.  Other columns are ignored whatever their names, in any case.
    """
    members, nodes, across = join_nodes(docs, expand=True)
    pairs = across.unionByName(pairs_within(nodes, "doc_a", "doc_b", "jaccard"))
    return best_of_each(pairs, members.select(F.col("doc_id").alias("id"), "node"), "doc_a", "doc_b", "jaccard")


def classes(docs: DataFrame) -> DataFrame:
    """One row a document (doc_id that isn't NULL): class_id, the least doc_id that it is connected with by near pairs, and links, the number of documents near it.

    The pairs are those of :func:`near_pairs`, and none is left out of links; they
    are counted where they are found and not spelled out.  A document without any
    has its own class and 0 links.
    """
    members, nodes, found = join_nodes(docs)
    return classes_of(pick(docs, "doc_id").select(F.col("doc_id").alias("id")), members.select(F.col("doc_id").alias("id"), "node"), nodes, found).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less those whose document is near another of its group (chain of near pairs) with a smaller doc_id.

    A doc_id that is repeated is one document, whose rows share its fate (the
    first text's, by node key, where they differ); rows with a NULL doc_id or
    without words stay, and so does every row of an empty table.  Names of other
    columns don't matter, in any case.
    """
    members, _, found = join_nodes(docs)
    one = members.groupBy("doc_id").agg(F.min("node").alias("node"))
    group = components(found.select("a", "b"))
    tagged = one.join(group, "node", "left").select("doc_id", F.coalesce("group", "node").alias("group"))
    first = tagged.groupBy("group").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = cut(tagged.join(first, "group").where("doc_id > first").select("doc_id"))
    return without(docs, "doc_id", broadcast_if_small(gone, 16))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of each document, and the number of its links."""
    return classes(table(spark, sf_dir, "documents"))


#: All pairs, by their shared word bigrams; what each document reaches by them, and how many it has.
JACCARD_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
t AS (SELECT DISTINCT k, doc_id, unnest(CASE WHEN len(ws) < {GRAM} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gram FROM w WHERE len(ws) > 0),
n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
p AS (SELECT a.k AS ka, b.k AS kb, least(a.doc_id, b.doc_id) AS doc_a, greatest(a.doc_id, b.doc_id) AS doc_b, count(*) AS c FROM t a JOIN t b ON a.gram = b.gram AND a.k < b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS (SELECT doc_a, doc_b, max(c::DOUBLE / (x.n + y.n - c)::DOUBLE) AS jaccard FROM p JOIN n x ON x.k = ka JOIN n y ON y.k = kb
WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9 GROUP BY doc_a, doc_b),
e AS (SELECT doc_a AS x, doc_b AS y FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT doc_id, coalesce(least(doc_id, c.y), doc_id) AS class_id, coalesce(links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN c ON c.x = doc_id LEFT JOIN l ON l.x = doc_id"""
