"""Substring dedup with prefix-partitioned suffix trees.

A word is removed when a window of ``WINDOW`` words that covers it also starts
anywhere else in the corpus. The windows are the suffixes of the word sequence
cut at that depth; equal windows share a node of that depth in the suffix tree,
and the windows under deep nodes, run together, are the maximal repeats.

The tree is never in one place (TRELLIS, Phoophakdee & Zaki 2007; ERA, Mansour
et al. 2011): suffixes are split into subtrees by prefixes of variable length.

1. *Prefixes.* A window hangs under its least ``PREFIX``-word gram, which equal
   windows share. Only places where such a gram is the least one are counted
   (one word in a dozen); a prefix that occurs once holds a single leaf, so its
   windows cannot repeat and go no further.
2. *Groups.* The other windows are dealt to memory-sized groups by prefix; a
   prefix with more than ``HEAVY`` places is extended to the first ``SPLIT``
   words of the window. Equal windows of one bucket of documents are one leaf
   with a mark, so a passage in a third of all documents is one leaf a bucket.
3. *Subtrees.* A group sorts its leaves by path label (two fingerprints, words
   up to ``SPLIT`` and from there on: 128 bits a window) and takes neighbours'
   common depth; leaves under a node of full depth are repeats.

Documents stay in buckets of bounded text: they are dealt once, compressed, and
bitmaps of repeated leaves come back to them.

Edge cases: a null or empty text has no words; a text shorter than a window
loses none; repeated rows are each other's repeats; rows with equal or no id
are separate documents; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.components import stored
from kassa.llm.words import (SPACE_WORDS, Words, give_back, mix, text_slices, tidy,
                             window_hashes)

WINDOW = 35
PREFIX = 12
SPLIT = 18
HEAVY = 4096                    # places of a prefix before it is extended
BUCKET_BYTES = 16 << 20         # text of a bucket of documents
PREFIXES_PER_TASK = 4_000_000
GROUP_BYTES = 32 << 20          # text behind one group of subtrees
_NONE = np.uint64(2**64 - 1)
_BITS48 = np.uint64((1 << 48) - 1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i:i + width] for every i (short at the end: what there is)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def _pack48(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(raw, n: int) -> np.ndarray:
    low = np.frombuffer(raw, "<u4", n).astype(np.uint64)
    return low | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


class Bucket:
    """The windows of a bucket's texts: places, prefixes and path labels."""

    def __init__(self, column, window: int = WINDOW):
        self.window = window
        unpress = zstandard.ZstdDecompressor()
        self.texts = [unpress.decompress(raw.as_buffer()) for raw in column]
        self.n_words = np.zeros(len(self.texts), dtype=np.int64)
        chosen, prefix, start, one, two, base = [], [], [], [], [], 0
        for lo, hi, buf, offsets in text_slices(pa.array(self.texts, pa.large_binary())):
            w = Words(buf, offsets, SPACE_WORDS, lower=False)
            self.n_words[lo:hi] = np.diff(w.first)
            left = w.left_in_doc()
            at = np.flatnonzero(left >= window)
            if len(at):
                hashes = w.hashes()
                gram = np.full(len(w), _NONE)
                grams = np.flatnonzero(left >= PREFIX)
                gram[grams] = window_hashes(hashes, grams, PREFIX)
                span = window - PREFIX + 1
                least = _sliding(gram, span, np.minimum)
                # Places where a gram is the least of some window that holds it.
                top = np.zeros(len(w), dtype=np.uint64)
                top[at] = least[at]
                top = _sliding(top[::-1].copy(), span, np.maximum)[::-1]
                chosen.append(gram[(top == gram) & (gram != _NONE)] >> np.uint64(16))
                prefix.append(least[at] >> np.uint64(16))
                start.append(at + base)
                one.append(window_hashes(hashes, at, SPLIT))
                two.append(window_hashes(hashes, at + SPLIT, window - SPLIT))
            base += len(w)
        none = np.empty(0, np.uint64)
        self.chosen = np.concatenate([none, *chosen])
        self.prefix, self.one, self.two = (np.concatenate([none, *x]) for x in (prefix, one, two))
        self.start = np.concatenate([np.empty(0, np.int64), *start])

    def alive(self, repeated: np.ndarray, heavy: np.ndarray, groups: int):
        """Windows under repeated prefixes as distinct leaves in group order:
        window places, leaf of each, leaf labels, leaf marks and group bounds."""
        if len(repeated):
            at = np.searchsorted(repeated, self.prefix)
            at[at == len(repeated)] = 0
            known = np.flatnonzero(repeated[at] == self.prefix)
            at = at[known]
        else:
            known = at = np.empty(0, np.int64)
        one, two = self.one[known], self.two[known]
        key = np.where(heavy[at] if len(at) else np.empty(0, bool), one, self.prefix[known])
        group = (mix(key) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((two, one, group))
        new = np.ones(len(order), dtype=bool)
        g, a, b = group[order], one[order], two[order]
        new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        leaf = np.empty(len(order), dtype=np.int64)
        leaf[order] = np.cumsum(new) - 1
        places = np.flatnonzero(new)
        marks = np.diff(places, append=len(order)) > 1
        return self.start[known], leaf, a[places], b[places], marks, np.searchsorted(g[places], np.arange(groups + 1))

    def covered(self, repeated_at: np.ndarray) -> np.ndarray:
        """Whether each word of the bucket is in a repeated window."""
        edge = np.zeros(int(self.n_words.sum()) + 1, dtype=np.int64)
        np.add.at(edge, repeated_at, 1)
        np.add.at(edge, repeated_at + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def subtree(one: np.ndarray, two: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each leaf hangs under an internal node of full depth: sorted by
    path, a neighbour has both labels in common, or the leaf stands for several."""
    order = np.lexsort((two, one))
    depth = np.zeros(len(order) + 1, dtype=bool)       # common depth with the leaf before
    depth[1:-1] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    out = np.empty(len(order), dtype=bool)
    deep = depth[:-1] | depth[1:]
    # A node of equal leaves repeats if it has two leaves or one marked leaf.
    out[order] = deep | marks[order]
    return out


def _table(schema: str, *columns) -> pa.Table:
    """A group's result; what the group needed goes back to the system."""
    give_back()
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table({n: pa.array(c, types[t]) for (n, t), c in zip(fields, columns)})


_REPLY = "bucket long, kind int, part long, n long, data binary"


def _replies(table: pa.Table, kind: int) -> list[tuple[int, int, object]]:
    rows = zip(table.column("kind").to_pylist(), table.column("part").to_pylist(),
               table.column("n").to_pylist(), table.column("data"))
    return sorted(((p, n, d.as_buffer()) for k, p, n, d in rows if k == kind), key=lambda r: r[0])


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The repeated prefixes sent to a bucket, and which are heavy."""
    parts = [(_unpack48(d, n), np.frombuffer(d, np.uint8, n, 6 * n) > 0) for _, n, d in _replies(table, 1)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, bool)
    prefixes, heavy = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(prefixes)
    return prefixes[order], heavy[order]


def kept_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
               digest: bool = False, bucket_bytes: int = BUCKET_BYTES, heavy_places: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by a space) of
    every row; with ``digest`` kept_sha256 in place of kept."""
    if window < 2 * SPLIT - 1:
        raise ValueError(f"a window has at least {2 * SPLIT - 1} words")
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    buckets = max(8, size // bucket_bytes)
    prefix_tasks = max(8, size // 70 // PREFIXES_PER_TASK)   # a place in some 70 bytes
    groups = max(8, size // GROUP_BYTES)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([press.compress(t.as_buffer()) for t in texts], pa.binary()),
                 batch.column(2)], ["doc_id", "z", "bucket"])

    # The bucket is by row, not by key: equal ids or texts do not meet in one.
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    staged = stored(dealt.mapInArrow(pack, "doc_id long, z binary, bucket long"), "repeats-staged")

    def prefixes(table: pa.Table) -> pa.Table:
        bucket, b = table.column("bucket")[0].as_py(), Bucket(table.column("z"), window)
        values, counts = np.unique(b.chosen, return_counts=True)
        part = (values % np.uint64(prefix_tasks)).astype(np.int64)
        rows = []
        for p in range(prefix_tasks):
            own = part == p
            if own.any():
                rows.append((p, bucket, int(own.sum()),
                             _pack48(values[own]) + np.minimum(counts[own], 65535).astype("<u2").tobytes()))
        return _table("part long, bucket long, n long, data binary", *(zip(*rows) if rows else [()] * 4))

    def repeated_prefixes(table: pa.Table) -> pa.Table:
        part, buckets_in = table.column("part")[0].as_py(), table.column("bucket").to_pylist()
        sizes = table.column("n").to_pylist()
        raws = [d.as_buffer() for d in table.column("data")]
        values = np.concatenate([_unpack48(r, n) for r, n in zip(raws, sizes)])
        counts = np.concatenate([np.frombuffer(r, "<u2", n, 6 * n).astype(np.int64) for r, n in zip(raws, sizes)])
        _, place = np.unique(values, return_inverse=True)
        total = np.bincount(place, counts)[place]
        rows, lo = [], 0
        for bucket, n in zip(buckets_in, sizes):
            v, c = values[lo:lo + n], total[lo:lo + n]
            again = c > 1
            if again.any():
                rows.append((bucket, 1, part, int(again.sum()),
                             _pack48(v[again]) + (c[again] > heavy_places).astype(np.uint8).tobytes()))
            lo += n
        return _table(_REPLY, *(zip(*rows) if rows else [()] * 5))

    def leaves(table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and replies.num_rows:
            bucket = table.column("bucket")[0].as_py()
            _, _, one, two, marks, cuts = Bucket(table.column("z"), window).alive(*_known(replies), groups)
            for p in range(groups):
                a, b = cuts[p], cuts[p + 1]
                if b > a:
                    rows.append((p, bucket, int(b - a), one[a:b].tobytes() + two[a:b].tobytes()
                                 + np.packbits(marks[a:b]).tobytes()))
        return _table("part long, bucket long, n long, data binary", *(zip(*rows) if rows else [()] * 4))

    def subtrees(table: pa.Table) -> pa.Table:
        part, buckets_in = table.column("part")[0].as_py(), table.column("bucket").to_pylist()
        sizes = table.column("n").to_pylist()
        raws = [d.as_buffer() for d in table.column("data")]
        one = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(raws, sizes)])
        two = np.concatenate([np.frombuffer(r, np.uint64, n, 8 * n) for r, n in zip(raws, sizes)])
        marks = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8, -1, 16 * n), count=n) > 0
                                for r, n in zip(raws, sizes)])
        deep, rows, lo = subtree(one, two, marks), [], 0
        for bucket, n in zip(buckets_in, sizes):
            rows.append((bucket, 2, part, n, np.packbits(deep[lo:lo + n]).tobytes()))
            lo += n
        return _table(_REPLY, *zip(*rows))

    last = "kept_sha256 string" if digest else "kept string"

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(
                ("doc_id", "n_words", "n_removed", last.split(" ")[0]),
                (pa.int64(), pa.int64(), pa.int64(), pa.string()))})
        b = Bucket(table.column("z"), window)
        gone = np.zeros(int(b.n_words.sum()), dtype=bool)
        if replies.num_rows:
            start, leaf, _, _, _, cuts = b.alive(*_known(replies), groups)
            deep = np.zeros(int(cuts[-1]), dtype=bool)
            for p, n, raw in _replies(replies, 2):
                deep[cuts[p]:cuts[p + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n) > 0
            gone = b.covered(start[deep[leaf]])
        give_back()
        first = np.concatenate([[0], np.cumsum(b.n_words)])
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        out = []
        for d, raw in enumerate(b.texts):
            ws = raw.split()        # the same words: bytes.split() parts at x20 and x09-x0D
            if removed[d]:
                ws = compress(ws, (~gone[first[d]:first[d + 1]]).tolist())
            kept = b" ".join(ws)
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(b.n_words),
                         "n_removed": pa.array(removed.astype(np.int64)), last.split(" ")[0]: pa.array(out, pa.string())})

    by_bucket = staged.groupBy("bucket")
    first = (by_bucket.applyInArrow(prefixes, "part long, bucket long, n long, data binary")
             .groupBy("part").applyInArrow(repeated_prefixes, _REPLY))
    first = stored(first, "repeats-prefixes")
    second = (by_bucket.cogroup(first.groupBy("bucket"))
              .applyInArrow(leaves, "part long, bucket long, n long, data binary")
              .groupBy("part").applyInArrow(subtrees, _REPLY))
    return by_bucket.cogroup(first.union(second).groupBy("bucket")).applyInArrow(
        cut, f"doc_id long, n_words long, n_removed long, {last}")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return kept_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
