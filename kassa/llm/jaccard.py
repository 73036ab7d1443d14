"""N-gram Jaccard join: rare-first prefix filtering (PPJoin+, Xiao et al. 2008).

A document is its set of word shingles. Its tokens are ordered rare first; two
sets that reach the threshold share a token in short prefixes of that order, so
only documents that meet on a prefix token are compared, after length and
positional filters; a suffix filter comes before the exact overlap, which is
taken once per pair.

The result wanted is the components of the link graph, so pairs that can tell
nothing new are never made:

1. *Classes.* Equal sets become one representative (a map-side aggregate).
2. *Stars.* Representatives that share one of their least shingle hashes are
   compared with one centre per hash: linear in the documents, and it folds a
   large group of near copies into one component.
3. *Join.* The full prefix join over all representatives, between different
   components only. It is exact: every link of the corpus is inside a component
   of the first two steps or is found here.

Scale: texts cross the network compressed, and only those that take part in a
comparison reach a verifying task, once per task. Prefix tokens travel packed
(48-bit token, document, place) instead of as rows. "Rare" is a count of hashed
shingles over all documents in a table of fixed size (any order gives right
results; rarity saves work). Links leave a task as a spanning forest.

Edge cases: a null or empty text has the empty set and is alone; a text with
fewer words than a shingle is one shingle; rows with equal ids are one node;
a row without an id has no component; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.components import connected_components, stored
from kassa.llm.words import (SPACE_WORDS, Words, give_back, mix, ragged, text_slices, tidy,
                             window_hashes)

SHINGLE = 5
THRESHOLD = (3, 4)              # similarity >= 3 / 4
LEAST_HASHES = 8                # star tokens of a document
COUNTERS = 1 << 20              # counters of the rarity table (4 MB broadcast)
_PIECES = 64
TOKENS_PER_TASK = 600_000       # prefix tokens joined by one task
SHINGLES_PER_TASK = 1_000_000   # shingles of the home documents of a verifying task


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    for lo, hi, buf, offsets in text_slices(texts):
        w = Words(buf, offsets, SPACE_WORDS, lower=True)
        hashes = w.hashes()
        first = w.first
        at = np.flatnonzero(w.left_in_doc() >= size)
        made = window_hashes(hashes, at, size)
        cuts = np.searchsorted(at, first)
        for d in range(hi - lo):
            a, b = cuts[d], cuts[d + 1]
            if b > a:
                yield _distinct(made[a:b])
            elif first[d + 1] > first[d]:
                yield window_hashes(hashes, first[d:d + 1], first[d + 1] - first[d])
            else:
                yield made[:0]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.empty(len(x), dtype=bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def _prefix(n, t):
    """Tokens of a probing set of n: n - ceil(t n) + 1."""
    return n - -(-t[0] * n // t[1]) + 1


def _index_prefix(n, t):
    """Tokens of an indexed (smaller) set: n - ceil(2 t n / (1 + t)) + 1."""
    return n - -(-2 * t[0] * n // (t[0] + t[1])) + 1


def _needed(n, m, t):
    """The least overlap of two sets that reach the threshold."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


# --- signatures ---------------------------------------------------------------

_SIGNATURE = "doc_id long, n long, k1 long, k2 long, least array<long>, piece int, counts binary"


def _signatures(docs: DataFrame) -> DataFrame:
    """A row per document (size, set key, least hashes) and, per task, the
    pieces of its rarity counts."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            n, k1, k2, least = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1) if len(s) < 64 else \
                    _count(counts, s)
                m = mix(s)
                n.append(len(s))
                k1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce(mix(m ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)))
                least.append(s[:LEAST_HASHES].view(np.int64))
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(least, pa.list_(pa.int64())), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                ["doc_id", "n", "k1", "k2", "least", "piece", "counts"])
        if counts.any():
            blobs = [p.tobytes() for p in np.split(counts, _PIECES)]
            none = pa.nulls(_PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(_PIECES, pa.list_(pa.int64())),
                 pa.array(range(_PIECES), pa.int32()), pa.array(blobs, pa.binary())],
                ["doc_id", "n", "k1", "k2", "least", "piece", "counts"])
    return docs.mapInArrow(run, _SIGNATURE)


def _count(counts: np.ndarray, s: np.ndarray) -> None:
    at = (s >> np.uint64(44)).astype(np.int64)     # sorted, since s is
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    counts[at[cut]] += np.diff(cut, append=len(at)).astype(np.uint32)


def _rarity(signatures: DataFrame) -> np.ndarray:
    """Shingle counts by their leading 20 bits, summed over all tasks. Pieces
    stream through their task; the driver gets the one table of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64)
                sums[piece] = own if piece not in sums else np.minimum(sums[piece] + own, np.uint64(2**32 - 1))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([s.astype(np.uint32).tobytes() for s in sums.values()], pa.binary())], ["piece", "counts"])
    rows = (signatures.where("piece IS NOT NULL").select("piece", "counts").repartition(_PIECES, "piece")
            .mapInArrow(run, "piece int, counts binary").collect())
    table = np.zeros((_PIECES, COUNTERS // _PIECES), dtype=np.uint32)
    for r in rows:
        table[r.piece] = np.frombuffer(r.counts, np.uint32)
    return table.ravel()


# --- verification ---------------------------------------------------------------

def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and compressed text: what crosses the network."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            blobs = [press.compress(t.as_buffer()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "z"])
    return docs.mapInArrow(run, "doc_id long, z binary")


def _texts(column) -> Iterator[pa.Array]:
    """Compressed texts back, some megabytes at a time."""
    unpress = zstandard.ZstdDecompressor()
    held, size = [], 0
    for raw in column:
        held.append(unpress.decompress(raw.as_buffer()))
        size += len(held[-1])
        if size > 1 << 20:
            yield pa.array(held, pa.large_binary())
            held, size = [], 0
    yield pa.array(held, pa.large_binary())


def _sets(column) -> Iterator[np.ndarray]:
    for part in _texts(column):
        yield from shingle_sets(part)


def _pair_blobs(pairs: np.ndarray, homes: int) -> Iterator[tuple[int, bytes]]:
    """Pairs [k, 4] (a, b, component of a, of b) by the home task of a."""
    home = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(homes + 1))
    for h in range(homes):
        if cuts[h + 1] > cuts[h]:
            yield h, pairs[order[cuts[h]:cuts[h + 1]]].tobytes()


class _Forest:
    """Union-find over arbitrary ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _verified(pairs: np.ndarray, ids: list[int], sets: list[np.ndarray], t) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the pairs that reach the threshold."""
    place: dict[int, list[int]] = {}
    for i, d in enumerate(ids):
        place.setdefault(d, []).append(i)
    # Suffix filter: how many tokens of each range of the hash order a set has;
    # the overlap cannot pass the sum of the lesser counts.
    edges = np.arange(65, dtype=np.uint64) << np.uint64(58)
    parts = np.zeros((len(sets), 64), dtype=np.int32)
    for i, s in enumerate(sets):
        parts[i] = np.diff(np.append(np.searchsorted(s, edges[:64]), len(s)))
    forest, links = _Forest(), []
    for a, b, ca, cb in np.unique(pairs, axis=0).tolist():
        if forest.find(ca) == forest.find(cb):
            continue
        for i in place.get(a, ()):
            for j in place.get(b, ()):
                x, y = sets[i], sets[j]
                need = _needed(len(x), len(y), t)
                if min(len(x), len(y)) < need or not need or np.minimum(parts[i], parts[j]).sum() < need:
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                if int((y[at] == x).sum()) >= need and forest.join(ca, cb):
                    links.append((ca, cb))
    return links


def _verify(pairs: DataFrame, packed: DataFrame, homes: int, t) -> DataFrame:
    """Edges (a, b) between components, from pair blobs (home, pairs)."""
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 4)[:, :2])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), home, np.int64))],
                                                 ["doc", "home"])

    def check(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if blobs.num_rows and texts.num_rows:
            own = np.concatenate([np.frombuffer(raw.as_buffer(), np.int64) for raw in blobs.column("pairs")])
            links = _verified(own.reshape(-1, 4), texts.column("doc_id").to_pylist(),
                              list(_sets(texts.column("z"))), t)
        a, b = zip(*links) if links else ((), ())
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = pairs.repartition("home")          # one exchange for both uses
    asked = pairs.mapInArrow(wanted, "doc long, home long").distinct()
    sent = packed.join(asked, F.col("doc_id") == F.col("doc")).select("home", "doc_id", "z")
    return sent.groupBy("home").cogroup(pairs.groupBy("home")).applyInArrow(check, "a long, b long")


# --- stars and prefix join --------------------------------------------------------

def _stars(classes: DataFrame, homes: int, t) -> DataFrame:
    """Pair blobs between each document and the centre of each of its least
    hashes: the one whose hashes are the most shared, an unedited copy."""
    tokens = classes.select("rep", "n", "copies", F.explode("least").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    met = tokens.join(shared, "token")
    score = met.groupBy("rep").agg(F.sum("docs").alias("score"))
    scored = met.join(score, "rep")
    centre = scored.groupBy("token").agg(
        F.max(F.struct("score", "copies", (-F.col("rep")).alias("r"), "n")).alias("c"))
    centre = centre.select("token", (-F.col("c.r")).alias("centre"), F.col("c.n").alias("m"))
    pairs = (met.join(centre, "token").where("rep <> centre")
             .where(F.least("n", "m") * t[1] >= F.greatest("n", "m") * t[0])
             .select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy() for c in batch.columns)
            if len(a):
                yield _blob_batch(_pair_blobs(np.stack([a, b, a, b], axis=1), homes))
    return pairs.mapInArrow(pack, "home long, pairs binary")


def _blob_batch(blobs) -> pa.RecordBatch:
    keys, values = zip(*blobs)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())],
                                      ["home", "pairs"])


_TOKEN = np.dtype([("high", "<u4"), ("low", "<u2"), ("doc", "<u4"), ("at", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("component", "<i8"), ("n", "<i8")])


def _prefix_tokens(labelled: DataFrame, rarity, tasks: int, t) -> DataFrame:
    """Packed prefix tokens of every representative, by token range."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, docs, places, sizes = [], [], [], []
            for i, s in enumerate(_sets(batch.column("z"))):
                n = len(s)
                sizes.append(n)
                if n:
                    k = _prefix(n, t)
                    rare = counts[(s >> np.uint64(44)).astype(np.int64)]
                    order = np.argsort(rare, kind="stable")[:k]   # ties keep the hash order
                    tokens.append(s[order])
                    docs.append(np.full(k, i, np.uint32))
                    places.append(np.arange(k, dtype=np.uint32))
            if not tokens:
                continue
            table = np.empty(batch.num_rows, _DOC)
            table["id"], table["component"] = batch.column("doc_id").to_numpy(), batch.column("component").to_numpy()
            table["n"] = sizes
            h = np.concatenate(tokens)
            doc, at = np.concatenate(docs), np.concatenate(places)
            task = ((h & np.uint64(0xFFFF)) % np.uint64(tasks)).astype(np.int64)
            order = np.lexsort((h, task))
            cuts = np.searchsorted(task[order], np.arange(tasks + 1))
            for p in range(tasks):
                own = order[cuts[p]:cuts[p + 1]]
                if len(own):
                    used, local = np.unique(doc[own], return_inverse=True)
                    rows = np.empty(len(own), _TOKEN)
                    rows["high"] = h[own] >> np.uint64(32)
                    rows["low"] = (h[own] >> np.uint64(16)) & np.uint64(0xFFFF)
                    rows["doc"], rows["at"] = local, at[own]
                    columns = b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _TOKEN.names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int64()), pa.array([len(own)], pa.int64()),
                         pa.array([columns], pa.binary()), pa.array([table[used].tobytes()], pa.binary())],
                        ["task", "rows", "tokens", "docs"])
    return labelled.mapInArrow(run, "task long, rows long, tokens binary, docs binary")


def _join_tokens(tokens: pa.Table, t, chunk: int = 400_000) -> Iterator[np.ndarray]:
    """Pairs [k, 4] of different components that share a prefix token and pass
    the length and positional filters."""
    parts, docs, base = [], [], 0
    for n, raw, table in zip(tokens.column("rows").to_pylist(), tokens.column("tokens"), tokens.column("docs")):
        raw, at, rows = raw.as_buffer(), 0, np.empty(n, _TOKEN)
        for f in _TOKEN.names:
            rows[f] = np.frombuffer(raw, _TOKEN[f], n, at)
            at += n * _TOKEN[f].itemsize
        own = np.frombuffer(table.as_buffer(), _DOC)
        parts.append((rows["high"].astype(np.uint64) << np.uint64(16) | rows["low"],
                      rows["doc"].astype(np.int64) + base, rows["at"].astype(np.int64)))
        docs.append(own)
        base += len(own)
    token, doc, at = (np.concatenate(c) for c in zip(*parts))
    docs = np.concatenate(docs)
    # Smaller sets first inside a token: a set is indexed for those after it.
    order = np.lexsort((docs["id"][doc], docs["n"][doc], token))
    token, doc, at = token[order], doc[order], at[order]
    n, component = docs["n"][doc], docs["component"][doc]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    end = np.append(start[1:], len(token))
    mixed = np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start)
    if not mixed.any():
        return
    stop = np.repeat(end, end - start)
    entries = np.flatnonzero(np.repeat(mixed, end - start) & (at < _index_prefix(n, t)))
    # Partners: the later entries of the token up to the largest size allowed.
    key_step = int(n.max()) + 1
    group = np.repeat(np.arange(len(start)), end - start)
    rank = group * key_step + n
    most = np.minimum(np.searchsorted(rank, group[entries] * key_step + np.minimum(n[entries] * t[1] // t[0], key_step - 1),
                                      side="right"), stop[entries])
    counts = np.maximum(most - entries - 1, 0)
    total = np.cumsum(counts)
    lo = 0
    while lo < len(entries):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + chunk, side="right")))
        e = np.repeat(entries[lo:hi], counts[lo:hi])
        f = ragged(entries[lo:hi] + 1, counts[lo:hi])
        ok = component[e] != component[f]
        e, f = e[ok], f[ok]
        need = _needed(n[e], n[f], t)
        ok = 1 + np.minimum(n[e] - at[e] - 1, n[f] - at[f] - 1) >= need
        e, f = e[ok], f[ok]
        if len(e):
            ids = np.stack([docs["id"][doc[f]], docs["id"][doc[e]], component[f], component[e]], axis=1)
            yield np.unique(ids, axis=0)
        lo = hi


def _prefix_pairs(tokens: DataFrame, homes: int, t) -> DataFrame:
    """Pair blobs of the whole prefix join."""
    def run(table: pa.Table) -> pa.Table:
        blobs = [b for pairs in _join_tokens(table, t) for b in _pair_blobs(pairs, homes)]
        keys, values = zip(*blobs) if blobs else ((), ())
        give_back()
        return pa.table({"home": pa.array(keys, pa.int64()), "pairs": pa.array(values, pa.binary())})
    return tokens.groupBy("task").applyInArrow(run, "home long, pairs binary")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    t = threshold
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    signatures = stored(_signatures(named), "jaccard-signatures")
    rows = signatures.where("piece IS NULL").select("doc_id", "n", "k1", "k2", "least")
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("least").alias("least")),
        "jaccard-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    homes = max(8, total // SHINGLES_PER_TASK)
    tasks = max(8, total * (t[1] - t[0]) // t[1] // TOKENS_PER_TASK)
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(signatures))
    reps = classes.select(F.col("rep").alias("node")).distinct()
    packed = _packed(named.where("doc_id IS NOT NULL AND t IS NOT NULL"))

    first = connected_components(_verify(_stars(classes, homes, t), packed, homes, t))
    label = reps.join(first, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
    label = stored(label, "jaccard-labels")
    labelled = packed.join(label, F.col("doc_id") == F.col("node")).select("doc_id", "component", "z")
    # One query from here: the exchange of the packed texts serves both joins.
    pairs = _prefix_pairs(_prefix_tokens(labelled, rarity, tasks, t), homes, t)
    second = connected_components(_verify(pairs, packed, homes, t))
    final = label.join(second.select(F.col("node").alias("component"), F.col("component").alias("whole")),
                       "component", "left").select("node", F.coalesce("whole", "component").alias("whole"))

    # Classes that share an id (one id, several texts) are one node as well.
    member = rows.join(classes.select("k1", "k2", "n", F.col("rep").alias("node")), ["k1", "k2", "n"], "left")
    member = member.join(final, "node", "left")
    several = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    ties = (member.join(several, "doc_id", "left_semi").where("whole IS NOT NULL")
            .select(F.col("doc_id").alias("a"), F.col("whole").alias("b")))
    if not ties.isEmpty():
        merged = connected_components(ties).select(F.col("node").alias("whole"), F.col("component").alias("tied"))
        member = member.join(merged, "whole", "left").withColumn("whole", F.coalesce("tied", "whole"))
    return member.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("whole", "doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` without the near duplicates: of every component the document
    with the least id stays (rows without an id all stay)."""
    found = components(docs, doc_id, text, threshold)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")
    repeated = docs.groupBy(doc_id).count().where(f"count > 1 AND `{doc_id}` IS NOT NULL")
    if repeated.isEmpty():
        return kept
    # Rows that share an id: one of them stays.
    ids = repeated.select(F.col(doc_id).alias("_twice"))
    single = kept.join(ids, F.col(doc_id) == F.col("_twice"), "left_anti")
    return single.unionByName(kept.join(ids, F.col(doc_id) == F.col("_twice"), "left_semi").dropDuplicates([doc_id]))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
