"""Conversation prefix trie by union-find over sorted-neighbour LCP edges.

Each distinct sequence of the first turns of some conversation is a node.
Conversations with the same turns are one class; the classes' keys (128 bits of
SHA-256 a turn) are range sorted, so every node is an interval, and neighbours
are joined by an edge at their longest common prefix (LCP). A task takes its
range's edges in descending depth through a union-find forest: a merge of two
components creates the branching node at that depth, or joins one that is
there. Members, least member, children, leaves and saved weight fold upwards.

Partition forests. A node is final once its interval touches neither end of
the range. What touches an end is contracted: for each open node one item with
the sums of its finished children, in an order and with edges that give the
same tree again. So a forest is as long as its two outer paths are deep,
whatever the range holds. Forests of neighbouring ranges are joined by the edge
between their outer keys, ``FAN`` at a time, by the same union-find, until one
is left. Finished children of a node that is still open name it by an id; the
joins write what became of each id.

Long conversations. A key covers one segment of ``SEGMENT`` turns. Classes that
share whole segments with another class form a group that is one element of the
level above; their rest is sorted a level below. Levels are as many as segments
that different conversations share, and no row holds more than one segment.

Scale: texts are read once and never shuffled, only (conversation, turn,
digest, bytes). Turn numbers come from range-sorted partitions and an offset
for conversations that cross them, so one conversation may hold any share of
the rows. A copied conversation is one class after a map-side count; the hash
over its members is a stream of 16 KB pieces from sorted ranges, which only
classes that cross ranges need. Chains of single-child nodes are rows
(top, bottom) until the end, where they are cut into runs and spread.
Every stage is written to the shared folder.

Edge cases: rows of a null conversation id belong to no conversation; null
turns come first; equal turns come in order of their digest, equal rows are
kept; null roles and texts are empty; a conversation without turns is a member
of the root; an empty table has no node. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kassa.llm.components import stored
from kassa.llm.words import tidy

SEGMENT = 1024                            # turns of one key
FAN = 64                                  # forests joined by one task
TURNS_PER_TASK = 2_000_000
KEYS_PER_TASK = 200_000
_WIDTH = 16                               # key bytes of a turn
_PIECE = 1 << 14
_RUN = 1 << 16

#: What a node or element gathers: members, least member, children's leaves and
#: saved weight, children, and the class that ends there.
_SUMS = "m long, mn long, leaves long, saved long, kids long, ends long"
_ROW = (f"kind string, gid binary, forest long, at int, id long, depth long, weight long, {_SUMS}, lcp long, "
        "lcp_weight long, top long, parent long, parent_id long, key binary, weights array<long>, before long")
_NONE = dict.fromkeys(c.split()[0] for c in _ROW.replace("array<long>", "x").split(", "))


def _tasks(spark: SparkSession, rows: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // each + 1)


# ---------------------------------------------------------------- turns

def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, bytes`` of every row; texts end here."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(named, 256)), 1, _WIDTH).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, 1 for the first turn of each conversation. Ranges
    are sorted and counted by task; a conversation that crosses ranges gets the
    rows of the ranges before added."""
    spark = turns.sparkSession
    turns = stored(turns, "trie-digests")
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "_spread"]
    ranged = (turns.withColumn("_spread", F.monotonically_increasing_id())
              .repartitionByRange(_tasks(spark, turns.count(), TURNS_PER_TASK), *order)
              .sortWithinPartitions(*order).drop("_spread"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            place = np.arange(len(ids)) - np.repeat(new, np.diff(np.r_[new, len(ids)]))
            if ids[0] == last:
                place[:new[1] if len(new) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place + 1), pa.array(np.full(len(ids), part))],
                names=[*batch.schema.names, "_local", "_part"])

    local = stored(ranged.mapInArrow(run, f"{_ddl(turns)}, _local long, _part long"), "trie-local")
    counts = local.groupBy("conv_id", "_part").agg(F.max("_local").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (counts.withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL")
                .select("conv_id", "_part", "_before"))
    return (local.join(crossing, ["conv_id", "_part"], "left")
            .select(*turns.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias("pos")))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def with_borrowed_heads(turns: DataFrame, heads: Column, lender: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt: the first ``heads`` turns (at most ``most``)
    of the conversation ``lender``, both expressions over conv_id, then its own
    turns after as many. Returns the turns (conv_id, pos, digest, bytes) and
    all conversations (conv_id, n)."""
    turns = stored(turns, "trie-turns")
    first = F.when(F.col("pos") <= most, F.struct("pos", "digest", "bytes"))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own"), F.sort_array(F.collect_list(first)).alias("head"))
    own = stored(own, "trie-heads")
    lent = own.select(F.col("conv_id").alias("_from"), F.col("head").alias("_head"))
    convs = (own.select("conv_id", "own", heads.cast("int").alias("h"), lender.alias("_from"))
             .join(lent, "_from", "left")
             .withColumn("_head", F.slice("_head", F.lit(1), F.col("h")))
             .withColumn("lent", F.when(F.col("_head").isNull(), 0).otherwise(F.size("_head"))))
    convs = stored(convs, "trie-convs")
    borrowed = convs.select("conv_id", F.inline("_head"))
    kept = (turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("pos > h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "digest", "bytes"))
    sizes = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return borrowed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "bytes").union(kept), sizes


# ---------------------------------------------------------------- the forest of a range

def _forest(items: list[dict], base: int, whole: bool) -> tuple[list[dict], list[dict]]:
    """The finished rows and the contracted items of a list of elements in
    order; ``lcp`` of an element is its edge to the one before (None: another
    group). ``whole``: the list's ends are ends of their groups."""
    nodes = [{k: x[k] for k in ("depth", "weight", "m", "mn", "leaves", "saved", "kids", "ends", "gid",
                               "before")} for x in items]
    parent: list[int] = [-1] * len(items)
    alias: dict[int, int] = {}
    up, top = list(range(len(items))), list(range(len(items)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def least(a, b):
        return b if a is None else a if b is None else min(a, b)

    def add(to: dict, x: dict) -> None:
        for k in ("m", "leaves", "saved", "kids"):
            to[k] += x[k]
        to["mn"] = least(to["mn"], x["mn"])
        to["ends"] = least(to["ends"], x["ends"])      # one class at most ends at a node

    def branch(depth: int, weight: int, like: dict) -> int:
        nodes.append({"depth": depth, "weight": weight, "m": 0, "mn": None, "leaves": 0, "saved": 0, "kids": 0,
                      "ends": None, "gid": like["gid"], "before": like["before"]})
        parent.append(-1)
        return len(nodes) - 1

    edges = sorted((i for i, x in enumerate(items) if i and x["lcp"] is not None), key=lambda i: (-items[i]["lcp"], i))
    for i in edges:
        a, b = find(i - 1), find(i)
        left, right, depth = top[a], top[b], items[i]["lcp"]
        if nodes[left]["depth"] == depth:
            v = left
            if nodes[right]["depth"] == depth:          # two parts of one node
                alias[right] = v
                add(nodes[v], nodes[right])
            else:
                parent[right] = v
        elif nodes[right]["depth"] == depth:
            v = right
            parent[left] = v
        else:
            v = branch(depth, items[i]["lcp_weight"], items[i])
            parent[left] = parent[right] = v
        up[b] = a
        top[a] = v

    def node(i: int) -> int:
        while i in alias:
            i = alias[i]
        return i

    def path(i: int) -> list[int]:
        out = [node(i)]
        while parent[out[-1]] >= 0:
            out.append(node(parent[out[-1]]))
        return out

    left, right = ([], []) if whole else (path(0), path(len(items) - 1))
    open_ = set(left) | set(right)
    for r in sorted({find(i) for i in range(len(items))}):   # groups that are complete end in their base
        t = top[r]
        if node(t) not in open_ and nodes[t]["depth"] > base:
            parent[t] = branch(base, nodes[t]["before"], nodes[t])
    done = sorted((i for i in range(len(nodes)) if i not in alias and i not in open_), key=lambda i: -nodes[i]["depth"])
    for i in done:
        x, p = nodes[i], parent[i]
        x["below"], x["leaves"] = x["saved"], x["leaves"] if x["kids"] else 1
        if p >= 0:
            to = nodes[node(p)]
            to["m"] += x["m"]
            to["mn"] = least(to["mn"], x["mn"])
            to["leaves"] += x["leaves"]
            to["saved"] += x["saved"] + (x["m"] - 1) * (x["weight"] - to["weight"])
            to["kids"] += 1
    # The outer paths as a list: deepest left node up to the common one, then down to the deepest right.
    common = set(left) & set(right)
    chain = left[:next((k for k, i in enumerate(left) if i in common), len(left) - 1) + 1] if left else []
    down = [i for i in reversed(right) if i not in common]
    items_out, ids = [], {}
    for k, i in enumerate(chain + down):
        joint = None
        if k and not (k == len(chain) and not common):
            joint = nodes[i] if k < len(chain) else nodes[(chain + down)[k - 1]]
        items_out.append({**nodes[i], "lcp": joint and joint["depth"], "lcp_weight": joint and joint["weight"],
                          "key": None, "weights": None})
        ids[i] = k
    rows = []
    for i in done:
        x, p = nodes[i], node(parent[i]) if parent[i] >= 0 else None
        is_open = p in ids
        rows.append({"kind": "node" if p is not None or not base else "root", "gid": x["gid"], "depth": x["depth"],
                     "weight": x["weight"], "m": x["m"], "mn": x["mn"], "leaves": x["leaves"], "saved": x["below"],
                     "kids": x["kids"], "ends": x["ends"], "top": x["depth"] if p is None else nodes[p]["depth"] + 1,
                     "parent": None if p is None or is_open else nodes[p]["mn"],
                     "parent_id": ids[p] if is_open else None})
    for i, x in enumerate(items):                       # what became of the items that have an id
        if x.get("id") is not None:
            v = node(i)
            rows.append({"kind": "alias", "id": x["id"], "parent": None if v in ids else nodes[v]["mn"],
                         "parent_id": ids.get(v)})
    return rows, items_out


def _outcome(rows: list[dict], kept: list[dict], forest: int, stage: int) -> pa.RecordBatch:
    """Rows of the result table; ids of open items carry their stage and forest."""
    name = lambda k: None if k is None else (stage << 56) | (forest << 28) | k
    for r in rows:
        r["parent_id"] = name(r["parent_id"])
    for k, x in enumerate(kept):
        x |= {"kind": "open", "forest": forest, "at": k, "id": name(k)}
    return pa.RecordBatch.from_pylist([{**_NONE, **r} for r in rows + kept], schema=_ARROW)


_ARROW = pa.schema([(c, {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(),
                         "array<long>": pa.list_(pa.int64())}[t])
                    for c, t in (f.split() for f in _ROW.split(", "))])


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    if a[:_WIDTH] != b[:_WIDTH]:
        return 0
    n = min(len(a), len(b)) // _WIDTH
    x, y = (np.frombuffer(k, dtype=np.uint64, count=2 * n).reshape(n, 2) for k in (a, b))
    other = (x != y).any(axis=1)
    return int(other.argmax()) if other.any() else n


def _edge(before: dict, x: dict, base: int) -> None:
    """The LCP edge between two neighbours that still have their keys."""
    x["lcp"] = x["lcp_weight"] = None
    if before["gid"] == x["gid"]:
        shared = _common(before["key"], x["key"])
        x["lcp"], x["lcp_weight"] = base + shared, x["before"] + sum(x["weights"][:shared])


def _keyed(kept: list[dict], first: dict, last: dict) -> list[dict]:
    """The outer items with the outer elements' keys, for the edges to come."""
    for x, y in ((kept[0], first), (kept[-1], last)) if kept else ():
        x |= {"key": y["key"], "weights": y["weights"]}
    return kept


def _ranges(elements: DataFrame, level: int, tasks: int) -> DataFrame:
    """The forest of every range of the sorted elements."""
    base = level * SEGMENT

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                x["lcp"] = x["lcp_weight"] = None
                if items:
                    _edge(items[-1], x, base)
                    if len(items) > 1:                  # inner keys are not needed any more
                        items[-1]["key"] = items[-1]["weights"] = None
                items.append(x)
        if items:
            rows, kept = _forest(items, base, whole=False)
            yield _outcome(rows, _keyed(kept, items[0], items[-1]), TaskContext.get().partitionId(), 1)

    return elements.repartitionByRange(tasks, "gid", "key").sortWithinPartitions("gid", "key").mapInArrow(run, _ROW)


def _joined(open_: DataFrame, level: int, stage: int, whole: bool, fan: int) -> DataFrame:
    """Neighbouring forests made one, ``fan`` at a time; ``whole``: all of them."""
    base = level * SEGMENT

    def run(table: pa.Table) -> pa.Table:
        items = sorted(table.to_pylist(), key=lambda x: (x["forest"], x["at"]))
        to = items[0]["forest"] // fan
        for a, b in zip(items, items[1:]):
            if a["forest"] != b["forest"]:
                _edge(a, b, base)
        first, last = dict(items[0]), dict(items[-1])
        rows, kept = _forest(items, base, whole)
        return pa.Table.from_batches([_outcome(rows, _keyed(kept, first, last), to, stage)])

    return open_.groupBy(F.floor(F.col("forest") / fan).alias("_to")).applyInArrow(run, _ROW)


def _level(elements: DataFrame, level: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """All finished nodes of a level (their parents resolved), and the roots of
    its groups."""
    spark = elements.sparkSession
    tasks = _tasks(spark, elements.count(), KEYS_PER_TASK)
    stages = [stored(_ranges(elements, level, tasks), "trie-ranges")]
    forests = stages[0].agg(F.max("forest")).first()[0] + 1
    while True:
        forests = -(-forests // fan)
        stages.append(stored(_joined(stages[-1].where("kind = 'open'"), level, len(stages) + 1, forests == 1, fan),
                             "trie-joined"))
        if forests == 1:
            break
    known = None                                        # id -> least member, from the last join back to the first
    for s in reversed(stages[1:]):
        now = s.where("kind = 'alias'").select("id", "parent", "parent_id")
        if known is not None:
            later = known.select(F.col("id").alias("parent_id"), F.col("parent").alias("_later"))
            now = now.join(later, "parent_id", "left").select("id", F.coalesce("parent", "_later").alias("parent"))
            known = known.select("id", "parent").union(now)
        else:
            known = now.select("id", "parent")
    known = known.select(F.col("id").alias("parent_id"), F.col("parent").alias("_known"))
    rows = stages[0]
    for s in stages[1:]:
        rows = rows.union(s)
    nodes = (rows.where("kind = 'node'").join(known, "parent_id", "left")
             .withColumn("parent", F.coalesce("parent", "_known")))
    columns = ["depth", "top", "weight", "m", "mn", "leaves", "saved", "kids", "ends", "parent"]
    roots = rows.where("kind = 'root'").select("gid", "depth", "weight", "m", "mn", "leaves", "saved", "kids", "ends")
    return nodes.select(*columns), roots


# ---------------------------------------------------------------- classes, levels, nodes

def _members_hash(members: DataFrame) -> DataFrame:
    """``rep, sha``: SHA-256 of the sorted decimal ids of each class. A class
    inside one range is hashed there; the others leave pieces, which a stream in
    order hashes without holding a class."""
    spark = members.sparkSession
    tasks = _tasks(spark, members.count(), TURNS_PER_TASK)
    order = ["rep", "conv_id"]

    def ranges(batches):
        part, rep, digest, text, at, first = TaskContext.get().partitionId(), None, None, [], 0, True
        size = 0
        out: list[dict] = []

        def piece():
            out.append({"rep": rep, "part": part, "at": at, "text": ",".join(text), "sha": None})

        for batch in batches:
            for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist()):
                if r != rep:
                    if rep is not None:
                        if first:
                            piece()
                        else:
                            out.append({"rep": rep, "part": part, "at": 0, "text": None, "sha": digest(text)})
                        first = False
                    rep, text, at, size = r, [], 0, 0
                    digest = _Ids()
                text.append(str(c))
                size += len(text[-1]) + 1
                if size >= _PIECE:
                    if first:
                        piece()
                        at += 1
                    else:
                        digest.feed(text)
                        out += [{"rep": rep, "part": part, "at": at, "text": ",".join(text), "sha": None}]
                        at += 1
                    text, size = [], 0
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=_PIECES)
                    out = []
        if rep is not None:
            piece()
        yield pa.RecordBatch.from_pylist(out, schema=_PIECES)

    def stream(batches):
        rep, digest, out = None, None, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["rep"] != rep:
                    if rep is not None:
                        out.append({"rep": rep, "sha": digest.hexdigest()})
                    rep, digest = x["rep"], hashlib.sha256()
                    digest.update(x["text"].encode())
                elif x["text"]:
                    digest.update(b"," + x["text"].encode())
        if rep is not None:
            out.append({"rep": rep, "sha": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("rep", pa.int64()), ("sha", pa.string())]))

    found = stored(members.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                   .mapInArrow(ranges, "rep long, part long, at long, text string, sha string"), "trie-members")
    whole = found.where("sha IS NOT NULL").select("rep", "sha")
    pieces = found.where("sha IS NULL").join(whole.select("rep"), "rep", "left_anti")
    return whole.union(pieces.repartition(tasks, "rep").sortWithinPartitions("rep", "part", "at")
                       .mapInArrow(stream, "rep long, sha string"))


class _Ids:
    """A running SHA-256 over comma-joined ids."""

    def __init__(self):
        self.hash, self.started = hashlib.sha256(), False

    def feed(self, ids: list[str]) -> None:
        if ids:
            self.hash.update((b"," if self.started else b"") + ",".join(ids).encode())
            self.started = True

    def __call__(self, ids: list[str]) -> str:
        self.feed(ids)
        return self.hash.hexdigest()


_PIECES = pa.schema([("rep", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("text", pa.string()),
                     ("sha", pa.string())])


def prefix_trie(turns: DataFrame, convs: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, pos from 1, digest of 16
    bytes, bytes) and ``convs`` (conv_id, n; also those without turns): conv_id
    (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    if convs.isEmpty():
        return turns.sparkSession.createDataFrame([], (
            "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends_sha256 string"))
    in_order = F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes")))
    seg = F.floor((F.col("pos") - 1) / SEGMENT).cast("long")
    packed = turns.groupBy("conv_id", seg.alias("seg")).agg(in_order.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    segments = stored(packed.select("conv_id", "seg", key.alias("key"), F.col("t.bytes").alias("weights"))
                      .withColumn("name", F.unhex(F.sha2("key", 256)))
                      .withColumn("size", F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x)),
                      "trie-segments")
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = (segments.select("conv_id", "seg", "size")
              .withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))))
    names = segments.groupBy("conv_id").agg(
        F.sum("size").alias("weight"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "name"))),
                                        lambda x: F.hex(x["name"])), ""), 256).alias("cid"))
    named = stored(convs.join(names, "conv_id", "left").select(
        "conv_id", "n", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("cid", F.lit("")).alias("cid")),
        "trie-named")
    classes = stored(named.groupBy("cid").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("members"),
                                              F.first("n").alias("n"), F.first("weight").alias("weight")),
                     "trie-classes")
    copied = classes.where("members > 1").select("cid", "rep")
    ends = _members_hash(named.join(copied, "cid").select("rep", "conv_id"))

    # Downwards: who shares whole segments with another class.
    reps = classes.select("rep", "members", "n", "weight")
    levels = [reps.withColumn("gid", F.lit(b""))]
    parts = (segments.join(starts.select("conv_id", "seg", "before"), ["conv_id", "seg"])
             .withColumnRenamed("conv_id", "rep"))
    if classes.where(F.col("n") >= SEGMENT).isEmpty():
        parts_at = lambda s: parts
    else:
        parts_at = lambda s: parts.where(F.col("seg") == s)
        while True:
            s = len(levels) - 1
            full = (levels[-1].where(F.col("n") >= (s + 1) * SEGMENT)
                    .join(parts_at(s).select("rep", "name"), "rep")
                    .withColumn("gid", F.unhex(F.sha2(F.concat("gid", "name"), 256))).drop("name"))
            shared = full.groupBy("gid").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gid")
            full = stored(full.join(shared, "gid", "left_semi").select(*levels[0].columns), "trie-level")
            if full.isEmpty():
                break
            levels.append(full)

    # Upwards: the elements of a level are its single classes and the groups below.
    all_nodes, groups = None, None
    for s in reversed(range(len(levels))):
        own = levels[s] if s + 1 == len(levels) else levels[s].join(levels[s + 1].select("rep"), "rep", "left_anti")
        plain = own.select("gid", "rep", F.col("n").alias("depth"), "weight", F.col("members").alias("m"),
                           F.col("rep").alias("mn"), *[F.lit(0).cast("long").alias(c) for c in ("leaves", "saved", "kids")],
                           F.col("rep").alias("ends"))
        if groups is not None:
            up = levels[s + 1].groupBy(F.col("gid").alias("_below")).agg(F.min("rep").alias("rep"))
            below = (groups.withColumnRenamed("gid", "_below").join(up, "_below")
                     .join(levels[s].select("rep", "gid"), "rep")
                     .select(*plain.columns))
            plain = plain.union(below)
        at = parts_at(s).select("rep", "key", "weights", "before")
        elements = (plain.join(at, "rep", "left").drop("rep")
                    .withColumn("before", F.coalesce("before", "weight"))     # no turn after the level's base
                    .withColumn("key", F.coalesce("key", F.lit(b"")))
                    .withColumn("weights", F.coalesce("weights", F.array().cast("array<long>"))))
        nodes, groups = _level(stored(elements, "trie-elements"), s, fan)
        all_nodes = nodes if all_nodes is None else all_nodes.union(nodes)

    # Chains to nodes: cut into runs, spread, and given the weight up to each turn where members share it.
    shas = ends.select(F.col("rep").alias("_rep"), "sha")
    all_nodes = all_nodes.join(shas, F.col("ends") == F.col("_rep"), "left")
    runs = (all_nodes.withColumn("_from", F.explode(F.sequence("top", "depth", F.lit(_RUN).cast("long"))))
            .hint("rebalance")
            .withColumn("d", F.explode(F.sequence(F.col("_from"),
                                                  F.least(F.col("_from") + (_RUN - 1), F.col("depth"))))))
    inside = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    weights = (segments.select("conv_id", "seg", F.posexplode("weights").alias("pos", "bytes"))
               .withColumn("_in", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
               .join(starts.select("conv_id", "seg", "before"), ["conv_id", "seg"])
               .select(F.col("conv_id").alias("mn"), (F.col("seg") * SEGMENT + F.col("pos") + 1).alias("d"),
                       (F.col("before") + F.col("_in")).alias("_upto")))
    many = runs.where("m > 1").join(weights, ["mn", "d"], "left")
    nodes = many.unionByName(runs.where("m = 1").withColumn("_upto", F.lit(None).cast("long")))
    last = F.col("d") == F.col("depth")
    return nodes.select(
        F.col("mn").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top"), F.col("mn")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.coalesce((F.col("m") - 1) * (F.col("weight") - F.col("_upto")), F.lit(0)))
        .alias("saved_tokens"),
        F.when(last & F.col("sha").isNotNull(), F.col("sha")).otherwise(
            F.sha2(F.when(last & F.col("ends").isNotNull(), F.col("ends").cast("string")).otherwise("")
                   .cast("binary"), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations`` with borrowed heads: conversation c takes
    the first ``crc32(c) % 9`` turns of conversation ``c - c % 5``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    turns, convs = with_borrowed_heads(numbered(turn_digests(rows)), heads,
                                       F.col("conv_id") - F.col("conv_id") % 5, most=8)
    return prefix_trie(stored(turns, "trie-rebuilt"), convs)
