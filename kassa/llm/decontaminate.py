"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items feed one generalised suffix automaton
(Blumer et al. 1985, word alphabet). Document words are streamed through it;
the state gives, at each word, the longest match that ends there. A match of
at least ``window`` words, or a whole item that is shorter than a window, marks
its words as hit. A document is contaminated when a word is hit and at least
``coverage`` of its words are.

Scale: documents never shuffle. Items are dealt into blocks of a fixed byte
size, and all blocks are broadcast before the job starts, each on its own: the
sum grows with the benchmark, which is meant to be some tens of MB. A task
holds one automaton at a time. Most words never reach
the automaton: a numpy pass keeps runs whose consecutive word pairs all occur
in an item (no match spans another pair), and only runs that can hold a whole
window are streamed.

Edge cases: a null or empty text has no words (not contaminated); items without
words match nothing; items with equal ids count once; a null item id marks
words but is not listed; repeated documents are judged row by row; other
columns of ``docs`` pass through, and a column named like a result column is
replaced by it in ``mark`` (``remove_spans`` keeps every input column).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.words import ALNUM_WORDS, Words, text_slices, tidy, window_hashes

WINDOW = 13
COVERAGE = (1, 20)              # contaminated: hit * 20 >= words * 1
BLOCK_BYTES = 8 << 20           # item text in one automaton block
RESULT = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        ends = []
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            ends.append((name, words, last))
        # Items whose window ends at a state. Windows of the full length live
        # in states that contain that length; a shorter item in its end state.
        self.items: list[set | None] = [None] * len(self.len)
        self.short: list[list[tuple[int, str | None]] | None] = [None] * len(self.len)
        for name, words, last in ends:
            if len(words) < window:
                if words:
                    state = self._holding(last, len(words))
                    self.short[state] = (self.short[state] or []) + [(len(words), name)]
                continue
            state, length = 0, 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    at = self._holding(state, window)
                    if self.items[at] is None:
                        self.items[at] = set()
                    self.items[at].add(name)
        # Nearest state up the links (itself included) that ends a short item.
        self.up = [-1] * len(self.len)
        for s in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.up[s] = s if self.short[s] else (self.up[self.link[s]] if s else -1)

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(-1)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def step(self, state: int, length: int, w: bytes) -> tuple[int, int]:
        """Longest match after one more word."""
        nxt = self.next
        while w not in nxt[state]:
            if state == 0:
                return 0, 0
            state = self.link[state]
            length = self.len[state]
        return nxt[state][w], length + 1

    def _holding(self, state: int, length: int) -> int:
        """The state up the links whose strings include the suffix of that length."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """``(start, end, items)`` of every matched span that ends at a word."""
        state = length = 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            if length >= self.window:
                yield i + 1 - length, i + 1, self.items[self._holding(state, self.window)]
            s = self.up[state]
            while s != -1:
                for n, name in self.short[s]:
                    if n <= length:
                        yield i + 1 - n, i + 1, {name}
                s = self.up[self.link[s]] if s else -1


class Block:
    """One broadcastable block of items: the automaton and its numpy filter."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        parsed = []
        for name, text in items:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            w = Words(raw, np.array([0, len(raw)]), ALNUM_WORDS, lower=True)
            if len(w):
                parsed.append((name, [w.word(i) for i in range(len(w))], w.hashes()))
        self.automaton = SuffixAutomaton([(n, ws) for n, ws, _ in parsed], window)
        self.least = min([window, *(len(ws) for _, ws, _ in parsed)])
        hashes = [h for _, _, h in parsed]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        pairs = [window_hashes(h, np.arange(len(h) - 1), 2) for h in hashes if len(h) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)

    def runs(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words that can hold a match of the least length."""
        n = len(hashes)
        known = _isin(hashes, self.vocabulary)
        if self.least > 1:
            joined = np.zeros(n + 1, dtype=bool)
            both = np.flatnonzero(known[:-1] & known[1:] & (words.left_in_doc()[:-1] > 1))
            joined[both[_isin(window_hashes(hashes, both, 2), self.pairs)] + 1] = True
            edge = np.diff(joined.astype(np.int8))
            lo = np.flatnonzero(edge[:n] == 1)
            hi = np.flatnonzero(edge[:n] == -1) + 1
            if len(hi) < len(lo):
                hi = np.append(hi, n)
        else:
            at = np.flatnonzero(known)
            doc = words.doc_of()[at]
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
            lo = at[np.concatenate([[0], cut])] if len(at) else at
            hi = at[np.concatenate([cut, [len(at)]]) - 1] + 1 if len(at) else at
        keep = hi - lo >= self.least
        return lo[keep], hi[keep]


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of bounded size, streamed to the driver block by block."""
    rows = (items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
            .where("t IS NOT NULL").distinct())
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, coverage: tuple[int, int] = COVERAGE,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids), spans (flat
    start/end word pairs of the hit spans) and contaminated."""
    docs = docs.drop(*RESULT)
    judge = _judge(docs, items, text, item_id, item_text, window, coverage, block_bytes)
    schema = T.StructType(docs.schema.fields + [
        T.StructField(name, kind) for name, kind in zip(RESULT, (
            T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()),
            T.ArrayType(T.LongType()), T.BooleanType()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, result in judge(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *result], [*batch.schema.names, *RESULT])

    return docs.mapInArrow(run, schema)


def _judge(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int,
           coverage: tuple[int, int], block_bytes: int) -> Callable:
    """A function from batches of ``docs`` to (batch, result columns)."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(items, item_id, item_text, block_bytes)]
    least, of = coverage

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        built = Block(blocks[0].value, window) if len(blocks) == 1 else None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            n_words = np.zeros(n, dtype=np.int64)
            n_hit = np.zeros(n, dtype=np.int64)
            names: dict[int, set] = {}
            spans: dict[int, list[int]] = {}
            for lo, hi, buf, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                w = Words(buf, offsets, ALNUM_WORDS, lower=True)
                n_words[lo:hi] = np.diff(w.first)
                hashes, cover = w.hashes(), None
                for b in blocks:
                    block = built or Block(b.value, window)
                    for s, e in zip(*block.runs(w, hashes)):
                        doc = lo + int(np.searchsorted(w.first, s, side="right")) - 1
                        for x, y, found in block.automaton.matches([w.word(i) for i in range(s, e)]):
                            if cover is None:
                                cover = np.zeros(len(w) + 1, dtype=np.int64)
                            cover[s + x] += 1
                            cover[s + y] -= 1
                            names.setdefault(doc, set()).update(found)
                if cover is not None:
                    hit = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n_hit[lo:hi] = total[w.first[1:]] - total[w.first[:-1]]
                    for d in np.flatnonzero(n_hit[lo:hi]):
                        own = np.diff(hit[w.first[d]:w.first[d + 1]], prepend=0, append=0)
                        spans[lo + d] = np.stack([np.flatnonzero(own == 1),
                                                  np.flatnonzero(own == -1)], 1).ravel().tolist()
            ids = [sorted(x for x in names.get(d, ()) if x is not None) for d in range(n)]
            yield batch, [pa.array(n_words), pa.array(n_hit),
                          pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.string())),
                          pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.int64())),
                          pa.array((n_hit > 0) & (of * n_hit >= least * n_words))]

    return judge


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, coverage: tuple[int, int] = COVERAGE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every hit word cut from the text (the words between stay
    as they are); a document over the coverage limit is dropped whole."""
    judge = _judge(docs, items, text, item_id, item_text, window, coverage, block_bytes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (_, n_hit, _, _, spans, contaminated) in judge(batches):
            at = batch.schema.get_field_index(text)
            if pc.any(pc.greater(n_hit, 0)).as_py():
                field, column = batch.schema.field(at), batch.column(at).to_pylist()
                for d, flat in enumerate(spans.to_pylist()):
                    if flat:
                        column[d] = _cut(column[d], flat)
                batch = batch.set_column(at, field, pa.array(column, field.type))
                batch = batch.filter(pc.invert(contaminated))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _cut(text: str, flat: list[int]) -> str:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    w = Words(raw, np.array([0, len(raw)]), ALNUM_WORDS, lower=True)
    keep, at = [], 0
    for s, e in zip(flat[::2], flat[1::2]):
        keep.append(raw[at:w.starts[s]].tobytes())
        at = w.ends[e - 1]
    keep.append(raw[at:].tobytes())
    return b"".join(keep).decode()


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
