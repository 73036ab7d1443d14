"""SentencePiece encoding and decoding by suffix-array matching.

The text of a batch is cut where no piece can reach across (before a run of
word marks, and around characters that are in no piece); its distinct chunks
are concatenated and indexed by a suffix array of the longest piece's depth.
Every vocabulary piece is binary searched for its range of suffixes; the ranges
are the edges (place, length, piece) of the segmentation graph, sorted by
place. Relaxation then follows the model: for a BPE model the best scored edge
over two neighbouring symbols is taken, leftmost first, until none is left,
over all chunks at once; long chunks relax through a heap. Characters in no
piece become byte pieces. The ids equal those of the sentencepiece library.

Scale: documents do not shuffle; a task indexes some megabytes of text at a
time, so memory follows that block and not the batch or a long text's words.

Edge cases: a null or empty text has no ids; text that holds the word mark
itself decodes it as a space, as the library does; invalid byte runs decode to
U+FFFD; other columns pass through and a column named like a result is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.words import byte_hashes, ragged, tidy

MARK = "▁"
LONG = 200                      # characters of a chunk that relaxes through a heap
BLOCK_BYTES = 1 << 20          # text indexed at once
_NO_RANK = np.int64(1 << 40)


class Vocabulary:
    """Pieces of a SentencePiece model file: a BPE model with identity
    normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.model = spm.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if (spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or not spec.trainer_spec.byte_fallback):
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is needed")
        m, n = self.model, len(spec.pieces)
        names = [p.piece for p in spec.pieces]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = np.array(plain)
        self.points = [np.frombuffer(names[i].encode("utf-32-le"), np.uint32) + np.uint32(1) for i in plain]
        self.lengths = np.array([len(p) for p in self.points])
        scores = np.array([spec.pieces[i].score for i in plain])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)   # 0: best
        self.depth = int(self.lengths.max())
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece reaches across a word mark")
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        known = set("".join(names[i] for i in plain))
        #: ASCII bytes in no piece: hard cuts.
        self.breaks = np.array([b < 128 and chr(b) not in known and b != 32 for b in range(256)])
        #: Bytes that each id decodes to.
        self.decoded = [names[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        for i in range(n):
            if m.is_control(i):
                self.decoded[i] = b""
            elif m.is_unknown(i):
                self.decoded[i] = " ⁇ ".encode()


class SuffixArray:
    """Suffixes of a code-point text (0: between chunks) sorted to a depth.
    A pattern holds no 0, so no match reaches across chunks."""

    def __init__(self, points: np.ndarray, depth: int):
        self.alphabet, dense = np.unique(points, return_inverse=True)
        self.base = 0 if len(self.alphabet) and self.alphabet[0] == 0 else 1
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        self.per_key = 1 << (64 // self.bits).bit_length() - 1        # characters of a key: a power of two
        self.depth = -(-depth // self.per_key) * self.per_key
        n = len(points)
        key = np.zeros(n + 2 * self.depth, dtype=np.uint64)
        key[:n] = dense + self.base
        have = 1
        while have < self.per_key:
            key[:-have] = key[:-have] << np.uint64(self.bits * have) | key[have:]
            have *= 2
        self.keys = [key[lo:lo + n] for lo in range(0, self.depth, self.per_key)]
        self.order = np.argsort(self.keys[0])
        # Suffixes that agree in the first key, by the others.
        first = self.keys[0][self.order]
        new = np.append(True, first[1:] != first[:-1]) if n else np.empty(0, bool)
        run = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        own = self.order[tied]
        self.order[tied] = own[np.lexsort([*(k[own] for k in self.keys[:0:-1]), run[tied]])]
        self.keys = [k[self.order] for k in self.keys]

    def _pattern(self, points: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest keys of suffixes that start with each pattern."""
        codes = np.zeros((len(points), self.depth), dtype=np.uint64)
        inside = np.zeros((len(points), self.depth), dtype=bool)
        size = np.array([len(p) for p in points])
        inside[np.arange(self.depth) < size[:, None]] = True
        codes[inside] = np.searchsorted(self.alphabet, np.concatenate(points)).astype(np.uint64) + np.uint64(self.base)
        top = np.uint64((1 << self.bits) - 1)
        least, most = [], []
        for lo in range(0, self.depth, self.per_key):
            a = np.zeros(len(points), dtype=np.uint64)
            b = np.zeros(len(points), dtype=np.uint64)
            for j in range(lo, lo + self.per_key):
                a <<= np.uint64(self.bits)
                b <<= np.uint64(self.bits)
                a |= codes[:, j]
                b |= np.where(inside[:, j], codes[:, j], top)
            least.append(a)
            most.append(b)
        return least, most

    def _search(self, pattern: list[np.ndarray], after_equal: bool) -> np.ndarray:
        """Binary search of all patterns at once."""
        lo = np.zeros(len(pattern[0]), dtype=np.int64)
        hi = np.full(len(pattern[0]), len(self.order), dtype=np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(self.order) - 1)
            less = np.full(len(lo), after_equal)       # is the suffix before the place sought?
            for key, p in zip(self.keys[::-1], pattern[::-1]):
                k = key[at]
                less = np.where(k == p, less, k < p)
            open_ = lo < hi
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def ranges(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) sorted suffix that starts with each pattern."""
        least, most = self._pattern(points)
        return self._search(least, False), self._search(most, True)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.all_points = np.concatenate(vocabulary.points)
        self.piece_of_point = np.repeat(np.arange(len(vocabulary.points)), vocabulary.lengths)

    def _edges(self, points: np.ndarray) -> np.ndarray:
        """The piece of every edge in order of place and length, -1 where there
        is none: a distribution sort of the ranges found."""
        v = self.v
        index = SuffixArray(points, v.depth)
        missing = ~np.isin(self.all_points, index.alphabet)
        usable = np.ones(len(v.points), dtype=bool)
        usable[self.piece_of_point[missing]] = False
        usable = np.flatnonzero(usable)
        small = len(v.points) < 1 << 15
        edges = np.full(len(points) * v.depth, -1, dtype=np.int16 if small else np.int32)
        if len(usable):
            first, last = index.ranges([v.points[i] for i in usable])
            count = last - first
            place = index.order[ragged(first, count)]
            edges[place * v.depth + np.repeat(v.lengths[usable] - 1, count)] = np.repeat(usable, count)
        return edges

    def segment(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the chunks that start at ``starts`` of a concatenated text
        (a 0 after each chunk): places, and pieces (-1: a character in no piece)."""
        v, n = self.v, len(points)
        ends = np.append(starts[1:], n) - 1
        chunk_end = np.repeat(ends, ends + 1 - starts)
        edges = self._edges(points)
        is_start = points != 0
        long = np.flatnonzero(ends - starts > LONG)
        for c in long:
            self._relax_heap(edges, int(starts[c]), int(ends[c]), is_start)
        active = np.ones(len(starts), dtype=bool)
        active[long] = False
        live = np.repeat(active, ends + 1 - starts)
        at = np.flatnonzero(is_start & live)
        while len(at):
            own_end = chunk_end[at]
            after = np.minimum(np.append(at[1:], n), own_end)       # end of the symbol
            after2 = np.append(after[1:], n)                        # end of the next symbol
            pair = np.flatnonzero((after < own_end) & (after2 - at <= v.depth))
            piece = edges[at[pair] * v.depth + (after2[pair] - at[pair] - 1)]
            found = piece >= 0
            score = np.full(len(at), _NO_RANK)
            score[pair[found]] = v.rank[piece[found]]
            # Best edge of each chunk, leftmost of equals.
            head = np.flatnonzero(np.append(True, own_end[1:] != own_end[:-1]))
            best = np.minimum.reduceat(score, head)
            size = np.diff(np.append(head, len(at)))
            hit = np.flatnonzero(score == np.repeat(best, size))
            chunk = np.repeat(np.arange(len(head)), size)[hit]
            hit = hit[np.append(True, chunk[1:] != chunk[:-1])]
            going = best < _NO_RANK
            is_start[after[hit[going]]] = False
            at = at[np.repeat(going, size)]
            at = at[is_start[at]]
        at = np.flatnonzero(is_start)
        length = np.minimum(np.append(at[1:], n), chunk_end[at]) - at
        return at, edges[at * v.depth + length - 1].astype(np.int64)

    def _relax_heap(self, edges: np.ndarray, lo: int, hi: int, is_start: np.ndarray) -> None:
        """The same relaxation of one long chunk, by a heap of candidate edges."""
        v, size = self.v, hi - lo
        nxt, prv = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = [True] * size
        own, rank = edges[lo * v.depth:hi * v.depth], v.rank.tolist()
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < size:
                end = nxt[j]
                if end - i <= v.depth:
                    piece = int(own[i * v.depth + end - i - 1])
                    if piece >= 0:
                        heapq.heappush(heap, (rank[piece], i, end))

        for i in range(size):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= size or nxt[nxt[i]] != end:
                continue
            j = nxt[i]
            alive[j] = False
            is_start[lo + j] = False
            nxt[i] = end
            if end < size:
                prv[end] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for every text (null: none)."""
        v = self.v
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        # The dummy prefix: a space before every text that is not empty.
        joined = b" ".join([b"", *(t.as_buffer() for t, n in zip(raw, size) if n)])
        buf = np.frombuffer(joined, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.where(size > 0, size + 1, 0))])
        if not len(buf):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        # A literal mark in a text is a space to the model.
        space = buf == 32
        mark = np.frombuffer(MARK.encode(), np.uint8)
        literal = np.flatnonzero((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2])) \
            if len(buf) > 2 else np.empty(0, np.int64)
        if len(literal):
            space = space.copy()
            for k in range(3):
                space[literal + k] = True
        start = np.zeros(len(buf) + 1, dtype=bool)
        start[:-1] = space
        start[1:-1] &= ~space[:-1]
        hard = np.flatnonzero(v.breaks[buf])
        start[hard] = True
        start[hard + 1] = True
        start[bounds[:-1][size > 0]] = True
        start[-1] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(buf))
        _, first, code = np.unique(byte_hashes(buf, begin, end), return_index=True, return_inverse=True)
        # The distinct chunks with a byte between them, as code points plus one
        # (so that 0 is no character).
        size_of = end[first] - begin[first] + 1
        spots = np.minimum(ragged(begin[first], size_of), len(buf) - 1)
        part = buf[spots]
        after = np.cumsum(size_of) - 1
        part[after] = 1
        lead = np.cumsum((part & 0xC0) != 0x80)
        points = np.frombuffer(part.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.uint32) + np.uint32(1)
        points[lead[after] - 1] = 0
        starts = np.append(0, lead[after][:-1])
        place, piece = self.segment(points, starts)
        # Ids of a symbol: the piece's own, or the bytes of the character.
        strange, which = np.unique(points[place[piece < 0]], return_inverse=True)
        spelled = [v.byte_ids[list(chr(c - 1).encode())] for c in strange]
        table = np.concatenate([v.ids, *spelled])
        width = np.concatenate([np.ones(len(v.ids), np.int64), np.array([len(s) for s in spelled], np.int64)])
        entry = piece.copy()
        entry[piece < 0] = len(v.ids) + which
        begins = np.cumsum(width) - width
        flat = table[ragged(begins[entry], width[entry])]
        cuts = np.searchsorted(place, np.append(starts, len(points)))
        total = np.concatenate([[0], np.cumsum(width[entry])])
        chunk_at, chunk_n = total[cuts[:-1]], np.diff(total[cuts])
        ids = flat[ragged(chunk_at[code], chunk_n[code])]
        done = np.concatenate([[0], np.cumsum(chunk_n[code])])
        return ids, np.diff(done[np.searchsorted(begin, bounds)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of flat ids."""
        v = self.v
        size = np.array([len(d) for d in v.decoded])
        data = np.frombuffer(b"".join(v.decoded), np.uint8)
        begin = np.cumsum(size) - size
        buf = data[ragged(begin[ids], size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            raw = buf[a:b]
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


def _encoder(path: str, made: dict = {}) -> Encoder:
    """One encoder a worker and model."""
    if path not in made:
        made[path] = Encoder(Vocabulary(path))
    return made[path]


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    lo, before = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, before + BLOCK_BYTES, side="right")))
        yield texts.slice(lo, hi - lo)
        lo, before = hi, int(size[hi - 1])


def encode(docs: DataFrame, model: str, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` without the text, with ids, n_ids and (with ``check``)
    round_trip: whether the ids decode to the text."""
    results = ["ids", "n_ids"] + ["round_trip"] * check
    rest = [c for c in docs.columns if c not in (text, *results)]
    source = docs.select(F.col(text).alias("_text"), *[F.col(c) for c in rest])
    fields = [docs.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType())),
                                               T.StructField("n_ids", T.LongType())]
    schema = T.StructType(fields + [T.StructField("round_trip", T.BooleanType())] * check)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in _blocks(batch.column(0)):
                own = _encoder(model)
                ids, counts = own.encode(part)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [c.slice(lo, len(part)) for c in batch.columns[1:]]
                columns += [pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))),
                            pa.array(counts)]
                if check:
                    back = own.decode(ids, counts)
                    columns.append(pa.array([(t or "").replace(MARK, " ") == b
                                             for t, b in zip(part.to_pylist(), back)], pa.bool_()))
                lo += len(part)
                yield pa.RecordBatch.from_arrays(columns, [*rest, *results])

    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text of its ids (null ids: null) in place of them."""
    rest = [c for c in docs.columns if c not in (ids, text)]
    source = docs.select(F.col(ids).alias("_ids"), *[F.col(c) for c in rest])
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(text, T.StringType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            counts = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            back = pa.array(_encoder(model).decode(flat, counts), pa.string())
            back = pc.if_else(column.is_valid(), back, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], back], [*rest, text])

    return source.mapInArrow(run, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
