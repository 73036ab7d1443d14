"""Token-id files with Elias-Fano document boundaries.

A segment file holds the concatenated ids of consecutive documents, the
documents' ids and the document boundaries as Elias-Fano sequences (Elias 1974,
Fano 1971; select samples as in Vigna 2008): with n boundaries up to u, the low
``floor(log2(u / n))`` bits of each are packed and the high parts are a unary
bitmap, about ``2 + log2(u / n)`` bits a document instead of 64. ``select(i)``
finds boundary ``i`` from a sampled position and a popcount scan.

Writing: documents are range partitioned and sorted by id, each task encodes
its range and cuts it into segments of at most ``segment_ids`` ids (one
document longer than that is a segment of its own); no document crosses tasks.
Reading: a task parses its segments; the ids before a segment come from one
total per segment.

Edge cases: a null or empty text is only the end id; a null document id sorts
first and is kept; equal ids stay in order of their text's hash; other columns
are not written; an empty table writes no segment.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from kassa.llm.sinks import read_bytes, write_bytes
from kassa.llm.words import ragged, tidy
from kassa.session import scratch_path

MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sIIIQQqQQQQ")   # magic, width, partition, seq, docs, nulls, base, sizes
END_ID = 2
SEGMENT_IDS = 2 << 20
SAMPLE = 256                              # a select sample for every so many values


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    _HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._samples: np.ndarray | None = None
        self._ranks: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        high = np.zeros(n + (top >> low_bits) + 1, dtype=np.uint8)
        high[((values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) \
            + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> "EliasFano":
        n, low_bits, n_low, n_high = cls._HEAD.unpack_from(raw, at)
        at += cls._HEAD.size
        low = np.frombuffer(raw, np.uint8, n_low, at)
        return cls(n, low_bits, low, np.frombuffer(raw, np.uint8, n_high, at + n_low))

    def _low_of(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        chunk = int.from_bytes(self.low[first >> 3:(last + 7) >> 3].tobytes(), "little")
        return (chunk >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: a sampled byte, then a scan by popcounts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        if self._samples is None:
            ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
            wanted = np.arange(0, self.n, SAMPLE)
            self._samples = np.searchsorted(ones, wanted, side="right")
            self._ranks = np.where(self._samples > 0, ones[np.maximum(self._samples - 1, 0)], 0)
        byte, seen = int(self._samples[i // SAMPLE]), int(self._ranks[i // SAMPLE])
        while True:
            here = int(self.high[byte]).bit_count()
            if seen + here > i:
                break
            seen, byte = seen + here, byte + 1
        value = int(self.high[byte])
        for _ in range(i - seen):
            value &= value - 1
        position = 8 * byte + (value & -value).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low_of(i)

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little")
            weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            out |= (bits.reshape(self.n, self.low_bits) * weights).sum(axis=1, dtype=np.uint64)
        return out


def pack_segment(partition: int, seq: int, doc_ids: list[int | None], lengths: np.ndarray,
                 ids: np.ndarray) -> bytes:
    """One segment: header, document ids, boundaries, ids, checksum."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    names = EliasFano.of((known.astype(np.uint64) - np.uint64(base & (2**64 - 1)))).to_bytes()
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = ids.astype(f"<u{width}").tobytes()
    head = _HEAD.pack(MAGIC, width, partition, seq, len(doc_ids), nulls, base,
                      len(names), len(bounds), len(body), len(ids))
    raw = head + names + bounds + body
    return raw + struct.pack("<I", zlib.crc32(raw))


class Segment:
    """A segment read back; documents are reached by position."""

    def __init__(self, raw: bytes, checked: bool = True):
        (magic, width, self.partition, self.seq, self.n_docs, self.nulls, self.base, n_names,
         n_bounds, n_body, self.n_ids) = _HEAD.unpack_from(raw)
        end = _HEAD.size + n_names + n_bounds + n_body
        if magic != MAGIC or (checked and zlib.crc32(raw[:end]) != struct.unpack_from("<I", raw, end)[0]):
            raise ValueError("not a whole token segment")
        self._names = EliasFano.from_bytes(raw, _HEAD.size)
        self.bounds = EliasFano.from_bytes(raw, _HEAD.size + n_names)
        self.ids = np.frombuffer(raw, f"<u{width}", n_body // width, _HEAD.size + n_names + n_bounds)

    def doc_ids(self) -> list[int | None]:
        known = (self._names.values() + np.uint64(self.base & (2**64 - 1))).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]


#: One letter run and a run of plain marks: exactly two (or one) pre-tokens, so
#: its ids are those of the lower-cased letters and those of the marks.
_SIMPLE = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?|#*$%&]*)$"


class UnitEncoder:
    """Ids of whole texts by way of their distinct white-space units.

    The vocabulary drops white space and merges only inside a word, so the ids
    of a text are those of its units in order. Each distinct unit of a batch is
    encoded once; simple units share their lower-cased stem and tail, and many
    stems go through the library in one call, cut again at the word ends.
    """

    END = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END)]] = True

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str], group: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of letter-only words."""
        ids, lengths = [], []
        groups = [stems[i:i + group] for i in range(0, len(stems), group)]
        # A few groups at a time: what the library returns is larger than the ids.
        joined = (e for i in range(0, len(groups), 32)
                  for e in self._each([" ".join(g) for g in groups[i:i + 32]]))
        for words, got in zip(groups, joined):
            got = np.array(got, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(words):
                own = self._each(words)
                got = np.concatenate([np.array(x, np.uint32) for x in own])
                cuts = np.cumsum([len(x) for x in own])
            ids.append(got)
            lengths.append(np.diff(cuts, prepend=0))
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32),
                np.concatenate(lengths) if lengths else np.empty(0, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of every text (null: none)."""
        ids, lengths = zip(*self.parts(texts), (np.empty(0, np.uint32), np.empty(0, np.int64)))
        return np.concatenate(ids), np.concatenate(lengths)

    def parts(self, texts: pa.Array, units_at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same, some texts after others: distinct units are encoded over
        all texts, ids are laid out for some units at a time."""
        units = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = units.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False)
        distinct = flat.dictionary
        parts = pc.extract_regex(distinct, _SIMPLE)
        simple = parts.is_valid()
        known = parts.filter(simple)
        stems = pc.utf8_lower(pc.struct_field(known, "stem")).dictionary_encode()
        tails = pc.struct_field(known, "tail").dictionary_encode()
        rest = distinct.filter(pc.invert(simple)).to_pylist()
        stem_ids, stem_len = self._stems(stems.dictionary.to_pylist())
        others = [np.array(x, np.uint32) for x in self._each(tails.dictionary.to_pylist() + rest)]
        table = np.concatenate([stem_ids, *others])
        lengths = np.concatenate([stem_len, [len(x) for x in others]]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        # Every distinct unit is a first and a second part of that table.
        n_stems, n_tails = len(stem_len), len(tails.dictionary)
        first = np.empty(len(distinct), dtype=np.int64)
        second = np.full(len(distinct), -1, dtype=np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        first[is_simple] = stems.indices.to_numpy(zero_copy_only=False)
        second[is_simple] = n_stems + tails.indices.to_numpy(zero_copy_only=False)
        first[~is_simple] = n_stems + n_tails + np.arange(len(rest))
        starts, lengths = np.append(starts, 0), np.append(lengths, 0)   # -1: nothing
        offsets, lo = np.asarray(units.offsets), 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + units_at_once, side="right")) - 1)
            own = code[offsets[lo]:offsets[hi]]
            pair = np.stack([first[own], second[own]], axis=1).ravel()
            ids = table[ragged(starts[pair], lengths[pair])]
            unit_len = lengths[first[own]] + lengths[second[own]]
            yield ids, np.diff(np.concatenate([[0], np.cumsum(unit_len)])[offsets[lo:hi + 1] - offsets[lo]])
            lo = hi


def _encoder(path: str, made: dict = {}) -> UnitEncoder:
    """One encoder a worker and vocabulary."""
    if path not in made:
        made[path] = UnitEncoder(path)
    return made[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                      doc_id: str = "doc_id", text: str = "text",
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Segments of all documents in ascending id order under ``path``."""
    ordered = (docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
               .withColumn("h", F.xxhash64("t")).withColumn("r", F.monotonically_increasing_id())
               .repartitionByRange("d", "h", "r").sortWithinPartitions("d", "h", "r")
               .select("d", "t"))

    @tidy
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        partition, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def flush():
            nonlocal names, held, lengths, size, seq
            raw = pack_segment(partition, seq, names, np.array(lengths, dtype=np.int64),
                               np.concatenate(held))
            names, held, lengths, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["blob"])

        for batch in batches:
            for part in _bounded(batch):
                own = iter(part.column("d").to_pylist())
                for ids, n in _encoder(tokenizer).parts(part.column("t")):
                    bounds = np.concatenate([[0], np.cumsum(n)])
                    for i in range(len(n)):
                        if size and size + n[i] + 1 > segment_ids:
                            yield flush()
                        names.append(next(own))
                        lengths.append(int(n[i]) + 1)
                        held.append(np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end_id)))
                        size += int(n[i]) + 1
        if names:
            yield flush()

    write_bytes(ordered.mapInArrow(segments, "blob binary"), path)


def _bounded(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` text bytes (one text at least)."""
    size = np.cumsum(pc.binary_length(batch.column("t")).fill_null(0).to_numpy(zero_copy_only=False))
    lo, before = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, before = hi, int(size[hi - 1])


def _parse(spark: SparkSession, path: str, rows: Callable[[Segment], dict], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                yield pa.RecordBatch.from_pydict(rows(Segment(raw.as_buffer().to_pybytes())))
    return read_bytes(spark, path).mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, from the files alone;
    with ``digest``, ids_crc32 (of the ids as little-endian unsigned 32 bit) in
    place of the ids."""
    def documents(s: Segment) -> dict:
        bounds = s.bounds.values().astype(np.int64)
        if digest:
            last = pa.array([zlib.crc32(s.ids[a:b].astype("<u4").tobytes())
                             for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())
        else:
            last = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(s.ids.astype(np.int32)))
        n = s.n_docs
        return {"partition": pa.array(np.full(n, s.partition, np.int64)),
                "seq": pa.array(np.full(n, s.seq, np.int64)),
                "doc_id": pa.array(s.doc_ids(), pa.int64()), "at": pa.array(bounds[:-1]),
                "n_tokens": pa.array(np.diff(bounds)), "ids": last}

    def total(s: Segment) -> dict:
        return {"partition": [s.partition], "seq": [s.seq], "n": [s.n_ids]}

    totals = _parse(spark, path, total, "partition long, seq long, n long")
    # One row per segment file: the running total orders the files.
    before = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("partition", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind, name = ("long", "ids_crc32") if digest else ("array<int>", "ids")
    parsed = _parse(spark, path, documents, "partition long, seq long, doc_id long, at long, "
                                            f"n_tokens long, ids {kind}")
    return (parsed.join(totals, ["partition", "seq"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens",
                    F.col("ids").alias(name)))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path, digest=True)
