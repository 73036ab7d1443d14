"""Vector code compression: product codebooks by active-entry Lloyd rounds.

Components become integers (``floor(scale * x)``), so distances, sums and means
are exact and the result does not depend on partitions or row order. A vector
is cut into equal parts, and each part position has a codebook of its own.

Each Lloyd round assigns every part to the nearest entry of its codebook, then
moves each entry to the floor of its parts' mean. A row carries its codes and
its exact distances from round to round. A part whose entry did not move keeps
its stored distance and is compared with the moved entries alone: against the
others it has won already. A part whose entry moved is compared with all. The
lower index wins ties in both cases, so the codes are those of a full search.
Rounds end early when no entry moves; the rest would change nothing.

Scale: a round is one pass that writes the rows with their state to the shared
folder (a lost executor costs its tasks of one round) and drops the table
before. The first row of a batch carries the batch's sums, so the next
codebooks come from one pruned column; a task adds its batches up and sends one
number for each codebook component. Nothing is shuffled by entry, so a hot
vector, label or entry moves nothing to one task. The driver and each task hold
the codebooks: parts x entries x components, fixed by parameters.

Edge cases: a vector that is null, empty, or holds a null, NaN or infinite
component is dropped, as is one of another length than most (ties: the longer)
have. The first codebooks are those of the least ids; rows of equal ids come in
order of their vectors, null ids last. With fewer vectors than entries the
codebooks are shorter. Equal rows are kept and counted each. An empty table
gives no rows. Only the named columns are read. A length that the parts do not
divide is an error, and so are components so large that a squared distance
could leave 64 bits (32,768 and above for 64 components at a scale of 4,096).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.words import tidy
from kassa.session import release_scratch, scratch_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_SLICE = 1 << 21                          # components handled at once


def nearest(x: np.ndarray, book: np.ndarray, code: np.ndarray, best: np.ndarray,
            moved: np.ndarray | None) -> None:
    """Bring ``code`` and ``best`` (exact squared distance) of the parts ``x`` up
    to date with ``book``; ``moved`` marks the entries that changed since they
    were right (None: nothing is known yet)."""
    def distance(rows, j):
        gap = x[rows] - book[j]
        return np.einsum("ij,ij->i", gap, gap)

    stale = np.ones(len(x), dtype=bool) if moved is None else moved[code]
    rows = np.flatnonzero(stale)
    if len(rows):
        code[rows], best[rows] = 0, distance(rows, 0)
        for j in range(1, len(book)):
            d = distance(rows, j)
            closer = d < best[rows]
            code[rows[closer]], best[rows[closer]] = j, d[closer]
    rows = np.flatnonzero(~stale)
    if len(rows):
        for j in np.flatnonzero(moved):
            d = distance(rows, j)
            wins = (d < best[rows]) | ((d == best[rows]) & (j < code[rows]))
            code[rows[wins]], best[rows[wins]] = j, d[wins]


def _integers(vectors: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """Rows of integer components; refuses what 64-bit distances cannot hold."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dim)
    if x.size and dim * (2 * float(np.abs(x).max())) ** 2 >= 2.0 ** 63:
        raise OverflowError("a vector component is too large for exact 64-bit distances")
    return x.astype(np.int64).reshape(len(x), parts, dim // parts)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A writable copy of a column of equally long binary values."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data.view(dtype).reshape(len(column), width).copy()


def _sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Per part position and entry: the componentwise sum and, last, the count."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), dtype=np.int64)
    for p in range(parts):
        np.add.at(out[p, :, :width], code[:, p], x[:, p])
        out[p, :, width] = np.bincount(code[:, p], minlength=entries)
    return out


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, dim: int, scale: int,
              schema: T.StructType) -> DataFrame:
    """``rows`` with codes, distances and batch sums for ``books``. Without
    ``moved``, ``_vector`` still holds the vectors as they came."""
    parts, entries, width = books.shape
    others = [f.name for f in schema.fields if f.name not in ("_vector", "_code", "_best", "_error", "_sums")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _SLICE // dim)
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                n = batch.num_rows
                if moved is None:
                    x = _integers(batch.column("_vector"), dim, parts, scale)
                    code, best = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
                else:
                    x = _rows(batch.column("_vector"), np.int32, dim).astype(np.int64).reshape(n, parts, width)
                    code = _rows(batch.column("_code"), np.uint8, parts)
                    best = _rows(batch.column("_best"), np.int64, parts)
                for p in range(parts):
                    c, b = code[:, p].copy(), best[:, p].copy()
                    nearest(x[:, p], books[p], c, b, None if moved is None else moved[p])
                    code[:, p], best[:, p] = c, b
                sums = [_sums(x, code, entries).tobytes()] + [None] * (n - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in others]
                    + [_binary(x.reshape(n, dim).astype(np.int32)), _binary(code), _binary(best),
                       pa.array(best.sum(axis=1)), pa.array(sums, pa.binary())],
                    names=[*others, "_vector", "_code", "_best", "_error", "_sums"])

    return rows.mapInArrow(run, schema)


def _totals(rows: DataFrame, shape: tuple[int, int, int]) -> list:
    """The batch sums of all rows added up: nested lists of Python integers."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_py(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["at", "n"])

    found = (rows.select("_sums").where("_sums IS NOT NULL").mapInArrow(run, "at int, n long")
             .groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect())
    flat = [0] * size
    for r in found:
        flat[r["at"]] = int(r["n"])
    return np.array(flat, dtype=object).reshape(shape)


def _finite(vector: str) -> F.Column:
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``id_col``, the columns ``keep``, ``code`` (binary, an entry index a part)
    and ``error`` (the parts' final squared distances added up) of every kept
    vector; and the codebooks (parts, entries, components)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = df.sparkSession
    rows = df.where(_finite(vector_col)).select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        F.col(vector_col).alias("_vector"))
    lengths = rows.groupBy(F.size("_vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    rows = rows.where(F.size("_vector") == dim)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_vector"]
                          + [T.StructField(c, T.BinaryType()) for c in ("_vector", "_code", "_best")]
                          + [T.StructField("_error", T.LongType()), T.StructField("_sums", T.BinaryType())])
    first = rows.orderBy(F.asc_nulls_last("_id"), "_vector").limit(entries).select("_vector").collect()
    if not first:
        none = spark.createDataFrame([], schema)
        return _result(none, id_col, keep), np.zeros((parts, 0, dim // parts), np.int64)
    books = _integers(pa.array([r["_vector"] for r in first], pa.list_(pa.float64())), dim, parts, scale)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    moved, path = None, None
    for turn in range(rounds + 1):
        last, path = path, scratch_path(spark, "codebooks")
        _assigned(rows, books, moved, dim, scale, schema).write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        if last:
            release_scratch(spark, [last])
        if turn == rounds:
            break
        total = _totals(rows, (*books.shape[:2], books.shape[2] + 1))
        count = total[:, :, -1:]
        new = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books).astype(np.int64)
        moved = (new != books).any(axis=2)
        books = new
        if not moved.any():
            break
    return _result(rows, id_col, keep), books


def _result(rows: DataFrame, id_col: str, keep: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
                       F.col("_code").alias("code"), F.col("_error").alias("error"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the compressed ``embeddings``: vec_id, code (hex), error,
    label_error, codebooks_sha256."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes, books = compress(vectors, keep=("label",))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    per_label = (codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return (codes.join(per_label, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                    F.lit(digest).alias("codebooks_sha256")))
