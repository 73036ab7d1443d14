"""Language identification by a byte convolutional network (numpy).

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's maximum over the window (max pooling) feeds a softmax. The net is
trained on the driver on a bounded, hash-ordered sample of labelled windows;
prediction covers every window of every whole text, in batches on the
executors, and sums the windows' log probabilities weighted by their bytes.

Scale: training data is at most ``TRAIN_DOCS * TRAIN_WINDOWS`` windows however
many documents there are; the model is some kilobytes; documents do not shuffle
and memory follows a fixed block of windows, not the length of a text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; an
invalid or missing label is not learned from; without any label everything is
``und``; with one language it is that one; repeated rows are judged row by row;
other columns pass through, and a column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.llm.words import LOWER, text_slices, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
TRAIN_DOCS = 4000               # bound of the labelled documents learned from
TRAIN_WINDOWS = 3               # windows taken of each
EPOCHS = 4
UNKNOWN = "und"
_BLOCK = 256                    # windows convolved at once


@dataclass
class ByteCnn:
    """Weights: embedding [256, e], filters [w * e, f] and biases per width,
    output [len(WIDTHS) * f, classes]."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Filter responses by byte pair: a width-w filter at a place is a sum
        of one table row per pair (and one for an odd last byte)."""
        made = []
        for w, kernel in zip(WIDTHS, self.filters):
            single = [self.embed @ kernel[j * EMBED:(j + 1) * EMBED] for j in range(w)]
            row = []
            for j in range(0, w, 2):
                if j + 1 < w:
                    pair = single[j][:, None, :] + single[j + 1][None, :, :]
                    row.append(np.ascontiguousarray(pair.reshape(65536, -1), dtype=np.float32))
                else:
                    row.append(np.ascontiguousarray(single[j], dtype=np.float32))
            made.append(row)
        return made

    def log_probs(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log probabilities [n, classes] of byte windows [n, WINDOW]."""
        out = np.empty((len(windows), len(self.langs)), dtype=np.float32)
        for lo in range(0, len(windows), _BLOCK):
            x = windows[lo:lo + _BLOCK]
            pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            pooled = []
            for w, row, bias in zip(WIDTHS, tables, self.biases):
                n = x.shape[1] - w + 1
                sums = None
                for j, table in enumerate(row):
                    index = pairs[:, 2 * j:2 * j + n] if len(table) == 65536 else x[:, 2 * j:2 * j + n]
                    part = table[index]
                    sums = part if sums is None else np.add(sums, part, out=sums)
                pooled.append(np.maximum(sums.max(axis=1) + bias, 0))
            out[lo:lo + _BLOCK] = _log_softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias)
        return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _fresh(langs: list[str], rng: np.random.Generator) -> ByteCnn:
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return ByteCnn(langs, normal(256, EMBED, scale=0.5),
                   [normal(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   normal(len(WIDTHS) * FILTERS, len(langs), scale=0.1),
                   np.zeros(len(langs), np.float32))


def fit_windows(windows: np.ndarray, targets: np.ndarray, langs: list[str], epochs: int = EPOCHS,
                batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCnn:
    """Adam on the cross entropy of windows [n, WINDOW] with class targets [n]."""
    rng = np.random.default_rng(seed)
    net = _fresh(langs, rng)
    params = [net.embed, *net.filters, *net.biases, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps, total = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            steps += 1
            grads = _gradients(net, windows[order[lo:lo + batch]], targets[order[lo:lo + batch]])
            lr = rate * (1 - (steps - 1) / total)
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= lr * (a / (1 - 0.9 ** steps)) / (np.sqrt(b / (1 - 0.999 ** steps)) + 1e-8)
    return net


def _gradients(net: ByteCnn, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss; only each filter's maximal place takes part."""
    n = len(x)
    places, pooled = [], []
    for w, kernel, bias in zip(WIDTHS, net.filters, net.biases):
        steps = x.shape[1] - w + 1
        response = np.zeros((n, steps, FILTERS), np.float32)
        for j in range(w):
            response += (net.embed @ kernel[j * EMBED:(j + 1) * EMBED])[x[:, j:j + steps]]
        at = response.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + bias)
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    delta = np.exp(_log_softmax(hidden @ net.out + net.out_bias))
    delta[np.arange(n), y] -= 1
    delta /= n
    back = (delta @ net.out.T) * (hidden > 0)
    g_embed = np.zeros_like(net.embed)
    g_filters, g_biases = [], []
    for k, (w, kernel) in enumerate(zip(WIDTHS, net.filters)):
        g = back[:, k * FILTERS:(k + 1) * FILTERS]
        window = x[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]   # [n, f, w]
        seen = net.embed[window].reshape(n, FILTERS, w * EMBED)
        g_filters.append(np.einsum("nfk,nf->kf", seen, g))
        g_biases.append(g.sum(axis=0))
        grown = g[:, :, None] * kernel.T[None]                                           # [n, f, w * e]
        np.add.at(g_embed, window.ravel(), grown.reshape(-1, EMBED))
    return [g_embed, *g_filters, *g_biases, hidden.T @ delta, delta.sum(axis=0)]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          most_docs: int = TRAIN_DOCS, seed: int = 3, **options) -> ByteCnn:
    """A net from at most ``most_docs`` rows, the first in hash order of the key
    and text, ``TRAIN_WINDOWS`` hashed places of each."""
    raw, order = F.col("t").cast("binary"), F.xxhash64("k", "t", F.lit(seed))
    windows = [F.substring(raw, F.pmod(F.xxhash64("k", F.lit(seed + i)),
                                       F.greatest(F.octet_length("t") - WINDOW, F.lit(0)) + 1).cast("int") + 1,
                           F.lit(WINDOW)).alias(f"w{i}") for i in range(TRAIN_WINDOWS)]
    named = (labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k"))
             .where("t IS NOT NULL AND l IS NOT NULL"))
    # About twice the rows wanted pass a hash of the key, so that few leave each task.
    share = min(1.0, 2.0 * most_docs / max(1, named.count()))
    named = named.where(F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = (named.where("t RLIKE '\\\\p{L}'").select("l", order.alias("o"), *windows)
            .orderBy("o", "l").limit(most_docs).collect())
    langs = sorted({r.l for r in rows})
    seen = [(langs.index(r.l), bytes(w)) for r in rows for w in r[2:] if w]
    x = np.zeros((len(seen), WINDOW), np.uint8)
    for i, (_, raw_window) in enumerate(seen):
        x[i, :len(raw_window)] = np.frombuffer(raw_window, np.uint8)
    return fit_windows(LOWER[x], np.array([c for c, _ in seen], dtype=np.int64), langs, **options)


def _letters(texts: list, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (texts: asked only beyond ASCII)."""
    folded = buf | 0x20
    ascii_letter = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122) & (buf < 128))])
    found = np.diff(ascii_letter[offsets]) > 0
    for d in np.flatnonzero(~found):
        found[d] = any(c.isalpha() for c in texts(int(d)))
    return found


def predict(docs: DataFrame, net: ByteCnn, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the probability of lang_pred)."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType(docs.schema.fields + [T.StructField("lang_pred", T.StringType()),
                                                T.StructField("score", T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            own = model.value
            tables = tables or own.tables()
            column = batch.column(at)
            langs = np.full(batch.num_rows, UNKNOWN, dtype=object)
            scores = np.zeros(batch.num_rows)
            for lo, hi, buf, offsets in text_slices(column, 1 << 20):
                if not own.langs:
                    break
                known = np.flatnonzero(_letters(lambda d: column[lo + d].as_py() or "", buf, offsets))
                if not len(known):
                    continue
                size = np.diff(offsets)[known]
                count = -(-size // WINDOW)
                rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(offsets[known], count) + rank * WINDOW
                length = np.minimum(WINDOW, np.repeat(offsets[known + 1], count) - start)
                padded = np.concatenate([LOWER[buf], np.zeros(WINDOW, np.uint8)])
                sums = np.zeros((len(known), len(own.langs)))
                doc = np.repeat(np.arange(len(known)), count)
                for a in range(0, len(start), 4096):
                    s, n = start[a:a + 4096], length[a:a + 4096]
                    x = padded[s[:, None] + np.arange(WINDOW)]
                    x[np.arange(WINDOW) >= n[:, None]] = 0
                    np.add.at(sums, doc[a:a + 4096], own.log_probs(x, tables) * n[:, None])
                probs = np.exp(_log_softmax(sums / size[:, None]))
                best = probs.argmax(axis=1)
                langs[lo + known] = np.array(own.langs, dtype=object)[best]
                scores[lo + known] = np.clip(probs[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)],
                                             [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
