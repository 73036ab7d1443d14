"""Quality rules: learned decision lists (sequential covering), native Spark.

Statistics of whole texts are DataFrame expressions. A bounded, hash-ordered
sample of labelled statistics is read to the driver, where sequential covering
(RIPPER-style: grow a conjunction of thresholds by FOIL gain, prune it on held
out rows by precision) learns an ordered list of rules. The list becomes one
``CASE WHEN`` expression; no Python runs on the executors.

Scale: every statistic is a per-row expression, so documents never shuffle; the
only join is the bounded label sample against the documents it names.

Edge cases: a null or empty text has no words and fails the base rule; without
labels of both classes the list is empty and every document that passes the
base rule is kept; conflicting labels of one document count as separate rows;
extra columns pass through and columns named like a statistic are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
SHINGLE = 5
MAX_LABELLED = 20_000           # bound of the rows the rules are learned from
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base statistics of every whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.drop(*BASE)
    # words: the runs between white space; splitting leaves an empty string at
    # either end only, which the trimmed text avoids.
    df = df.withColumn("_t", F.btrim(t, F.lit(SPACES)))
    df = df.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("_t", r"[ \t-\r]+")))
    w, n = F.col("_w"), F.size("_w")
    shingles = F.when(n >= SHINGLE, F.transform(
        F.sequence(F.lit(1), n - (SHINGLE - 1)),
        lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(SHINGLE)])))
    df = df.withColumn("_h", F.coalesce(shingles, F.array().cast("array<bigint>")))
    df = df.withColumn("_r", F.size("_h") != F.size(F.array_distinct("_h")))
    # Only texts with a repeated window sort their windows: equal hashes become
    # neighbours, and the positions of the repeated ones are put in order.
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_r"), ranked))
    s = F.col("_s")
    hit = F.filter(F.transform(s, lambda x, k: F.when(
        ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
        lambda p: p.isNotNull())
    df = df.withColumn("_p", F.when(F.col("_r"), F.sort_array(hit)))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(SHINGLE)),
                                            F.lit(SHINGLE))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("_l", lines)
    stats = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(_without(t, SPACES)).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_r"), covered).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"))
    # Through the one-row generator no later filter on a statistic is pushed:
    # pushed filters would repeat the array expressions inside each other.
    return df.select(*docs.drop(*BASE).columns, F.inline(F.array(stats)))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _share(part: Column, whole: str) -> Column:
    return part / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """Interpretable ratios that rules test, from the base statistics."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share(F.col("word_chars"), "n_words"),
        "symbol_rate": _share(F.col("n_symbols"), "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "dup_line_rate": _share(100 * F.col("n_dup_lines"), "n_words"),
        "repeat_rate": _share(F.col("n_repeat_words"), "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``feature <= / > threshold`` tests; it rejects."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, cut in self.tests:
            out = out & (values[name] > F.lit(cut) if op == ">" else values[name] <= F.lit(cut))
        return out


def _covers(tests, x: np.ndarray, names: list[str]) -> np.ndarray:
    mask = np.ones(len(x), dtype=bool)
    for name, op, cut in tests:
        v = x[:, names.index(name)]
        mask &= v > cut if op == ">" else v <= cut
    return mask


def _cuts(v: np.ndarray, most: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) > most:
        u = np.unique(np.quantile(v, np.linspace(0, 1, most)))
    return (u[:-1] + u[1:]) / 2


def _grow(x, bad, names, most_tests: int, cuts: dict) -> list[tuple[str, str, float]]:
    tests: list[tuple[str, str, float]] = []
    mask = np.ones(len(x), dtype=bool)
    while len(tests) < most_tests:
        p0, n0 = bad[mask].sum(), (~bad[mask]).sum()
        if not n0 or not p0:
            break
        best = (1e-9, None)
        for j, name in enumerate(names):
            v, b = x[mask, j], bad[mask]
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts[name], side="right")
            pos = np.concatenate([[0], np.cumsum(b[order])])
            for op, p, t in (("<=", pos[at], at), (">", pos[-1] - pos[at], len(v) - at)):
                ok = p > 0
                gain = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(t, 1))
                                         - np.log2(p0 / (p0 + n0))), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (name, op, float(cuts[name][gain.argmax()])))
        if best[1] is None:
            break
        tests.append(best[1])
        mask &= _covers([best[1]], x, names)
    return tests


def _worth(tests, x, bad, names) -> float:
    m = _covers(tests, x, names)
    p, n = int(bad[m].sum()), int((~bad[m]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: np.ndarray, bad: np.ndarray, names: list[str], least_precision: float = 0.9,
          least_cover: int = 5, most_rules: int = 8, most_tests: int = 3,
          most_cuts: int = 64) -> list[Rule]:
    """Sequential covering. Every third row is held out to prune by; a rule
    joins the list while its precision on the held-out rows it covers, and on
    all rows left, reaches ``least_precision``."""
    rules: list[Rule] = []
    left = np.ones(len(rows), dtype=bool)
    held = np.arange(len(rows)) % 3 == 2
    cuts = {name: _cuts(rows[:, j], most_cuts) if len(rows) else np.empty(0)
            for j, name in enumerate(names)}
    while len(rules) < most_rules and bad[left].any() and (~bad[left]).any():
        g, h = left & ~held, left & held
        tests = _grow(rows[g], bad[g], names, most_tests, cuts)
        if not tests:
            break
        worth = {k: _worth(tests[:k], rows[h], bad[h], names) for k in range(1, len(tests) + 1)}
        tests = tests[:max(worth, key=lambda k: (worth[k], -k))]
        m = left & _covers(tests, rows, names)
        covered, precision = int(m.sum()), float(bad[m].mean()) if m.any() else 0.0
        unseen = m & held
        if (covered < least_cover or precision < least_precision
                or (unseen.any() and bad[unseen].mean() < least_precision)):
            break
        rules.append(Rule(tuple(tests), precision, covered))
        left &= ~m
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        label: str = "quality", label_key: str | None = None, most_rows: int = MAX_LABELLED,
        seed: int = 7, **options) -> list[Rule]:
    """Rules from at most ``most_rows`` labelled documents, in hash order (the
    bound of the broadcast and of what reaches the driver). ``quality = 0``
    rows are the bad class. Only the sampled documents are measured."""
    names = list(features())
    sample = (labels.select(F.col(label_key or key).alias("_k"), F.col(label).cast("int").alias("_y"))
              .where("_k IS NOT NULL AND _y IS NOT NULL")
              .orderBy(F.xxhash64("_k", F.lit(seed)), "_k", "_y").limit(most_rows))
    named = docs.select(F.col(key).alias("_d"), F.col(text).alias("_x"))
    rows = (statistics(named.join(F.broadcast(sample), F.col("_d") == F.col("_k")), "_x")
            .where(~base_failed())
            .select("_y", "_k", *[c.alias(f"_{n}") for n, c in features().items()])
            .orderBy(F.xxhash64("_k", F.lit(seed)), "_k", "_y", *[f"_{n}" for n in names])
            .limit(most_rows).collect())
    x = np.array([r[2:] for r in rows], dtype=float).reshape(len(rows), len(names))
    bad = np.array([r[0] == 0 for r in rows], dtype=bool)
    return learn(x, bad, names, **options)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the first rule that holds rejects."""
    values, out = features(), F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(values), F.lit(False)).otherwise(out)
    return out


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed and kept."""
    return (stats.drop("base_failed", "kept").withColumn("base_failed", base_failed())
            .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
          **options) -> DataFrame:
    """``docs`` with statistics, base_failed and kept by rules learned from
    the labelled documents among them."""
    return apply_rules(statistics(docs, text), fit(docs, labels, text, key, **options))


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
         **options) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned rules keep, with
    the columns of ``docs`` as they came."""
    names = {c: f"_in_{c}" for c in docs.columns}
    df = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    judged = judge(df, labels, names[text], names[key], label_key=key, **options)
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", *BASE, "base_failed", "kept")
