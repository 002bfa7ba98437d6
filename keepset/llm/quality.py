"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes some forty numbers (lengths, shares of kinds of
characters, repetition of words, word triples and lines). Trees are grown level
by level on histograms of binned statistics and kept as three arrays of equal
shape (statistic, cut, value at each place of a complete binary tree), so a
batch of rows walks all trees with a few array operations per level.

Labels are learned from at most ``FIT_ROWS`` rows, taken by a hash of the id;
their statistics, not their texts, come to the driver. Every row is scored
where it lies, without a shuffle.

Null texts count as empty and are scored like them. Repeated rows get equal
scores. Without any labels every score is 0.5; with one class it is that class.
Labels, language, source and id never enter the statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepset.llm.arrow import utf8
from keepset.llm.sampling import held_out, labelled_sample
from keepset.llm.store import free_name, table

FIT_ROWS = 20_000
THRESHOLD = 0.3
_SIGNS = b"!#$%&*|.,;:?'\"()-_/<>=+@{}[]\\"


def statistics(text: bytes) -> list[float]:
    """The numbers a text is judged by, from its UTF-8 bytes."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    n_words, n_lines = len(words), len(lines)
    per_byte, per_word = 1.0 / max(n, 1), 1.0 / max(n_words, 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    heads = Counter(words)
    top = heads.most_common(2)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    again = sum(a == b for a, b in zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:]))) if n_words > 2 else n_words
    line_sizes = np.fromiter(map(len, lines), dtype=np.int64, count=n_lines)
    return [
        np.log1p(n), np.log1p(n_words), np.log1p(n_lines), lengths.mean() if n_words else 0.0,
        lengths.std() if n_words else 0.0, float(lengths.max()) if n_words else 0.0,
        len(heads) * per_word, (top[0][1] if top else 0) * per_word, (top[1][1] if len(top) > 1 else 0) * per_word,
        again * per_word, triples * per_word, (lengths <= 2).sum() * per_word, (lengths > 15).sum() * per_word,
        upper * per_byte, lower * per_byte, digits * per_byte, counts[32] * per_byte, counts[0:32].sum() * per_byte,
        counts[128:].sum() * per_byte, upper / max(upper + lower, 1),
        len(set(lines)) / n_lines, line_sizes.mean(), float(line_sizes.max()), (line_sizes < 20).sum() / n_lines,
        (counts[46] + counts[33] + counts[63]) * per_word,
        *(counts[list(_SIGNS)] * per_byte),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees flattened: row t of each array is a complete binary tree."""

    feature: np.ndarray   # trees x inner places
    cut: np.ndarray       # the right child is taken above the cut
    value: np.ndarray     # trees x leaves
    start: float

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.empty(len(x))
        n_trees, inner = self.feature.shape
        trees = np.arange(n_trees)[None, :]
        for a in range(0, len(x), block):
            rows = x[a:a + block]
            place = np.zeros((len(rows), n_trees), dtype=np.int64)
            index = np.arange(len(rows))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                right = rows[index, self.feature[trees, place]] > self.cut[trees, place]
                place = 2 * place + 1 + right
            out[a:a + block] = self.start + self.value[trees, place - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
              l2: float = 1.0, min_weight: float = 1.0) -> Trees:
    """Log-loss boosting on histograms; a place that cannot gain sends every row left."""
    share = float(y.mean()) if len(y) else 0.5
    start = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if len(y) else 0.0
    inner, n, width = (1 << depth) - 1, len(y), x.shape[1] if x.ndim == 2 else 1
    feature = np.zeros((n_trees, inner), dtype=np.int32)
    cut = np.full((n_trees, inner), np.inf)
    value = np.zeros((n_trees, inner + 1))
    if share in (0.0, 1.0) or n < 2:
        return Trees(feature, cut, value, start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    raw = np.full(n, start)
    for t in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        slope, weight = y - p, p * (1 - p)
        place = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            node = place - first
            g = np.empty((width, nodes, bins))
            h = np.empty((width, nodes, bins))
            for f in range(width):
                slot = node * bins + binned[f]
                g[f] = np.bincount(slot, slope, nodes * bins).reshape(nodes, bins)
                h[f] = np.bincount(slot, weight, nodes * bins).reshape(nodes, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl)**2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < min_weight) | (ht - hl < min_weight)] = 0.0
            for f, e in enumerate(edges):
                gain[f, :, len(e):] = 0.0  # no cut above the last edge
            best = gain.transpose(1, 0, 2).reshape(nodes, -1)
            choice = best.argmax(axis=1)
            for k in range(nodes):
                if best[k, choice[k]] > 1e-9:
                    f, b = divmod(int(choice[k]), bins)
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            right = x[np.arange(n), feature[t, place]] > cut[t, place]
            place = 2 * place + 1 + right
        leaf = place - inner
        total = np.bincount(leaf, slope, inner + 1)
        value[t] = rate * total / (np.bincount(leaf, weight, inner + 1) + l2)
        raw += value[t, leaf]
    return Trees(feature, cut, value, start)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees fitted to at most ``rows`` labelled documents for which ``learn_from`` holds."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(statistics(t)).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "numbers"])

    sample = labelled_sample(docs, labels, label_col, learn_from, rows).select("text", "label")
    got = sample.mapInArrow(work, "label int, numbers binary").orderBy("numbers", "label").toPandas()
    if got.empty:
        return fit_trees(np.empty((0, len(statistics(b"")))), np.empty(0))
    return fit_trees(np.stack([np.frombuffer(b) for b in got["numbers"]]), got["label"].to_numpy(dtype=float))


def scored(df: DataFrame, trees: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with their score as one more column."""
    @F.pandas_udf("double")
    def score(column):
        import pandas as pd
        found = [statistics((t or "").encode()) for t in column]
        return pd.Series(trees.score(np.array(found, dtype=float)) if found else [], dtype=float)

    return df.withColumn(name, score(F.col(text_col)))


def quality_scores(spark, sf_dir: str) -> DataFrame:
    """``op3_quality``: a score for every document; fold 0 of 5 is never learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = fit(docs, labels, ~held_out(5, 0))
    found = scored(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose quality score reaches the threshold, all columns kept."""
    trees = fit(docs, labels, ~held_out(5, 0))
    name = free_name("score", docs.columns)
    return scored(docs, trees, name=name).where(F.col(name) >= THRESHOLD).drop(name)

