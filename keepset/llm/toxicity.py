"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters. From at most ``FIT_ROWS`` labelled documents, words and word beginnings
   that mark the label, by presence or by being frequent, are mined; each is a voter, next to fixed pattern voters
   (shouting, exclamation marks, symbols between letters, digits in words).
2. Label model. Whether each voter fires is a bit; a document is a vector of bits.
   A hidden class explains them: per class, each voter's rate given one other
   voter (a tree over the voters with the most mutual information, so correlated
   voters do not count twice). Expectation-maximisation over the vote vectors
   of all documents estimates rates and correlations, starting from the labelled
   rows, which stay in as counts. Only sums over pairs of voters reach the driver.
3. Classifier. A logistic model over the presence of hashed words and word beginnings with
   an L1 penalty (the units that keep a weight are then named), fitted to the label model's posteriors of the sampled documents.

Every document is scored whole, where it lies. Null texts count as empty and get
the score of a text without words. Without labels of both classes every score is
the share of label 1 (0 when there is none). Labels, language, source and id never
enter a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepset.llm.arrow import texts
from keepset.llm.sampling import held_out, labelled_sample
from keepset.llm.store import stored, table

FIT_ROWS = 12_000
CANDIDATES = 20_000
MINED_VOTERS = 48
ROUNDS = 5
THRESHOLD = 0.3
HASH_BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
DENSE_WORDS = 250
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][*#@$%&]+[^\W\d_]")
_DIGITS = re.compile(r"[^\W\d_]\d+[^\W\d_]")


def _runs_of_four(text: str) -> int:
    a = np.frombuffer(text.encode(), dtype=np.uint8)
    same = a[1:] == a[:-1]
    return int((same[2:] & same[1:-1] & same[:-2] & (a[:-3] > 64)).sum()) if len(a) > 3 else 0


#: Pattern voters: fire when found at least so often per word.
PATTERNS = [("shouting", lambda t: sum(map(str.isupper, t.split())), 0.2), ("exclaiming", lambda t: t.count("!"), 0.1),
            ("masked", lambda t: len(_MASKED.findall(t)) if any(c in t for c in "*#@$%&") else 0, 0.02),
            ("digits inside", lambda t: len(_DIGITS.findall(t)) if any(c in t for c in "0123456789") else 0, 0.02),
            ("single letters", lambda t: sum(len(w) == 1 for w in t.split()), 0.2), ("repeated letters", _runs_of_four, 0.01)]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(word: str) -> list[str]:
    """A word and its beginnings; a star marks a beginning."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def dense(n: int, of: int) -> bool:
    """Whether n of so many words are many: then the unit counts once more, with a plus."""
    return n >= 2 and n * DENSE_WORDS >= of


def _all_units(text: str) -> set[str]:
    found = words(text)
    counts = Counter()
    for w, n in Counter(found).items():
        for u in units(w):
            counts[u] += n
    return counts.keys() | {u + "+" for u, n in counts.items() if dense(n, len(found))}


class Lookup:
    """Which of the wanted units a text holds; most words are set aside by their first four letters."""

    def __init__(self, wanted: Iterable[str]):
        self.wanted = frozenset(wanted)
        self.plain = frozenset(u.rstrip("+") for u in self.wanted)
        self.heads = frozenset(u.rstrip("*")[:4] for u in self.plain)

    def __call__(self, found: list[str]) -> set[str]:
        counts: dict[str, int] = {}
        heads, plain = self.heads, self.plain
        for w in found:
            if w[:4] in heads:
                for u in units(w):
                    if u in plain:
                        counts[u] = counts.get(u, 0) + 1
        held = counts.keys() | {u + "+" for u, n in counts.items() if dense(n, len(found))}
        return held & self.wanted


@dataclass(frozen=True)
class Voters:
    """Bit i of a vote is set when unit i occurs; the patterns take the last bits."""

    names: tuple[str, ...]

    def __len__(self) -> int:
        return len(self.names) + len(PATTERNS)

    def ballot(self):
        """The function from a text to its vote."""
        place, lookup = {u: i for i, u in enumerate(self.names)}, Lookup(self.names)

        def vote(text: str) -> int:
            found = words(text)
            mask = sum(1 << place[u] for u in lookup(found))
            least = max(len(found), 5)
            for i, (_, count, share) in enumerate(PATTERNS):
                if count(text) >= share * least:
                    mask |= 1 << len(self.names) + i
            return mask

        return vote


def mine_voters(sample: DataFrame) -> Voters:
    """Units frequent in label-1 documents of the sample and rare in the others.

    Two passes over the sample: units of the label-1 rows (the ``CANDIDATES``
    most frequent), then their counts in the other rows. A unit that a chosen
    beginning already covers is skipped.
    """
    def count(candidates: frozenset | None):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Counter()
            for batch in batches:
                for t in texts(batch.column("text")):
                    found = _all_units(t)
                    held.update(found if candidates is None else found & candidates)
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             ["unit", "n"])
        return work

    def counted(label: int, candidates, least: int) -> dict[str, int]:
        rows = (sample.where(F.col("label") == label).select("text").mapInArrow(count(candidates), "unit string, n long")
                .groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
                .orderBy(F.desc("n"), "unit").limit(CANDIDATES).collect())
        return {r["unit"]: r["n"] for r in rows}

    n_all = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = n_all.get(1, 0), n_all.get(0, 0)
    if not n_pos or not n_neg:
        return Voters(())
    pos = counted(1, None, max(2, n_pos // 500))
    neg = counted(0, frozenset(pos), 1)

    def weight(u):
        p, q = (pos[u] + 0.5) / (n_pos + 1), (neg.get(u, 0) + 0.5) / (n_neg + 1)
        return pos[u] * np.log(p / q)

    good = [u for u in pos if pos[u] / n_pos > 20 * (neg.get(u, 0) + 0.5) / (n_neg + 1)]
    chosen: dict[str, str] = {}  # unit of each stem
    for u in sorted(good, key=lambda u: (-weight(u), -len(u), u)):
        stem = u.rstrip("*+")
        if not any(stem.startswith(c) or c.startswith(stem) and pos[u] <= 1.1 * pos[chosen[c]] for c in chosen):
            chosen[stem] = u
        if len(chosen) == MINED_VOTERS:
            break
    return Voters(tuple(chosen.values()))


@dataclass
class LabelModel:
    """Class-conditional tree over binary voters; arrays are indexed [class]."""

    prior: float
    parent: np.ndarray  # of each voter, -1 at the root
    rate: np.ndarray    # [class, state of the parent, voter]: probability to fire

    @classmethod
    def of(cls, pairs: np.ndarray, sizes: np.ndarray) -> LabelModel:
        """From expected counts: ``pairs[class, i, j]`` fired together, ``sizes[class]`` documents."""
        k, total = pairs.shape[1], sizes.sum()
        information = np.zeros((k, k))
        for c in (0, 1):
            n = sizes[c] + 2.0
            one = (np.diagonal(pairs[c]) + 1.0) / n
            for a in (0, 1):
                for b in (0, 1):
                    both = pairs[c]
                    single = np.diagonal(pairs[c])
                    joint = both if a and b else single[:, None] - both if a else single[None, :] - both if b else \
                        sizes[c] - single[:, None] - single[None, :] + both
                    joint = (np.maximum(joint, 0) + 0.5) / n
                    apart = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
                    information += n / max(total, 1) * joint * np.log(joint / apart)
        parent, seen = np.full(k, -1), [0]
        best, source = information[0].copy(), np.zeros(k, dtype=int)
        while len(seen) < k:
            best[seen] = -np.inf
            j = int(np.argmax(best))
            parent[j] = source[j]
            seen.append(j)
            better = information[j] > best
            best, source = np.where(better, information[j], best), np.where(better, j, source)
        rate = np.empty((2, 2, k))
        for c in (0, 1):
            fired = np.diagonal(pairs[c])
            with_parent = np.where(parent >= 0, pairs[c][np.arange(k), parent], 0.0)
            n_parent = np.where(parent >= 0, fired[parent], 0.0)
            overall = (fired + 0.5) / (sizes[c] + 1.0)
            rate[c, 1] = (with_parent + 2 * overall) / (n_parent + 2)
            rate[c, 0] = (np.maximum(fired - with_parent, 0) + 2 * overall) / (np.maximum(sizes[c] - n_parent, 0) + 2)
        return cls(float((sizes[1] + 0.5) / (total + 1)), parent, np.clip(rate, 1e-7, 1 - 1e-7))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of a 0/1 matrix."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(np.int64)
        place = np.arange(votes.shape[1])
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for c, sign in ((1, 1.0), (0, -1.0)):
            p = self.rate[c][above, place]
            odds += sign * np.log(np.where(votes > 0, p, 1 - p)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def bits(masks: np.ndarray, k: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(k)) & 1


def _pair_sums(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return (votes * weight[:, None]).T @ votes


def fit_label_model(votes: DataFrame, labelled: DataFrame, k: int, rounds: int = ROUNDS) -> LabelModel:
    """EM over ``votes`` (mask, n), anchored by ``labelled`` (mask, label, n).

    A round is one pass over the distinct vote vectors; 2 k (k + 1) sums, folded
    per partition and by key, come to the driver.
    """
    def totals(df: DataFrame, classes) -> tuple[np.ndarray, np.ndarray]:
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, k * k + 1))
            for batch in batches:
                masks = batch.column("mask").to_numpy()
                for a in range(0, len(masks), 4096):
                    n = batch.column("n").to_numpy()[a:a + 4096].astype(float)
                    v = bits(masks[a:a + 4096], k).astype(float)
                    one = classes(v, batch.slice(a, 4096))
                    for c, w in ((0, n * (1 - one)), (1, n * one)):
                        sums[c, :-1] += _pair_sums(v, w).reshape(-1)
                        sums[c, -1] += w.sum()
            flat = sums.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "x"])

        rows = df.mapInArrow(work, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(2 * (k * k + 1))
        for r in rows:
            flat[r["at"]] = r["x"]
        flat = flat.reshape(2, -1)
        return flat[:, :-1].reshape(2, k, k), flat[:, -1]

    known = totals(labelled, lambda v, batch: batch.column("label").to_numpy().astype(float))
    model = LabelModel.of(*known)
    for _ in range(rounds):
        pairs, sizes = totals(votes, lambda v, batch, m=model: m.posterior(v))
        model = LabelModel.of(pairs + known[0], sizes + known[1])
    return model


def slot(unit: str) -> int:
    return zlib.crc32(unit.encode()) & (1 << HASH_BITS) - 1


def fit_linear(rows: list[np.ndarray], target: np.ndarray, *, rate: float = 0.3, l1: float = 4.0, l2: float = 0.5,
               epochs: int = 6) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression on the presence of hashed units; targets are probabilities.

    Follow-the-regularised-leader: every unit has its own step length, and a
    weight stays zero until its summed slopes exceed the penalty.
    """
    size, n = 1 << HASH_BITS, len(rows)
    share = float(np.clip(target.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    total, squares, bias_squares = np.zeros(size), np.zeros(size), 0.0

    def weight(total, squares):
        return -np.sign(total) * np.maximum(np.abs(total) - l1, 0) / ((1 + np.sqrt(squares)) / rate + l2)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(n):
            at = rows[i]
            z, q = total[at], squares[at]
            w = weight(z, q)
            slope = 1 / (1 + np.exp(-min(max(bias + w.sum(), -30.0), 30.0))) - target[i]
            total[at] = z + slope - (np.sqrt(q + slope * slope) - np.sqrt(q)) / rate * w
            squares[at] = q + slope * slope
            bias_squares += slope * slope
            bias -= 0.05 * slope / (1 + np.sqrt(bias_squares))
    return weight(total, squares).astype(np.float32), bias


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]  # of units
    bias: float

    def scorer(self):
        """The function from a text to its score."""
        lookup = Lookup(self.weights)

        def score(text: str) -> float:
            total = self.bias + sum(self.weights[u] for u in sorted(lookup(words(text))))
            return float(1 / (1 + np.exp(-min(max(total, -30.0), 30.0))))

        return score


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic", rows: int = FIT_ROWS) -> Classifier:
    """The three steps; see the top of the module."""
    sample = stored(labelled_sample(docs, labels, label_col, learn_from, rows), "toxicity-sample")
    voters = mine_voters(sample)
    if not voters.names:
        share = sample.agg(F.avg("label")).first()[0] or 0.0
        odds = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Classifier({}, odds)
    k = len(voters)

    @F.pandas_udf("long")
    def votes(column: pd.Series) -> pd.Series:
        vote = voters.ballot()
        return pd.Series([vote(t or "") for t in column], dtype="int64")

    cast = stored(docs.select(votes("text").alias("mask")).groupBy("mask").agg(F.count("*").alias("n")), "toxicity-votes")
    known = sample.select(votes("text").alias("mask"), "label").groupBy("mask", "label").agg(F.count("*").alias("n"))
    model = fit_label_model(cast, known, k)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = voters.ballot()
        for batch in batches:
            found = list(texts(batch.column("text")))
            masks = np.array([vote(t) for t in found], dtype=np.int64)
            target = model.posterior(bits(masks, k)) if len(masks) else np.empty(0)
            units_of = [np.array(sorted({slot(u) for u in _all_units(t)}), dtype=np.int32).tobytes() for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.float64()), pa.array(units_of, pa.binary())], ["target", "units"])

    got = sample.select("text").mapInArrow(work, "target double, units binary").toPandas().sort_values(["target", "units"])
    weights, bias = fit_linear([np.frombuffer(b, dtype=np.int32) for b in got["units"]], got["target"].to_numpy())
    used = frozenset(np.flatnonzero(weights).tolist())

    def names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {u for t in texts(batch.column("text")) for u in _all_units(t) if slot(u) in used}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["unit"])

    found = sample.select("text").mapInArrow(names, "unit string").distinct().collect()  # units of the bounded sample
    return Classifier({r["unit"]: float(weights[slot(r["unit"])]) for r in found}, bias)


def scored(df: DataFrame, model: Classifier, text_col: str = "text", name: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        score_of = model.scorer()
        return pd.Series([score_of(t or "") for t in column], dtype=float)

    return df.withColumn(name, score(F.col(text_col)))


def toxicity_scores(spark, sf_dir: str) -> DataFrame:
    """``op2_toxicity``: a score for every document; fold 2 of 4 is never learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out(4, 2))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
