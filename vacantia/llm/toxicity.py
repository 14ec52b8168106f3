"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed words of a
text: the pairwise part learns that two terms together (an insult and a group) mean more than
the sum of both, which additive weights cannot express.

A term enters the machine when the label depends on it (log-likelihood ratio), or on its being there
together with another term, more than on either of the two: so a pair whose parts tell nothing by
themselves is learnt too. Pairs are counted over the whole sample, in blocks of terms.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` rows a class and
``SAMPLE_TERMS`` terms a class, chosen by hash of the id, so the same at every run), everything else
covers all rows. Scoring is one Arrow pass over the table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_WORD, Hasher, blocks, doc_crc, edges_of, held_out, lean, materialize, release

#: Bounds on the labelled rows that the fit uses, for each class: rows, and distinct terms of those rows (4 bytes each) in all.
SAMPLE_PER_CLASS, SAMPLE_TERMS = 6000, 1 << 23
BITS = 20
FACTORS = 8
MIN_DF = 5
#: Share of the toxic rows that a term must be in for its pairs to be counted (MIN_DF rows at least), and terms in a block of pairs.
PAIR_SHARE, PAIR_TERMS = 0.03, 256
#: Log-likelihood ratio (chi-square, 1 degree of freedom) under which a term, or what a pair adds to its terms, is taken as noise.
MIN_LLR = 10.83
#: Lengths in bytes of the word stems that are terms besides the words.
STEMS = (4, 5)
THRESHOLD = 0.7


@dataclass
class Machine:
    """bias, and for each hashed term its row in ``w`` and ``v`` (row 0: not in the model)."""

    bias: float
    row: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, term = terms(data, offsets)
        at = self.row[term]
        doc, at = doc[at > 0], at[at > 0]
        linear = np.bincount(doc, self.w[at], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            pairs += np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n)
        return sigmoid(self.bias + linear + 0.5 * pairs)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


_hasher = None


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed term) pairs of a block of text: lower-cased words, and word stems.

    A stem is a word's first 4 or 5 bytes (of longer words), so that inflected forms of one
    insult share evidence.
    """
    global _hasher
    _hasher = _hasher or Hasher()
    starts, ends, row = edges_of(IS_WORD[data], offsets)
    sums = _hasher.sums(data)
    rows, hashes = [row], [_hasher.runs(sums, starts, ends)]
    for n in STEMS:
        longer = ends - starts > n
        rows.append(row[longer])
        hashes.append(_hasher.runs(sums, starts[longer], starts[longer] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    key = np.unique((np.concatenate(rows).astype(np.int64) << BITS) | (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The bounded labelled sample: doc_id, toxic, text. Rows of the held-out third never enter.

    Labels of one id count as toxic if one of them is; labels without a document are left out before the
    sample is taken. Rows that share a sampled id are all training rows with its label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id")), F.col("doc_id")
    picked = [known.filter(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    # at most 2 * per_class rows of two numbers: a bound that holds at every size of the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out())
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        doc, term = terms(data, offsets)
        cuts = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        term = term.astype(np.int32)
        packed = [term[cuts[i] : cuts[i + 1]].tobytes() for i in range(rows.num_rows)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(packed, pa.binary())], ["doc_id", "toxic", "terms"])


def bounded(rows: DataFrame, most: int = SAMPLE_TERMS) -> DataFrame:
    """Training rows (doc_id, toxic, terms) of each class, in the sample's order, as far as their terms add up to ``most``.

    The window sees the sample's ids and counts only: at most SAMPLE_PER_CLASS rows a class.
    """
    sizes = rows.select("doc_id", "toxic", F.expr("octet_length(terms) div 4").alias("n")).groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    kept = sizes.withColumn("so_far", F.sum("n").over(ahead)).filter(F.col("so_far") <= most).select("doc_id")
    return rows.join(kept, "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, seed: int = 3) -> Machine:
    """Train on the bounded sample. Copies of a text count once. No labels: every score is 0.5 or less."""
    rows = materialize(training_rows(docs, labels, per_class).mapInArrow(lean(_features), "doc_id long, toxic int, terms binary"))
    try:
        return train(bounded(rows).toPandas(), seed)
    finally:
        release()  # the driver lives on through other stages


def train(rows: pd.DataFrame, seed: int = 3) -> Machine:
    """The machine of training rows: doc_id, toxic, terms (int32)."""
    rows = rows.sort_values(["doc_id", "terms"]).drop_duplicates("terms")
    rows = rows.sample(frac=1.0, random_state=seed)
    y = rows.toxic.to_numpy(np.float64)
    sets = [np.frombuffer(x, np.int32) for x in rows.terms]
    size = 1 << BITS
    empty = Machine(-2.0, np.zeros(size, np.int32), np.zeros(1), np.zeros((1, FACTORS)))
    if not len(y) or y.min() == y.max():
        return empty
    chosen = telling_terms(sets, y)
    row = np.zeros(size, np.int32)
    row[chosen] = np.arange(1, len(chosen) + 1)
    kept = [x[x > 0] for x in map(row.__getitem__, sets)]
    flat = np.concatenate(kept)
    doc = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    bias, w, v = _train(doc, flat, y, len(chosen) + 1, seed)
    return Machine(bias, row, w, v)


def telling_terms(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms on which the label depends, alone or in pairs; each set is distinct, y has both classes.

    Rows are counted one by one: what is held at once is the sample and a byte for each row and common term.
    """
    size, n_pos, n_neg = 1 << BITS, y.sum(), len(y) - y.sum()
    pos, neg = np.zeros(size), np.zeros(size)
    for terms_, label in zip(sets, y):
        (pos if label else neg)[terms_] += 1
    own, used = np.zeros(size), np.flatnonzero(pos + neg)
    own[used] = _llr(pos[used], neg[used], n_pos, n_neg)
    alone = np.flatnonzero((pos + neg >= MIN_DF) & (own >= MIN_LLR))
    least = max(MIN_DF, PAIR_SHARE * n_pos)
    common = np.flatnonzero(pos >= least)
    if len(common) < 2:
        return alone
    number = np.full(size, -1, np.int32)
    number[common] = np.arange(len(common))
    side = [np.zeros((int(n), len(common)), np.uint8) for n in (n_pos, n_neg)]
    filled = [0, 0]
    for terms_, label in zip(sets, y):
        at, k = number[terms_], 0 if label else 1
        side[k][filled[k], at[at >= 0]] = 1
        filled[k] += 1
    # as many pairs are tried, the ratio that chance reaches grows by twice the log of their number
    noise, own, joined = MIN_LLR + 2 * np.log(len(common) ** 2 / 2), own[common], np.zeros(len(common), bool)
    for a in range(0, len(common), PAIR_TERMS):
        left = [x[:, a : a + PAIR_TERMS].astype(np.float32) for x in side]
        for b in range(a, len(common), PAIR_TERMS):
            both = [x.T @ z[:, b : b + PAIR_TERMS].astype(np.float32) for x, z in zip(left, side)]
            i, j = np.nonzero((both[0] >= least) & (both[0] * n_neg > both[1] * n_pos))
            i, j = i[i + a < j + b], j[i + a < j + b]
            pair = _llr(both[0][i, j].astype(float), both[1][i, j].astype(float), n_pos, n_neg)
            tells = (pair >= noise) & (pair >= np.maximum(own[i + a], own[j + b]) + MIN_LLR)
            joined[i[tells] + a] = joined[j[tells] + b] = True
    return np.union1d(alone, common[joined])


def _llr(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    def part(k, n, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / n / p), 0.0)

    p = np.clip((pos + neg) / (n_pos + n_neg), 1e-12, 1 - 1e-12)
    return 2 * (part(pos, n_pos, p) + part(n_pos - pos, n_pos, 1 - p) + part(neg, n_neg, p) + part(n_neg - neg, n_neg, 1 - p))


def _train(doc: np.ndarray, term: np.ndarray, y: np.ndarray, size: int, seed: int, epochs: int = 30, batch: int = 256, rate: float = 0.15, decay: float = 2e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss; ``doc`` is sorted, each epoch walks the shuffled rows in batches, a step touches its batch's terms."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)), 0.0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    cuts = np.searchsorted(doc, np.arange(0, len(y) + batch, batch))
    parts = [(b * batch, *np.unique(term[lo:hi], return_inverse=True), doc[lo:hi] - b * batch) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if b * batch < len(y)]
    for _ in range(epochs):
        for b in rng.permutation(len(parts)):
            first, used, t, d = parts[b]
            n = min(batch, len(y) - first)
            mine = v[used]
            x = mine[t]
            sums = np.stack([np.bincount(d, x[:, f], n) for f in range(FACTORS)], 1)
            squares = np.bincount(d, (x * x).sum(1), n)
            z = bias + np.bincount(d, w[used][t], n) + 0.5 * ((sums * sums).sum(1) - squares)
            err = (sigmoid(z) - y[first : first + n]) / n
            g = np.bincount(t, err[d], len(used)) + decay * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            grad = (sums[d] - x) * err[d][:, None]
            g = np.stack([np.bincount(t, grad[:, f], len(used)) for f in range(FACTORS)], 1) + decay * mine
            gv[used] += g * g
            v[used] -= 0.3 * rate * g / np.sqrt(gv[used])
            g = err.sum()
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    w[0], v[0] = 0.0, 0.0
    return float(bias), w, v


def with_score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text (null or empty: the score of no term)."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            yield from scored(texts)
        finally:
            release()

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(part, pa.string(), from_pandas=True)], ["text"])
            found = [model.value.scores(data, offsets) for _, data, offsets in blocks([batch])]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(column, score(F.col("text")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.7)."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


__all__ = ["Machine", "fit", "score_documents", "training_rows", "with_score", "doc_crc"]
