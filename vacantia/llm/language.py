"""Language identification by mixture inference.

Every word has a likelihood under each language, from its byte trigrams (blanks at both ends).
A document is a mixture: expectation-maximisation over its words estimates how much of it is in
each language. Nested sets of its likeliest languages, of any size, are fitted and the one with the
best penalised likelihood (half a log of the word count for each further language) is its language set.

Trigram counts cover all training rows: map tasks count densely, the counts are summed by
(language, trigram) with map-side combining, and the model (one table of 2^16 numbers for each
language label, MAX_LANGUAGES of them) is the only thing that reaches the driver.

A text of any length is inferred as a whole in bounded memory: beyond ``LONG_BYTES`` its words are
taken run by run, once for every step, and the sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, edges_of, held_out, materialize

BITS = 16
SMOOTHING = 0.5
EM_STEPS = 12
#: Labels of a model: with more the labels are no languages, and the fit says so instead of filling the driver.
MAX_LANGUAGES = 1024
#: Labels whose counts a map task holds before it hands them on (half a megabyte each).
HELD_LABELS = 64
#: Bytes of a text from which its words are taken in runs of about this size.
LONG_BYTES = 1 << 20
#: EM steps for each nested set; the full fit gives the starting point.
SET_STEPS = 6
#: What a set's likelihood may exceed its bound by, for sums in single precision.
SLACK = 1.0
#: A word's likelihoods under two languages differ by this factor (log) at most, so that one
#: odd word (a name, a link) decides nothing.
WORD_RANGE = 12.0

#: Letters: a-z with A-Z lowered, and all bytes from 0x80; anything else is a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def word_trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram code of every letter (with its neighbours), each word's first code, each word's row."""
    folded = _FOLD[data]
    letter = folded != 32
    starts, ends, row = edges_of(letter, offsets)
    padded = np.full(len(data) + 2, 32, np.uint32)
    padded[1:-1] = folded
    before, after = padded[:-2].copy(), padded[2:].copy()
    before[starts], after[ends - 1] = 32, 32
    code = ((before << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | after) * np.uint32(0x9E3779B1)
    length = ends - starts
    return (code >> np.uint32(32 - BITS))[letter].astype(np.int32), np.cumsum(length) - length, row


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, code, n over all rows of ``docs`` whose lang is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def counted():
            for name, count in held.items():
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(count[used].astype(np.int64))], ["lang", "code", "n"])
            held.clear()

        for rows, data, offsets in blocks(batches):
            if len(held) > HELD_LABELS:
                yield from counted()
            code, first, row = word_trigrams(data, offsets)
            per_letter = np.repeat(row, np.diff(np.append(first, len(code))))
            names = rows.column(0).dictionary_encode()
            mine = names.indices.to_numpy(zero_copy_only=False)[per_letter] if len(code) else np.zeros(0, int)
            for k, name in enumerate(names.dictionary.to_pylist()):
                held[name] = held.get(name, 0) + np.bincount(code[mine == k], minlength=1 << BITS)
        yield from counted()

    known = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    return known.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Language names and log likelihoods of the trigram codes, one row a language."""

    names: list[str]
    logs: np.ndarray

    def bytes_of(self, most: int) -> int:
        """Bytes of text to take at a time: a word has a number for each language, so fewer where there are more than eight."""
        return max(1, most * 8 // max(8, len(self.names)))

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (rows x languages; zero outside the chosen set) and the number of words."""
        n, k = len(offsets) - 1, len(self.names)
        if n == 1 and len(data) > self.bytes_of(LONG_BYTES) and k:
            return self._long(data)
        code, first, row = word_trigrams(data, offsets)
        words = np.bincount(row, minlength=n)
        pi = np.full((n, max(k, 1)), 1.0 / max(k, 1))
        if not len(row) or not k:
            return pi * 0, words
        p = self._likelihoods(code, first)
        some = words > 0
        at = np.cumsum(words[some]) - words[some]
        pi = self._em(p, pi[some].astype(np.float32), words[some], at, EM_STEPS)
        order = np.argsort(-pi, 1, kind="stable")
        best = np.full(len(pi), -np.inf)
        chosen = pi.copy()
        count, rows = words[some], np.arange(len(pi))
        limit, penalty = self._limit(p, pi, count, at), 0.5 * np.log(count)
        for size in range(1, k + 1):
            # a row goes on while a set of this size or a larger one could still win
            live = limit[rows] + SLACK - size * penalty[rows] > best[rows]
            if not live.any():
                break
            if not live.all():
                p, rows = p[np.repeat(live, count[rows])], rows[live]
                at = np.cumsum(count[rows]) - count[rows]
            mask = np.zeros((len(rows), k), np.float32)
            np.put_along_axis(mask, order[rows, :size], 1, 1)
            fit = pi[rows] * mask
            fit /= np.maximum(fit.sum(1, keepdims=True), 1e-30)
            if size > 1:
                fit = self._em(p, fit, count[rows], at, SET_STEPS)
            seen = np.log(np.maximum((p * np.repeat(fit, count[rows], 0)).sum(1), 1e-30))
            value = np.add.reduceat(seen, at) - size * penalty[rows]
            better = value > best[rows]
            best[rows[better]], chosen[rows[better]] = value[better], fit[better]
        out = np.zeros((n, k))
        out[some] = chosen
        return out, words

    def _likelihoods(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word, relative to its likeliest language."""
        ll = np.stack([np.add.reduceat(self.logs[j][code], first) for j in range(len(self.names))], 1)
        ll -= ll.max(1, keepdims=True)
        return np.exp(np.maximum(ll, -WORD_RANGE)).astype(np.float32)

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``mixtures`` of one long text, its words in runs that end at blanks."""
        k, n, cuts, most = len(self.names), len(data), [0], self.bytes_of(LONG_BYTES)
        while cuts[-1] < n:
            at = min(cuts[-1] + most, n)
            while at < n and _FOLD[data[at]] != 32:  # a word is never cut
                step = np.flatnonzero(_FOLD[data[at : at + most]] == 32)
                at = at + int(step[0]) if len(step) else min(at + most, n)
            cuts.append(at)

        def runs():
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                code, first, _ = word_trigrams(data[lo:hi], np.array([0, hi - lo]))
                if len(first):
                    yield self._likelihoods(code, first)

        words = sum(len(p) for p in runs())
        if not words:
            return np.zeros((1, k)), np.zeros(1, np.int64)

        def em(pi: np.ndarray, steps: int) -> np.ndarray:
            for _ in range(steps):
                total = np.zeros(k)
                for p in runs():
                    share = p * pi
                    share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
                    total += share.sum(0, dtype=np.float64)
                pi = (total / words).astype(np.float32)
            return pi

        pi = em(np.full(k, 1 / k, np.float32), EM_STEPS)
        mixed = [np.maximum(p @ pi, 1e-30) for p in runs()]
        gain = sum((p / m[:, None]).sum(0, dtype=np.float64) for p, m in zip(runs(), mixed)).max() / words
        limit, penalty = sum(float(np.log(m).sum(dtype=np.float64)) for m in mixed) + words * np.log(max(gain, 1.0)), 0.5 * np.log(words)
        order, best, chosen = np.argsort(-pi, kind="stable"), -np.inf, pi
        for size in range(1, k + 1):
            if limit + SLACK - size * penalty <= best:
                break
            fit = np.zeros(k, np.float32)
            fit[order[:size]] = pi[order[:size]]
            fit /= max(fit.sum(), 1e-30)
            fit = em(fit, SET_STEPS) if size > 1 else fit
            value = sum(float(np.log(np.maximum(p @ fit, 1e-30)).sum(dtype=np.float64)) for p in runs()) - size * penalty
            if value > best:
                best, chosen = value, fit
        return chosen[None, :].astype(np.float64), np.array([words])

    @staticmethod
    def _limit(p: np.ndarray, pi: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log likelihood that no mixture of a row's words exceeds.

        It is concave in the proportions: by Jensen's inequality the gain over ``pi`` is at most
        words * log(max over languages of the mean of p / mixture).
        """
        mixed = np.maximum((p * np.repeat(pi, words, 0)).sum(1), 1e-30)
        gain = np.add.reduceat(p / mixed[:, None], at, 0).max(1) / words
        return np.add.reduceat(np.log(mixed), at) + words * np.log(np.maximum(gain, 1.0))

    @staticmethod
    def _em(p: np.ndarray, pi: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            share = p * np.repeat(pi, words, 0)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
            pi = np.add.reduceat(share, at, 0) / words[:, None].astype(np.float32)
        return pi


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter: a-z, A-Z, or (looked up only where there is none of these) any other."""
    count = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 128))])
    out = count[offsets[1:]] > count[offsets[:-1]]
    left = np.flatnonzero(~out & (np.diff(offsets) > 0))
    if len(left):
        texts = pa.array([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in left], pa.string())
        out[left] = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    return out


def _logs(group: pa.Table) -> pa.Table:
    """One label's log likelihoods from its counts (a row a code, so 2^16 at most)."""
    count = np.full(1 << BITS, SMOOTHING)
    count[group.column("code").to_numpy()] += group.column("n").to_numpy()
    return pa.table({"lang": group.column("lang")[:1], "logs": pa.array([np.log(count / count.sum()).astype(np.float32).tobytes()], pa.binary())})


def fit(docs: DataFrame) -> Model:
    """Model of all languages that label a row of ``docs``; no labels: no languages. Over MAX_LANGUAGES labels: ValueError."""
    counts = materialize(trigram_counts(docs))
    if counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} labels")
    found = counts.groupBy("lang").applyInArrow(_logs, "lang string, logs binary").collect()  # 256 KB a label
    found.sort(key=lambda r: r.lang)
    names, logs = [r.lang for r in found], np.zeros((len(found), 1 << BITS), np.float32)
    for j, r in enumerate(found):
        logs[j] = np.frombuffer(r.logs, np.float32)
    return Model(names, logs)


def infer(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), langs (the chosen set with proportions), n_words.

    ``und`` with score 0 and no langs where the text is null or has no letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, data, offsets in blocks(batches, limit=m.bytes_of(BLOCK_BYTES)):
            share, words = m.mixtures(data, offsets)
            top = share.argmax(1)
            score = share[np.arange(len(top)), top]
            found = (words > 0) & (len(m.names) > 0) & _has_letter(data, offsets)
            langs = [" ".join(f"{m.names[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] >= 0.0005) if f else "" for s, f in zip(share, found)]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([m.names[j] if f else "und" for j, f in zip(top, found)], pa.string()),
                pa.array(np.where(found, np.clip(score, 0, 1), 0.0), pa.float64()), pa.array(langs, pa.string()), pa.array(words.astype(np.int64)),
            ], ["doc_id", "lang_pred", "score", "langs", "n_words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, langs string, n_words long")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, infer all: doc_id, held_out, lang_pred, score, langs, n_words."""
    found = infer(docs, fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs", "n_words")
