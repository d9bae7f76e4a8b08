"""Quality classifier by supervised subword embeddings (5).

A document's features are its words, as written, the 3- to 5-grams of its UTF-8 bytes that do not reach
across a blank, each hashed to one of ``BUCKETS`` learned vectors, and one for a word that repeats the
word before. Their average goes through a
softmax over the two classes. Vectors and weights are trained by numpy stochastic gradient descent, one
document a step, on at most ``fit_docs`` labelled documents of each class (those with the smallest hash
of their id, whole texts), in one task.

To score, each bucket's vector is reduced to the one number that it adds to the difference of the two
logits, so a document costs a table lookup per feature. Texts are hashed column by column, in slices;
nothing is shuffled.

Defined results: every document has one feature for its end, so null and empty texts have a score (that
feature's). Without labels, or with those of one class only, the model says 0.5 or nearly that class.
Labels other than 0 and 1 and null ids of labels do not count; an id on several rows gives one example.
Repeated rows are scored each, and without rows there are no scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import fit_in_one_task, sampled_texts, unused
from gridpulse.llm.textbytes import SLICE, SOLID, cuts, groups, hash_words, text_bytes

BITS = 15
BUCKETS, DIM, GRAMS = 1 << BITS, 16, (3, 4, 5)
END, AGAIN = 0, 1  # buckets of a document's end and of a word that repeats the one before
FIT_DOCS, EPOCHS, RATE = 1500, 8, 2.0
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PART = SLICE // 4  # bytes of short texts that are taken together; their features take much memory
ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _grams(data: np.ndarray, n_starts: int, breaks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: the bucket at every start, and whether there is one. ``data`` may go on
    after the last start; an n-gram never reaches across one of ``breaks`` or the end."""
    solid = SOLID[data]
    inner = solid != 0
    terms = [solid.astype(np.uint32) * f for f in ODD[: max(GRAMS)]]
    for n in GRAMS:
        m = min(n_starts, len(data) - n + 1)
        if m <= 0:
            continue
        h, valid = terms[0][:m].copy(), np.ones(m, bool)
        for k in range(1, n):
            h += terms[k][k : k + m]
            if k < n - 1:
                valid &= inner[k : k + m]
        for k in range(1, n):
            at = breaks - k
            valid[at[(at >= 0) & (at < m)]] = False
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D + 2 * n)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32), valid


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts (first, after the last) with the buckets of some of their features and the number of
    the text that each belongs to. A long text comes in several slices."""
    data, offsets = text_bytes(column)
    for i, j in groups(offsets, PART):
        a, b = int(offsets[i]), int(offsets[j])
        alone = j == i + 1
        for s, e in cuts(data[a:b], SOLID) if alone and b - a > SLICE else [(0, b - a)]:
            breaks = np.zeros(0, np.int64) if alone else offsets[i + 1 : j] - a
            own = data[a + s : a + e]
            start, word = hash_words(own, breaks, SOLID)
            again = np.flatnonzero(word[1:] == word[:-1]) + 1
            if len(breaks):  # not across documents
                text = np.searchsorted(breaks, start, "right")
                again = again[text[again] == text[again - 1]]
            buckets = [(word >> np.uint64(64 - BITS)).astype(np.int32), np.full(len(again), AGAIN, np.int32)]
            places = [start, start[again]]
            for bucket, valid in _grams(data[a + s : min(b, a + e + max(GRAMS) - 1)], e - s, breaks):
                at = np.flatnonzero(valid)
                buckets.append(bucket[at])
                places.append(at)
            place = np.concatenate(places)
            yield i, j, np.concatenate(buckets), np.zeros(len(place), np.int64) if alone else np.searchsorted(breaks, place, "right")


def train(buckets: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, seed: int = 11) -> np.ndarray:
    """What each bucket adds to logit 1 less logit 0, when its document's features are averaged."""
    random = np.random.default_rng(seed)
    vectors = ((random.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    weights = np.zeros((2, DIM), np.float32)
    share = [(c / c.sum()).astype(np.float32) for c in counts]
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for d in random.permutation(len(y)):
            at, s = buckets[d], share[d]
            hidden = s @ vectors[at]
            z = weights @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = weights.T @ p
            weights -= rate * np.outer(p, hidden)
            vectors[at] -= (rate * s)[:, None] * back
            done += 1
    return vectors @ (weights[1] - weights[0])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, distinct buckets and their counts of each sampled document."""
    for batch in batches:
        rows_at, rows_n = [], []
        for k in range(0, batch.num_rows, 64):
            part = batch.column(1)[k : k + 64]
            total = np.zeros((len(part), BUCKETS), np.int32)
            total[:, END] = 1
            for i, _, bucket, text in features(part):
                np.add.at(total, (i + text, bucket), 1)
            for row in total:
                at = np.flatnonzero(row)
                rows_at.append(at.astype(np.int32))
                rows_n.append(row[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows_at, pa.list_(pa.int32())), pa.array(rows_n, pa.list_(pa.int32()))], ["y", "buckets", "counts"]
        )


def _fit(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(BUCKETS, np.float32)
    lists = {c: [np.asarray(x.values.to_numpy()) for x in rows[c].combine_chunks()] for c in ("buckets", "counts")}
    y = rows["y"].to_numpy()
    # The order of rows depends on the exchange before; that of training must not.
    key = sorted(range(len(y)), key=lambda d: (int(y[d]), lists["buckets"][d].tobytes(), lists["counts"][d].tobytes()))
    return train([lists["buckets"][d] for d in key], [lists["counts"][d] for d in key], y[key])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS) -> np.ndarray:
    """The model, from labelled documents that are not held out."""
    texts = sampled_texts(docs, labels, label, FOLDS, HELD_OUT, fit_docs).select("y", "text")
    return fit_in_one_task(texts.mapInArrow(_counted, "y int, buckets array<int>, counts array<int>"), _fit)


def score(docs: DataFrame, model: np.ndarray, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 as a further column ``name``; with underscores before it where
    ``docs`` has a column of that name."""
    name = unused(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        table = shared.value.astype(np.float64)
        n, total = np.ones(len(texts), np.int64), np.full(len(texts), table[END])
        for i, j, bucket, text in features(texts):
            n[i:j] += np.bincount(text, minlength=j - i)
            total[i:j] += np.bincount(text, table[bucket], minlength=j - i)
        return pa.array(1 / (1 + np.exp(-total / n)))

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text_column)))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns."""
    name = unused(docs, "score")
    scored = score(docs, fit(docs, labels))
    return scored.filter(F.col(name) >= threshold).drop(name)
