"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (9).

Examples: up to ``examples`` labelled documents of each class that are not held out (those with the
smallest hash of their id), whole texts. Terms: all words of the examples. A term's document frequency
is counted over all documents; a weight is (1 + ln tf) ln((1 + N) / (1 + df)), and vectors have length 1.
The weight of a word that the toxic examples have more often than chance would say is multiplied by its
relevance: the root of the log-likelihood ratio of its shares in the two classes, less ``CHANCE``, at
least 1. All other words keep their plain weight, and no word is left out. Without this, a few telling
words of a long text drown in its many rare ones.

The words of a query that no example has are part of its length too, with their frequencies among the
documents scored.

The index keeps, per term, its postings in blocks of ``BLOCK`` examples, and the largest weight of each
block. The ``COMMON`` terms with the most postings also are columns of a table of weights. A query first
adds up the short postings of its other terms. To an example's sum it adds a bound of the common terms'
share: the block's maxima of them, or the product of both lengths in them (Cauchy-Schwarz), whichever is
smaller. The most promising examples are scored in full, then all whose bound reaches the k-th best
cosine among those. So the neighbours are exact; ties go to the smaller example id.

The neighbours vote with their cosines as weights, pulled towards the share of the class; two
numbers, fitted on the examples themselves (each without itself) and weighted to the labels' true
shares, turn a vote into a probability. Neighbours and cosines are returned as evidence.

The model is fitted in one task on the bounded sample, counts in a narrow pass over all documents, and
scores in another. Shuffled are counts of terms, and (row, word) pairs of the words that no example has;
as the examples are drawn by a hash, such a word is rare, and no task gets many rows for one.

Defined results: texts without a known term (null and empty ones too) have no neighbours and the score
of the bare share. Without labels all score 0. Repeated rows are scored each; an id on several rows gives one
example. Ids may be numbers or texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import Scratch, fit_in_one_task, is_held_out, sampled_texts
from gridpulse.llm.textbytes import column_words

EXAMPLES = 2000
BLOCK, COMMON, NEIGHBOURS, PULL = 64, 128, 15, 0.5
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
CHANCE = 3.3  # in standard deviations: one word in a thousand passes by chance


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text its place, distinct word hashes and their counts."""
    for i, j, words, bounds in column_words(column):
        for k in range(j - i):
            yield (i + k, *np.unique(words[bounds[k] : bounds[k + 1]], return_counts=True))


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = [], []
        for _, t, n in term_counts(batch.column(2)):
            terms.append(t.view(np.int64))
            counts.append(n)
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (terms, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "y", "terms", "counts"])


@dataclass
class Examples:
    ids: np.ndarray
    y: np.ndarray
    terms: np.ndarray  # sorted hashes of the vocabulary
    rows: list[tuple[np.ndarray, np.ndarray]]  # per example: places in the vocabulary, counts


def _collect(rows: pa.Table) -> Examples:
    """Examples in the order of their ids, and the vocabulary that they agree on."""
    if not rows.num_rows:
        return Examples(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [])
    terms = [np.asarray(x.values.to_numpy()).view(np.uint64) for x in rows["terms"].combine_chunks()]
    counts = [np.asarray(x.values.to_numpy()) for x in rows["counts"].combine_chunks()]
    ids, y = rows["id"].to_numpy(), rows["y"].to_numpy().astype(np.int64)
    order = sorted(range(len(ids)), key=lambda d: (ids[d], terms[d].tobytes(), counts[d].tobytes()))
    ids, y, terms, counts = ids[order], y[order], [terms[d] for d in order], [counts[d] for d in order]
    vocabulary = np.unique(np.concatenate(terms))
    return Examples(ids, y, vocabulary, [(np.searchsorted(vocabulary, t), c) for t, c in zip(terms, counts, strict=True)])


def _places(vocabulary: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary of those words that it has, and which they are."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(len(words), bool)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    found = vocabulary[at] == words
    return at[found], found


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_column: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term, over all rows. Each task sends one row a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, words, bounds in column_words(batch.column(0)):
                at, found = _places(terms, words)
                doc = np.searchsorted(bounds, np.flatnonzero(found), "right")
                total[:-1] += np.bincount(np.unique(doc * len(terms) + at) % max(1, len(terms)), minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    counted = docs.select(text_column).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    found = counted.toArrow()  # one row a term of the bounded vocabulary
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    shared.destroy()
    return int(out[-1]), out[:-1]


@dataclass
class Index:
    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    y: np.ndarray
    prior: float
    pair_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # term -> its first (term, block)
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each (term, block)
    highest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    posting_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # (term, block) -> first posting
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each example
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of a common term, or -1
    common: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # weights of each common term in all examples
    length: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each example in its common terms
    slope: float = 1.0
    shift: float = 0.0

    def weights(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[places]

    def vector(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(places, counts)
        some = w > 0
        places, w = places[some], w[some]
        return places, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0, nearest first, and their cosines."""
        n_examples, frequent = len(self.ids), self.column[places] >= 0
        rest, q = places[~frequent], weights[~frequent]
        start = self.posting_of[self.pair_of[rest]]
        size = self.posting_of[self.pair_of[rest + 1]] - start
        postings = _ranges(start, size)
        total = np.bincount(self.example[postings], self.weight[postings] * np.repeat(q, size), n_examples)
        places, weights = places[frequent], weights[frequent]
        first, n = self.pair_of[places], self.pair_of[places + 1] - self.pair_of[places]
        pairs = _ranges(first, n)
        highest = np.bincount(self.block[pairs], self.highest[pairs] * np.repeat(weights, n), self.block_of.max(initial=-1) + 1)
        bound = total + np.minimum(highest[self.block_of], np.sqrt((weights * weights).sum()) * self.length)
        if 0 <= but:
            bound[but] = 0.0
        columns = self.column[places]

        def cosines(of: np.ndarray) -> np.ndarray:
            # Summed term by term, so that equal examples get equal cosines.
            if 4 * len(of) > n_examples:
                return (total + (self.common[columns] * weights[:, None]).sum(0))[of]
            return total[of] + (self.common[columns[:, None], of] * weights[:, None]).sum(0)

        found = np.flatnonzero(bound > 0)
        if len(found) > 4 * k:
            likely = found[np.argpartition(-bound[found], 4 * k)[: 4 * k]]
            least = np.partition(cosines(likely), -k)[-k]
            # A bound is a sum in another order than a cosine, so it gets some room.
            found = found[bound[found] >= least - 1e-9]
        cosine = cosines(found)
        some = cosine > 0
        found, cosine = found[some], cosine[some]
        best = np.lexsort((found, -cosine))[:k]
        return found[best], cosine[best]

    def vote(self, found: np.ndarray, cosine: np.ndarray, share: float) -> float:
        return (float((cosine * self.y[found]).sum()) + PULL * share) / (float(cosine.sum()) + PULL)

    def probability(self, toxic: Column, total: Column) -> Column:
        """From the sums of the cosines of toxic neighbours and of all; without neighbours the prior."""
        v = (toxic + PULL * (float(self.y.mean()) if len(self.y) else 0.0)) / (total + PULL)
        v = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), v))
        return F.when(total > 0, 1 / (1 + F.exp(-(self.slope * F.log(v / (1 - v)) + self.shift)))).otherwise(self.prior)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def relevance(examples: Examples) -> np.ndarray:
    """Per term of the examples, 1, or more if toxic examples have it more often than chance would say: the
    signed root of the log-likelihood ratio of its two shares, less ``CHANCE``."""
    if not len(examples.terms):
        return np.ones(0)
    n = np.bincount(examples.y, minlength=2).astype(float)
    held = np.stack([
        np.bincount(np.concatenate([np.zeros(0, np.int64), *(p for (p, _), y in zip(examples.rows, examples.y, strict=True) if y == k)]), minlength=len(examples.terms))
        for k in (0, 1)
    ]).astype(float)
    expected = held.sum(0) * (n / n.sum())[:, None]

    def part(seen: np.ndarray, due: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-300) / np.maximum(due, 1e-300))

    ratio = 2 * (part(held, expected) + part(n[:, None] - held, n[:, None] - expected)).sum(0)
    root = np.sqrt(np.maximum(ratio, 0.0)) * (held[1] > expected[1])
    return np.maximum(1.0, root - CHANCE)


def build_index(examples: Examples, n_docs: int, frequencies: np.ndarray, prior: float) -> Index:
    idf = np.log((1 + n_docs) / (1 + frequencies)) * relevance(examples)
    index = Index(examples.terms, idf, examples.ids, examples.y, prior)
    if not len(examples.ids):
        return index
    vectors = [index.vector(*row) for row in examples.rows]
    # Examples that share their weightiest term come into the same blocks, so that bounds are tight.
    top = [int(p[np.argmax(w)]) if len(p) else -1 for p, w in vectors]
    place = np.empty(len(top), np.int64)
    place[np.lexsort((examples.y, top))] = np.arange(len(top))
    size = [len(p) for p, _ in vectors]
    term = np.concatenate([p for p, _ in vectors])
    weight = np.concatenate([w for _, w in vectors])
    example = np.repeat(np.arange(len(top)), size)
    block = place[example] // BLOCK
    order = np.lexsort((example, block, term))
    term, weight, example, block = term[order], weight[order], example[order], block[order]
    key = term * (len(top) // BLOCK + 1) + block
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    index.block, index.example, index.weight = block[start], example, weight
    index.highest = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
    index.posting_of = np.append(start, len(key))
    index.pair_of = np.searchsorted(term[start], np.arange(len(examples.terms) + 1))
    index.block_of = place // BLOCK
    held = np.bincount(term, minlength=len(examples.terms))
    common = np.argsort(-held, kind="stable")[:COMMON]
    index.column = np.full(len(examples.terms), -1)
    index.column[common] = np.arange(len(common))
    index.common = np.zeros((len(common), len(top)))
    own = index.column[term] >= 0
    index.common[index.column[term[own]], example[own]] = weight[own]
    index.length = np.sqrt((index.common * index.common).sum(0))
    # Two numbers turn votes into probabilities: logistic regression by Newton steps.
    votes = np.array([index.vote(*index.nearest(p, w, but=d), examples.y.mean()) for d, (p, w) in enumerate(vectors)])
    votes = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], 1)
    share = examples.y.mean()
    scale = np.where(examples.y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (scale * (p - examples.y)) + 0.1 * (beta - [1.0, 0.0])
        step = np.linalg.solve((x * (scale * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = float(beta[0]), float(beta[1])
    return index


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Index:
    texts = sampled_texts(docs, labels, label, FOLDS, HELD_OUT, examples).select("doc_id", "y", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(_example_rows, f"id {kind}, y int, terms array<bigint>, counts array<bigint>")
    chosen = fit_in_one_task(rows, _collect)
    share = labels.filter(F.col(label).isin(0, 1) & ~is_held_out(FOLDS, HELD_OUT)).agg(F.avg(label).alias("p")).first().p
    n_docs, frequencies = document_frequencies(docs, chosen.terms)
    return build_index(chosen, n_docs, frequencies, float(share or 0.0))


def _other_squares(found: DataFrame) -> DataFrame:
    """Per ``row`` the sum of the squared weights of its words that no example has."""
    words = found.select("row", F.inline(F.arrays_zip("words", "counts"))).toDF("row", "word", "n")
    idf = words.groupBy("word").agg(F.log(F.lit(1.0 + found.count()) / (1 + F.count("*"))).alias("idf"))
    weight = (1 + F.log("n")) * F.col("idf")
    # A sum of decimals is the same in any order.
    squares = words.join(idf, "word").groupBy("row").agg(F.sum((weight * weight).cast("decimal(38,15)")).cast("double").alias("squares"))
    return squares.withColumnRenamed("row", "_row")


def score(docs: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, ``score`` and the evidence: ``neighbours`` (ids of examples) and ``cosines``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    text_ids = index.ids.dtype == object

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Index = shared.value
        for batch in batches:
            n = batch.num_rows
            near, dots, toxic, words, counts = ([[] for _ in range(n)] for _ in range(5))
            known = np.zeros(n)
            for k, w, c in term_counts(batch.column(1)):
                at, found = _places(model.terms, w)
                words[k], counts[k] = w[~found].view(np.int64), c[~found]
                weights = model.weights(at, c[found])
                known[k] = (weights * weights).sum()
                if known[k] > 0:
                    some = weights > 0
                    who, dots[k] = model.nearest(at[some], weights[some])
                    near[k], toxic[k] = model.ids[who], model.y[who]
            lists = [pa.array(x, pa.list_(t)) for x, t in ((near, pa.string() if text_ids else pa.int64()), (dots, pa.float64()), (toxic, pa.int64()), (words, pa.int64()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known), *lists], ["id", "known", "near", "dots", "toxic", "words", "counts"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = docs.select(id_column, text_column).mapInArrow(
        run, f"id {kind}, known double, near array<{'string' if text_ids else 'bigint'}>, dots array<double>, toxic array<bigint>, words array<bigint>, counts array<bigint>"
    )
    # Rows are numbered and written before anything is joined by their numbers.
    found = Scratch(docs.sparkSession).table(found.withColumn("row", F.monotonically_increasing_id()))
    whole = found.join(_other_squares(found), F.col("row") == F.col("_row"), "left")
    length = F.sqrt(F.col("known") + F.coalesce("squares", F.lit(0.0)))
    whole = whole.withColumn("length", length).select(
        "id", "near", "toxic", F.transform("dots", lambda d: d / F.col("length")).alias("cosines")
    )
    total = F.aggregate("cosines", F.lit(0.0), lambda t, c: t + c)
    toxic = F.aggregate(F.zip_with("cosines", "toxic", lambda c, y: c * y), F.lit(0.0), lambda t, c: t + c)
    return whole.select(F.col("id").alias(id_column), index.probability(toxic, total).alias("score"), F.col("near").alias("neighbours"), "cosines")
