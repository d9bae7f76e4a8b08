"""Importance resampling towards a target distribution (13).

Features are runs of 1 to ``n_grams`` consecutive words (A-Z lower-cased; ASCII letters and digits and all
beyond ASCII), hashed to ``buckets``. Bucket counts are taken over all source and all target texts and
give one gain for each bucket; a document's weight is the floored mean of its features' gains, looked up
in one array. To the weight comes a Gumbel number drawn from the hash of the id, so the ``draw`` highest
scores are a sample without replacement in proportion to the weights.

Ranks come from a distributed LSD radix sort of the narrow rows (number of the row, key). The key is
composed of the score (falling), the id and the number of features (rising); each is split into digits of
up to ``DIGIT_BITS`` bits, as many as its range needs. A pass takes the rows in chunks of their present
order: (1) each chunk counts its digits; (2) prefix sums over (digit, chunk) give the place where each
chunk's rows of each digit go, first within a digit over the chunks, then over the digits, of which there
are at most 2^``DIGIT_BITS``; (3) each chunk scatters its rows stably. Places after the last pass are the
ranks. A chunk has about rows / shuffle partitions rows and ``CHUNK_ROWS`` at most, so equal keys do not
fill a task, and each pass is written, so a lost executor costs its own tasks only.

Defined results: null and empty texts have no features, weight 0, and a score, but are not drawn (they
have fewer than ``least_words`` words). A null id is hashed as an empty one and comes after all others.
Rows with equal score and id are ranked by their number of features; if that is equal too they are alike
in all that is returned. An empty target or source counts nothing. Other columns are not read; the id
must be of an integer type. Counts of buckets are all that reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridpulse.llm.common import Scratch
from gridpulse.llm.textbytes import ALNUM, SLICE, cuts, groups, text_bytes

N_GRAMS, BUCKETS, SEED = 1, 10_000, "2024"
LEAST_WORDS, DRAW_PERCENT = 20, 10
DIGIT_BITS, CHUNK_ROWS = 11, 1 << 18
LONG_WORD = 48  # bytes; longer features are hashed one by one


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes: byte by byte for all short ones together."""
    table, size = _crc_table(), end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.argsort(-np.minimum(size, LONG_WORD + 1).astype(np.int16), kind="stable")
    many = len(start) - np.searchsorted(np.sort(size), np.arange(LONG_WORD + 1), "right")  # longer than k
    at = at[many[LONG_WORD] :]
    place, now = start[at], crc[at]
    for k in range(LONG_WORD):
        n = many[k] - many[LONG_WORD]
        if n <= 0:
            break
        now[:n] = table[(now[:n] ^ data[place[:n] + k]) & 0xFF] ^ (now[:n] >> np.uint32(8))
    crc[at] = now
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        crc[k] = zlib.crc32(data[start[k] : end[k]].tobytes())
    return crc


def _word_bounds(low: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = low != 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(low))]
    first[cut] = word[cut]
    last[:-1] &= ~word[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _joined(low: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank after each, and the bounds and documents of all runs of n words in that."""
    size = end - start + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    inner = np.ones(len(out), bool)
    inner[stop - 1] = False
    out[inner] = low[low != 0]
    whole = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    return out, (stop - size)[whole], stop[whole + n - 1] - 1, doc[whole]


def features(column: pa.Array, n_grams: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts (first, after the last), the bucket of each of their features and the text it belongs
    to, and the number of words of each text. A long text may come in several slices."""
    data, offsets = text_bytes(column)
    for i, j in groups(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        alone = j == i + 1
        carried = np.zeros(0, np.uint8)  # the last words of the slice before, for features that reach over
        for s, e in cuts(data[a:b], ALNUM) if alone and b - a > SLICE else [(0, b - a)]:
            low = np.append(carried, ALNUM[data[a + s : a + e]]) if len(carried) else ALNUM[data[a + s : a + e]]
            breaks = np.zeros(0, np.int64) if alone else offsets[i + 1 : j] - a
            start, end = _word_bounds(low, breaks)
            old = int(np.searchsorted(start, len(carried)))  # words that were counted before
            doc = np.searchsorted(breaks, start, "right") if len(breaks) else np.zeros(len(start), np.int64)
            found, of = [], []
            for n in range(1, n_grams + 1):
                if n == 1:
                    text, first, last, owner = low, start[old:], end[old:], doc[old:]
                elif len(start) < n:
                    continue
                else:
                    text, first, last, owner = _joined(low, start, end, doc, n)
                    new = max(0, old - n + 1)
                    first, last, owner = first[new:], last[new:], owner[new:]
                found.append((crc32_of(text, first, last) % np.uint32(buckets)).astype(np.int64))
                of.append(owner)
            yield i, j, np.concatenate(found), np.concatenate(of), np.bincount(doc[old:], minlength=j - i)
            keep = start[-(n_grams - 1) :] if n_grams > 1 else start[:0]
            carried = np.append(low[int(keep[0]) :], 0).astype(np.uint8) if len(keep) else np.zeros(0, np.uint8)


def bucket_counts(texts: DataFrame, n_grams: int, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows; each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _, _ in features(batch.column(0), n_grams, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gumbel(id_column: str, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) for a number u that the id decides."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, id_column: str, text_column: str, n_grams: int) -> DataFrame:
    """Per row: ``id``, ``n_words``, ``n_features`` and ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j, bucket, doc, size in features(batch.column(1), n_grams, len(gain)):
                words[i:j] += size
                n[i:j] += np.bincount(doc, minlength=j - i)
                order = np.argsort(doc, kind="stable") if n_grams > 1 else slice(None)
                sums = np.append(0, np.cumsum(gain[bucket[order]]))  # in integers: exact in any order
                bounds = np.searchsorted(doc[order], np.arange(j - i + 1))
                total[i:j] += sums[bounds[1:]] - sums[bounds[:-1]]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            columns = [batch.column(0), *(pa.array(x) for x in (words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    schema = StructType([StructField("id", docs.schema[id_column].dataType), *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return docs.select(id_column, text_column).mapInArrow(run, schema)


@dataclass(frozen=True)
class Digit:
    column: str
    low: int
    high: int
    shift: int
    bits: int

    def value(self) -> Column:
        wide = self.high - self.low >= 1 << 63
        # Above the least value; over the whole range of 64 bits, with the sign's bit turned instead.
        above = F.col(self.column).bitwiseXOR(F.lit(-(1 << 63))) if wide else F.col(self.column) - F.lit(self.low)
        return F.shiftrightunsigned(above.cast("bigint"), self.shift).bitwiseAND((1 << self.bits) - 1).cast("int")


def digits_of(keys: DataFrame, columns: list[str]) -> list[Digit]:
    """The digits of the composite key that may differ, least significant first."""
    ranges = keys.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    out = []
    for c in reversed(columns):
        low, high = ranges[f"{c}_low"] or 0, ranges[f"{c}_high"] or 0
        bits = (high - low).bit_length()
        n = -(-bits // DIGIT_BITS)
        width = -(-bits // n) if n else 0
        out += [Digit(c, low, high, k * width, width) for k in range(n)]
    return out


def _scatter(key: tuple, rows: pa.Table, bases: pa.Table) -> pa.Table:
    """A chunk's rows, each with its place after this pass: stable within a digit."""
    order = np.argsort(rows["place"].to_numpy(), kind="stable")
    digit = rows["digit"].to_numpy()[order]
    by_digit = np.argsort(digit, kind="stable")
    names, start = np.unique(digit[by_digit], return_index=True)
    base = np.zeros(int(names[-1]) + 1 if len(names) else 0, np.int64)
    base[bases["digit"].to_numpy()] = bases["base"].to_numpy()
    sizes = np.diff(np.append(start, len(digit)))
    within = np.arange(len(digit)) - np.repeat(start, sizes)
    place = np.empty(len(digit), np.int64)
    place[order[by_digit]] = np.repeat(base[names], sizes) + within
    return rows.drop_columns(["chunk", "digit", "place"]).append_column("place", pa.array(place))


def radix_sorted(keys: DataFrame, columns: list[str], scratch: Scratch, chunk_rows: int | None = None) -> DataFrame:
    """``keys`` (columns without nulls among ``columns``, which are integers) with ``place``, the rank of
    each row from 0 in the rising order of ``columns``; rows with equal keys stay as they arrived."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows are numbered and written before anything is derived from the numbers.
    now = scratch.table(keys.withColumn("place", F.monotonically_increasing_id()))
    size = chunk_rows or max(1, min(CHUNK_ROWS, -(-now.count() // partitions)))
    schema = StructType([*keys.schema, StructField("place", LongType())])
    passes = digits_of(now, columns) or [Digit(columns[0], 0, 0, 0, 1)]  # one pass at least makes places dense
    done = [now]
    for digit in passes:
        dealt = scratch.table(now.withColumn("digit", digit.value()).withColumn("chunk", F.floor(F.col("place") / size)))
        scratch.drop(done)
        counts = dealt.groupBy("digit", "chunk").count()
        earlier = F.sum("count").over(Window.partitionBy("digit").orderBy("chunk")) - F.col("count")
        counts = scratch.table(counts.withColumn("before", earlier))
        totals = counts.groupBy("digit").agg(F.sum("count").alias("n"))  # at most 2^DIGIT_BITS rows
        ahead = totals.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("ahead"))
        bases = counts.join(F.broadcast(ahead), "digit").select("chunk", "digit", (F.col("before") + F.col("ahead")).alias("base"))
        now = dealt.groupBy("chunk").cogroup(bases.groupBy("chunk")).applyInArrow(_scatter, schema)
        done = [dealt, counts]
    return now


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_grams: int = N_GRAMS, buckets: int = BUCKETS,
    seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = DRAW_PERCENT,
) -> DataFrame:
    """Per row its id, ``n_features``, ``weight``, ``score`` and ``rank``: from 1 for those drawn, else null."""
    scratch = Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs.select(text_column), n_grams, buckets), bucket_counts(target.select(text_column), n_grams, buckets))
    weighed = weights(docs, gain, id_column, text_column, n_grams)
    weighed = scratch.table(weighed.withColumn("score", F.col("weight") + gumbel("id", seed)))
    able = weighed.filter(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    keys = able.select("id", "n_features", "weight", "score", (-F.col("score")).alias("_falling"), F.col("id").isNull().cast("int").alias("_last"), F.coalesce(F.col("id").cast("bigint"), F.lit(0)).alias("_id"))
    ranked = radix_sorted(keys, ["_falling", "_last", "_id", "n_features"], scratch)
    drawn = F.when(F.col("place") < draw, F.col("place") + 1)
    out = ranked.select("id", "n_features", "weight", "score", drawn.alias("rank"))
    others = weighed.filter(F.col("n_words") < least_words).select("id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return out.unionAll(others).withColumnRenamed("id", id_column)
