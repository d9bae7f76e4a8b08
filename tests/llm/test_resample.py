"""Resampling towards a target against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridpulse.llm import resample, textbytes
from gridpulse.llm.common import Scratch


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, n_grams, buckets, least, percent):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    docs = [(d, *grams(t, n_grams)) for d, t in rows]
    s, t = Counter(bucket(f) for _, _, g in docs for f in g), Counter(bucket(f) for x in target for f in grams(x, n_grams)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (total_t * 0.0 + total_s + buckets)) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for d, n, g in docs:
        weight = sum(gain[bucket(f)] for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


LONG = "Very long text, " * 90_000 + "x" * 300
ROWS = [(d, " ".join(f"w{(d * k) % 37} é{k % 5}" for k in range(d % 30))) for d in range(-200, 200)]
ROWS += [(None, "a b c d e f"), (None, None), (5, "other words for the same id now"), (2**62, LONG), (-(2**63), "the least id of all there are"), (7, ""), (8, "A\x00b c-D")]
ROWS += [(9, "one row twice in the table")] * 2


@pytest.mark.parametrize("n_grams, chunk", [(1, 7), (2, 1 << 18)])
def test_resample(spark, monkeypatch, n_grams, chunk):
    monkeypatch.setattr(resample, "CHUNK_ROWS", chunk)
    docs = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, score int, place string").repartition(5)
    target = spark.createDataFrame([("w1 w2 é3 w4 the a",), (None,), ("w1 w2",)], "text string")
    got = resample.resample(docs, target, n_grams=n_grams, buckets=100, least_words=6, percent=30)
    want = plain(ROWS, ["w1 w2 é3 w4 the a", None, "w1 w2"], n_grams, 100, 6, 30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert resample.resample(none, none).collect() == []
    row = resample.resample(spark.createDataFrame([(1, "a b")], none.schema), none).first()
    assert (row.n_features, row["rank"]) == (2, None)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_features_over_slices(monkeypatch, slice_bytes):
    monkeypatch.setattr(textbytes, "SLICE", slice_bytes)
    monkeypatch.setattr(resample, "SLICE", slice_bytes)
    monkeypatch.setattr(textbytes.groups, "__defaults__", (slice_bytes,))
    monkeypatch.setattr(textbytes.cuts, "__defaults__", (slice_bytes,))
    texts = ["Some Words here, some-words there. " * 9, "", None, "é" * 60 + " b " + "C" * 100, "short one", "a\x00b"]
    got = [Counter() for _ in texts]
    for i, _, bucket, doc, _ in resample.features(pa.array(texts), 3, 1000):
        for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
            got[i + d][b] += 1
    assert got == [Counter(zlib.crc32(f.encode()) % 1000 for f in grams(t, 3)[1]) for t in texts]


def test_ties_keep_their_order(spark):
    keys = spark.range(1000).selectExpr("id % 3 as a", "cast(null as string) as other", "id").coalesce(1)
    got = resample.radix_sorted(keys, ["a"], Scratch(spark), chunk_rows=10).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000))
    assert [(r.a, r.id) for r in got] == sorted((k % 3, k) for k in range(1000))
    same = resample.radix_sorted(spark.range(20).selectExpr("7 as a"), ["a"], Scratch(spark))
    assert sorted(r.place for r in same.collect()) == list(range(20))
    wide = spark.createDataFrame([(x,) for x in (2**63 - 1, -(2**63), 0, -1, 1)], "a long")
    assert [r.a for r in resample.radix_sorted(wide, ["a"], Scratch(spark)).orderBy("place").collect()] == [-(2**63), -1, 0, 1, 2**63 - 1]
