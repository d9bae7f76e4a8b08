"""The suffix tree against a plain version of itself, in dictionaries."""

import math
import re
import zlib
from collections import Counter

import pytest

from gridpulse.llm import suffixtree


def plain(rows, depth, least, share, least_gain=suffixtree.GAIN):
    texts = [[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for _, t in rows]
    train = [t for (d, _), t in zip(rows, texts) if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    counts = [Counter() for _ in range(depth + 1)]
    for t in train:
        for i, w in enumerate(t):
            for k in range(min(i, depth) + 1):
                counts[k][tuple(t[i - k : i]), w] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    least = max(least, math.ceil(share * n))
    follow = [Counter() for _ in counts]
    total = [Counter() for _ in counts]
    for k, c in enumerate(counts):
        for (s, _), x in c.items():
            follow[k][s] += 1
            total[k][s] += x
    kept = set()
    for k in range(1, depth + 1):
        for s in total[k]:
            # a candidate's every shorter beginning and end is one too
            if total[k][s] >= least:
                up = total[k - 1][s[1:]] if k > 1 else n
                gain = 0.0
                for (z, w), x in counts[k].items():
                    if z == s:
                        share = counts[k - 1][s[1:], w] / up
                        gain += x * math.log((x - 1 + follow[k][s] * share) / (total[k][s] - 1 + follow[k][s]) / share)
                if gain > least_gain:
                    kept.add(s)
    for s in list(kept):
        kept |= {s[j:] for j in range(1, len(s))}

    def chance(s, w):
        if not s:
            return (counts[0][(), w] + 0.5) / (n + 0.5 * (v + 1))
        below = chance(s[1:], w)
        if s not in kept:
            return below
        k = len(s)
        return (counts[k][s, w] + follow[k][s] * below) / (total[k][s] + follow[k][s])

    out = []
    for (d, _), t in zip(rows, texts):
        score = sum(math.log10(chance(max((tuple(t[i - k : i]) for k in range(min(i, depth) + 1) if not k or tuple(t[i - k : i]) in kept), key=len), w)) for i, w in enumerate(t))
        base = sum(math.log10(chance((), w)) for w in t)
        out.append((d, len(t), sum(counts[0][(), w] > 0 for w in t), base, score, n))
    return out, kept


def words(seed, n):
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(["the", "The", "cat", "sat", "ON", "mat", "x\x00y", "x", "été"][(x >> 16) % 9])
        if out[-1] == "cat":
            out += ["sat", "down"] if x % 3 else ["ran"]
    return " ".join(out)


ROWS = [(d, words(d, 40 + d)) for d in range(60)] + [(60, None), (61, ""), (62, " \t\n"), (None, "the cat ran"), (7, "Never seen words"), (7, "Never seen words"), (63, words(5, 3000))]


@pytest.mark.parametrize("depth, least, block", [(2, 8, 2_000_000), (3, 3, 50), (1, 8, 2_000_000)])
def test_scores(spark, monkeypatch, depth, least, block):
    monkeypatch.setattr(suffixtree, "BLOCK_TOKENS", block)
    monkeypatch.setattr(suffixtree, "HOT_SHARE", 0.05)
    docs = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, score int, word string").repartition(3, "text")
    got = {}
    for r in suffixtree.log_probabilities(docs, depth=depth, least_count=least).collect():
        got.setdefault((r.doc_id, r.n_tokens, r.n_known, r.train_tokens), []).append((r.base_score, r.score))
    want, kept = plain(ROWS, depth, least, suffixtree.LEAST_SHARE)
    assert {len(s) for s in kept} >= {1, min(2, depth)}
    expected = {}
    for d, n, known, base, score, total in want:
        expected.setdefault((d, n, known, total), []).append((base, score))
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert sorted(got[k]) == [pytest.approx(x) for x in sorted(v)]


def test_empty_tables_and_no_training_rows(spark):
    schema = "doc_id string, text string"
    assert suffixtree.log_probabilities(spark.createDataFrame([], schema)).collect() == []
    held = next(str(d) for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    (row,) = suffixtree.log_probabilities(spark.createDataFrame([(held, "a b")], schema)).collect()
    assert (row.doc_id, row.n_tokens, row.n_known, row.train_tokens, row.score) == (held, 3, 0, 0, 0.0)

