"""Runs of words against all stretches and periods tried one by one."""

import random

import numpy as np
import pytest

from gridpulse.llm import runs, textbytes


def plain(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    found = sorted((s, length, q) for (s, length), q in out.items())
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return found, " ".join(w for k, w in enumerate(words) if k not in gone)


def generated(seed):
    rng = random.Random(seed)
    kind = seed % 6
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        root = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        return (root * 9)[: rng.randrange(4 * len(root), 9 * len(root))] + [rng.choice("abc") for _ in range(5)]
    if kind == 2:  # long roots with periodic insides
        root = ["a"] * rng.randrange(1, 12) + ["b"] * rng.randrange(1, 4) + ["a", "b"] * rng.randrange(4)
        return ["x"] * rng.randrange(3) + root * rng.randrange(3, 7) + root[: rng.randrange(len(root))]
    if kind == 3:
        return [f"w{k}" for k in range(rng.randrange(40))]
    if kind == 4:
        w = ["a"]
        while len(w) < 80:
            w = w + (w[: rng.randrange(1, len(w) + 1)] * rng.randrange(1, 6)) + [rng.choice("ab")]
        return w[:200]
    return ["z"] * rng.randrange(300)


@pytest.mark.parametrize("block", range(6))
def test_runs_of_many_texts_at_once(block):
    texts = [generated(s) for s in range(block * 150, block * 150 + 150)]
    names = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    words = np.array([names[w] for t in texts for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, length, period = runs.find_runs(words, text)
    before = np.cumsum([0, *[len(t) for t in texts]])
    got = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        k = int(text[s])
        got[k].append((s - int(before[k]), n, q))
    assert got == [plain(t)[0] for t in texts]


def test_rows_nulls_and_long_texts(spark, monkeypatch):
    rows = [(s, " ".join(generated(s))) for s in range(60)]
    rows += [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "a\x00b x\n" * 9), (5, "tail " + "one two three " * 90_000), (6, "y z " * 5), (6, "y z " * 5), (7, "É é " * 4)]
    docs = spark.createDataFrame([(*r, "r", "c") for r in rows], "doc_id long, text string, runs string, collapsed string")
    got = runs.periodic_runs(docs).collect()
    want = []
    for d, t in rows:
        words = [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        # The long text is one run after its first word.
        found = ([(1, len(words) - 1, 3)], "tail one two three") if d == 5 and len(words) > 1000 else plain(words)
        want.append((d, len(words), found))
    assert sorted(((r.doc_id, r.n_words, ([tuple(x) for x in r.runs], r.collapsed)) for r in got), key=str) == sorted(want, key=str)
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    values = rng.permutation(200)
    tree = runs.WaveletTree(values, 200)
    low = rng.integers(0, 200, 500)
    high = low + rng.integers(0, 201 - low)
    x = rng.integers(0, 300, 500)
    got = tree.successor(low, high, x, 999)
    want = [min((v for v in values[a:b] if v >= y), default=999) for a, b, y in zip(low, high, x, strict=True)]
    assert got.tolist() == want
    assert textbytes.SOLID[0] != 0
