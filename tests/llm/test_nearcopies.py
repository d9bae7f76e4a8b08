"""Near copies against brute force over all pairs, on tables with copies, chains, nulls and short texts."""

import numpy as np
import pyarrow as pa
import pytest

from gridpulse.llm import nearcopies
from gridpulse.llm.bktree import spanning
from tests.llm.test_operators import LONG, docs, same

random = np.random.default_rng(11)


def prose(n):
    return [f"w{k}" for k in random.integers(0, 400, n)]


def changed(words, n):
    out = list(words)
    for k in random.choice(len(words), n, replace=False):
        out[k] = f"x{random.integers(1 << 30)}"
    return out


def plain_sets(texts, words=5):
    found = []
    for text in texts:
        w = (text or "").lower().split()
        found.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return found


def plain_labels(texts):
    sets = plain_sets(texts)
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    return spanning(len(texts), *np.array(links or [(0, 0)]).T)


def corpus():
    texts = []
    for n in (40, 90, 200, 400):
        base = prose(n)
        texts += [" ".join(base), " ".join(base).upper(), " \n ".join(base)]
        step = base
        for _ in range(5):  # a chain: each is near the one before, the last is not near the first
            step = changed(step, max(1, n // 120))
            texts.append(" ".join(step))
    base = prose(150)
    texts += [" ".join(changed(base, 1)) for _ in range(60)]  # one group of many near copies
    texts += [" ".join(prose(100)) for _ in range(40)]
    return texts + ["a b c", "A  b c", "a b d", "a", "", None, "\x00 a", LONG, LONG + "z"]


@pytest.mark.parametrize("shard_rows,unit_shingles", [(4096, 1 << 19), (8, 1200)])
def test_groups_equal_brute_force(spark, monkeypatch, shard_rows, unit_shingles):
    texts = corpus()
    monkeypatch.setattr(nearcopies.proposed, "__defaults__", (shard_rows,))
    rows = nearcopies.near_copies(docs(spark, list(enumerate(texts))), unit_shingles=unit_shingles).collect()
    label = {r.doc_id: r.component for r in rows}
    want = plain_labels(texts)
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (label[i] == label[j]) == (want[i] == want[j]), (i, j)


def test_one_of_each_group_stays(spark):
    base = prose(100)
    rows = [(5, " ".join(base)), (3, " ".join(changed(base, 1))), (9, " ".join(base).upper()), (7, None), (8, ""), (None, "x y"), (4, "x y z")]
    kept = nearcopies.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark).columns
    same([(r.doc_id,) for r in kept.collect()], [(3,), (7,), (None,), (4,)])
    assert nearcopies.keep_one(docs(spark, [(6, "a b")] * 3)).count() == 1
    assert nearcopies.keep_one(docs(spark).limit(0)).count() == 0


def test_shingle_sets_do_not_depend_on_slices(monkeypatch):
    texts = ["", "one", "one two three four five six seven " * 20, "Ä b\tc d e f", "\x00 a b c d e f"]
    whole = list(nearcopies.shingle_sets(pa.array(texts)))
    assert [len(s) for s in whole] == [len(s) for s in plain_sets(texts)]
    monkeypatch.setattr("gridpulse.llm.textbytes.SLICE", 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, nearcopies.shingle_sets(pa.array(texts)), strict=True))


def test_trees_connect_what_is_near():
    fp = random.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    near = fp.repeat(6, 0)
    near[:, 0] ^= random.integers(0, 1 << 20, len(near)).astype(np.uint64) << np.uint64(7)
    shard = np.sort(random.integers(0, 3, len(near)))
    gap = np.bitwise_count(near[:, None] ^ near).sum(2)
    want = spanning(len(near), *np.nonzero((gap <= 9) & (shard[:, None] == shard)))
    got = nearcopies.tree_labels(shard, near, 9)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(near)) for j in range(i))
