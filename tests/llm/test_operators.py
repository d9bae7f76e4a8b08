"""Each operator against a plain version of itself, on small tables with nulls, empty and long texts,
repeated rows, ties, no rows at all, and further columns whose names clash with those of the results."""

import base64
import hashlib
import re
from collections import Counter
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridpulse.llm import bktree, bpe, chat, linededup, quality, rpforest, secrets, shards, suffixes, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "the quick brown fox jumps over the lazy dog again and again. " * 40_000  # above one slice
TEXTS = [
    (1, "One line here.\nAnother Line THERE.\nAnd a third one."), (2, None), (3, ""), (4, LONG), (5, "ñandú <|im_end|> \\ 日本語 <\\|x"),
    (6, "One line here.\nAnother Line THERE.\nAnd a third one."), (6, "One line here.\nAnother Line THERE.\nAnd a third one."), (None, "x"), (7, "a b c d e f g h i j k l m"),
]
SCHEMA = "doc_id long, text string, score double, spans string, fp string, shard string, n_words string"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, 0.5, "s", "f", "h", "w") for r in rows], SCHEMA)


def key(r):
    return tuple((v is None, str(v)) for v in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# 1


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0], t[1] or 0, t[2], xxhash.xxh64_intdigest(t[3].encode(), 42)))
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_round_trip(spark, monkeypatch):
    rows = [
        (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant no"), (1, 1, "assistant", "<\\|ok <|| \\"), (1, 2, "user", None), (2, None, None, ""),
        (2, 0, "assi\nstant\\n", "日本"), (3, 0, "assistant", "x" * 5000), (3, 1, "assistant", "é" * 5000), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
    ]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(400)]
    monkeypatch.setattr(chat, "CHUNK", 300)
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    formatted = chat.format_chats(turns.repartition(5))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == plain_chat(rows)
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


# 2


def test_projection_forest_finds_every_link(spark):
    random = np.random.default_rng(3)
    centres = random.standard_normal((40, 16))
    rows = [(k, [float(x) for x in centres[k % 40] + 0.12 * random.standard_normal(16)], k % 3) for k in range(600)]
    rows += [(600 + k, rows[0][1], 0) for k in range(30)]  # copies
    odd = [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] + [1.0] * 15, 1), (703, [None] + [1.0] * 15, 1), (704, rows[0][1], None), (705, rows[0][1][:8], 0), (None, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, node long")
    got = {r.vec_id: r for r in rpforest.near_duplicates(frame, leaf_rows=60).collect()}
    linked = [*rows, odd[-1]]
    x = np.array([r[1] for r in linked])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in linked])
    link = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    component = bktree.spanning(len(linked), a, b)
    found = sum(got[r[0]].n_links for r in linked) / link.sum()
    assert 0.97 <= found <= 1.0
    assert all(got[r[0]].n_links <= n for r, n in zip(linked, link.sum(1), strict=True))
    agree = np.mean([got[r[0]].component_id == linked[c][0] for r, c in zip(rows, component, strict=False)])
    assert agree > 0.97
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(700, 706))
    assert rpforest.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [8, 64, 384])
def test_forest_recall_and_copies_do_not_follow_the_dimension(dim):
    rng = np.random.default_rng(dim)
    rows = rpforest.unit_vectors(rng.standard_normal(8000 * dim), dim)
    # Partners at a cosine of 0.932; the sample alone would give 6 of the 9 levels.
    off = rng.standard_normal(rows.shape)
    off -= (off * rows).sum(1, keepdims=True) * rows
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.932 * rows + np.sqrt(1 - 0.932**2) * off
    trees = rpforest.fit({dim: rows[:2048]}, {dim: 9}, 4)[dim]
    assert {(t.depth, len(t.further)) for t in trees} == {(6, 3)}
    met = np.zeros(len(rows), bool)
    for tree in trees:
        a, b = (tree.leaves(x, rpforest.SPILL / np.sqrt(dim)) for x in (rows, near))
        assert len(a[0]) < 4 * len(rows)
        size = np.bincount(a[1], minlength=512)
        assert len(size) == 512 and size.max() < 6 * size.mean()
        met[np.intersect1d((a[0] << 9) + a[1], (b[0] << 9) + b[1]) >> 9] = True
    assert met.mean() >= 0.97


# 3


def plain_jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 300])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 500, 7), *(k * 982451653 - 2**62 for k in range(300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", shards.jump_hash(F.col("k"), n).alias("s"))
    same(got.collect(), [(k, plain_jump(k, n)) for k in keys])


def test_shards_are_gapless(spark):
    got = shards.assign(docs(spark), 8).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert all(r.grown_shard in (r.shard, 8) and r.shard == plain_jump(r.doc_id or 0, 8) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.assign(docs(spark).limit(0), 8).count() == 0


# 4


def plain_lines(rows):
    parts = {r: [x for x in re.split(r"(?<=\n)|(?<=[.!?][ \t])", r[1] or "") if x] for r in set(rows)}
    words = lambda x: len(x.strip(" \t\r\n").split(" ")) if x.strip(" \t\r\n") else 0
    order = sorted(parts, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)))
    seen, gone = set(), {r: set() for r in parts}
    for r in order:
        bare = [x.strip(" \t\r\n") for x in parts[r]]
        for i in range(len(bare)):
            for n in ([3] if i + 3 <= len(bare) else []) + ([1] if words(bare[i]) >= 25 else []):
                gram = tuple(bare[i : i + n])
                if gram in seen:
                    gone[r] |= set(range(i, i + n))
                seen.add(gram)
    out = {}
    for r, lines in parts.items():
        keep, i = list(range(len(lines))), 0
        while i < len(lines):
            j = i
            while j in gone[r]:
                j += 1
            if j > i and sum(words(lines[k]) for k in range(i, j)) >= 25:
                keep = [k for k in keep if not i <= k < j]
            i = max(j, i + 1)
        out[r] = None if r[1] is None else "".join(lines[k] for k in keep)
    return out


def test_repeated_runs_go(spark):
    s = [f"sentence number {k} has exactly nine words in it." for k in range(40)]
    long = " ".join(f"w{k}" for k in range(30)) + "."
    rows = [
        (1, " ".join(s[:6])), (2, "Start. " + " ".join(s[1:5]) + " End."), (3, s[2] + " " + s[3]), (4, " ".join(s[20:30])), (5, long), (6, "x. " + long + " y."),
        (7, "Is so. " * 50), (8, None), (9, ""), (10, "\n\n" + s[20] + "\n" + s[21] + " " + s[22] + "\n"), (None, " ".join(s[20:24])), (1, " ".join(s[:6])), (11, "a. b. c."), (12, "a. b. c."),
    ]
    got = linededup.delete_repeated_runs(docs(spark, rows))
    assert got.columns == docs(spark).columns
    want = plain_lines(rows)
    same([(r.doc_id, r.text) for r in got.collect()], [(r[0], want[r]) for r in rows])
    assert linededup.delete_repeated_runs(docs(spark).limit(0)).count() == 0
    same([(r.doc_id, r.text) for r in linededup.delete_repeated_runs(docs(spark, [(1, "a."), (2, None)])).collect()], [(1, "a."), (2, None)])


# 5 and 9


def labelled(spark, bad):
    good = [f"alpha beta {k} gamma delta word{k % 7} epsilon" for k in range(400)]
    rows = [(k, t if k % 2 else bad(t, k)) for k, t in enumerate(good)] + [(1000, None), (1001, ""), (1002, LONG), (None, "alpha")]
    return docs(spark, rows), [k % 2 for k in range(400)]


def test_quality_tells_classes_apart(spark):
    frame, y = labelled(spark, lambda t, k: t.upper().replace(" ", "!! "))
    labels = spark.createDataFrame([(k, v, v) for k, v in enumerate(y)] + [(None, 1, 1), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.result for r in quality.score(frame, quality.fit(frame, labels), name="result").collect()}
    assert len(got) == 404 and all(0 <= v <= 1 for v in got.values())
    assert all((got[k] >= 0.3) == bool(y[k]) for k in range(400))
    kept = quality.reject(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= {k for k in range(400) if y[k]}
    empty = quality.fit(frame, labels.limit(0))
    assert {r.result for r in quality.score(frame, empty, name="result").collect()} == {0.5}


def test_buckets_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["ab ab abc", "", "x", "ñ  ñ\tq", "ab ab abc"]

    def counts(part):
        out = np.zeros((len(part), quality.BUCKETS), int)
        for i, _, bucket, text in quality.features(pa.array(part)):
            np.add.at(out, (i + text, bucket), 1)
        return out

    together = counts(texts)
    assert all((together[k] == counts([t])[0]).all() for k, t in enumerate(texts))


def test_toxicity_neighbours_are_exact(spark):
    frame, y = labelled(spark, lambda t, k: t + " nasty" * (1 + k % 3) + f" rude{k % 5}")
    labels = spark.createDataFrame([(k, 1, 1 - v) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame, labels)
    got = {r.doc_id: r for r in toxicity.score(frame, index).collect()}
    assert all((got[k].score >= 0.3) == (not y[k]) for k in range(400))
    assert got[1000].score == index.prior and got[1000].neighbours == []
    # Brute force over the postings.
    n = len(index.ids)
    weights = np.zeros((len(index.terms), n))
    term = np.repeat(np.arange(len(index.terms)), np.diff(index.posting_of[index.pair_of]))
    weights[term, index.example] = index.weight
    rng = np.random.default_rng(1)
    for _ in range(50):
        places = np.sort(rng.choice(len(index.terms), min(6, len(index.terms)), replace=False))
        q = rng.random(len(places))
        q /= np.linalg.norm(q)
        all_of = q @ weights[places]
        best = [d for d in np.lexsort((np.arange(n), -all_of)) if all_of[d] > 0][: toxicity.NEIGHBOURS]
        who, cosine = index.nearest(places, q)
        assert np.allclose(cosine, all_of[best]) and np.allclose(all_of[who], all_of[best])
    none = toxicity.fit(frame, labels.limit(0))
    assert {r.score for r in toxicity.score(frame, none).collect()} == {0.0}


def test_toxicity_cosines_are_of_whole_texts(spark):
    # Far more than 200 words, each in few examples; some that no example has.
    random = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 900, 40)) + f" own{k} and" for k in range(120)]
    texts[-1] = texts[0].replace("and", "or else")
    frame = docs(spark, list(enumerate(texts)) + [(500, None), (501, "alone"), (120, texts[3]), (120, texts[3])])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame, labels)
    rows = frame.select("doc_id", "text").collect()
    words = {r.text or "": (r.text or "").split() for r in rows}
    df = {w: sum(w in words[r.text or ""] for r in rows) for t in words.values() for w in t}

    def vector(text):
        v = {w: (1 + np.log(words[text].count(w))) * np.log((1 + len(rows)) / (1 + df[w])) for w in set(words[text])}
        return v, np.sqrt(sum(x * x for x in v.values()))

    examples = {int(k): vector(texts[k]) for k in index.ids}
    for r in toxicity.score(frame.repartition(3), index).join(frame.select("doc_id", "text").distinct(), "doc_id").collect():
        v, length = vector(r.text or "")
        want = {k: sum(x * e.get(w, 0) for w, x in v.items()) / length / n for k, (e, n) in examples.items()} if length else {}
        best = sorted((c for c in want.values() if c > 1e-12), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose(r.cosines, best) and np.allclose([want[k] for k in r.neighbours], best)


def test_toxicity_weights_telling_words(spark):
    # Three telling words in 60 of 300 long texts: each text has many words rarer than these.
    random = np.random.default_rng(8)
    y = [int(k % 5 == 0) for k in range(300)]
    texts = [" ".join(f"w{x}" for x in random.integers(0, 4000, 300)) + (f" bad{k % 3} bad{(k + 1) % 3}" if y[k] else "") for k in range(300)]
    frame = docs(spark, list(enumerate(texts)))
    index = toxicity.fit(frame, spark.createDataFrame([(k, 1, v) for k, v in enumerate(y)], "doc_id long, quality int, toxic int"))
    words = [Counter(t.split()) for t in texts]
    n = Counter(y[k] for k in index.ids)
    df = Counter(w for t in words for w in t)
    held = [Counter(w for k in index.ids if y[k] == c for w in words[k]) for c in (0, 1)]

    def relevance(word):
        seen, due, total = [held[c][word] for c in (0, 1)], [], sum(n.values())
        due = [sum(seen) * n[c] / total for c in (0, 1)]
        cells = [*zip(seen, due, strict=True), *((n[c] - seen[c], n[c] - due[c]) for c in (0, 1))]
        ratio = 2 * sum(a * np.log(a / b) for a, b in cells if a)
        return max(1.0, np.sqrt(max(ratio, 0.0)) - toxicity.CHANCE) if seen[1] > due[1] else 1.0

    def vector(k):
        v = {w: (1 + np.log(c)) * np.log((1 + len(texts)) / (1 + df[w])) * relevance(w) for w, c in words[k].items()}
        return v, np.sqrt(sum(x * x for x in v.values()))

    assert relevance("bad0") > 5
    vectors = {k: vector(k) for k in range(300)}
    got = {r.doc_id: r for r in toxicity.score(frame, index).collect()}
    for k in range(0, 300, 7):
        v, length = vectors[k]
        want = sorted((sum(x * vectors[e][0].get(w, 0) for w, x in v.items()) / length / vectors[e][1] for e in map(int, index.ids)), reverse=True)
        assert np.allclose(got[k].cosines, [c for c in want if c > 1e-12][: toxicity.NEIGHBOURS])
    assert all((got[k].score >= toxicity.THRESHOLD) == bool(y[k]) for k in got)


# 6


def plain_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_long_texts(monkeypatch):
    monkeypatch.setattr(bktree, "SLICE", 50)
    for text in ["", "a", "A b  c", "Ä b\tc d e", "word " * 100 + "x" * 200 + " tail end of it", "a b c d " * 30]:
        assert bktree.simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("shard_rows", [20, 4096])
def test_near_pairs_connect_what_is_near(spark, shard_rows):
    from gridpulse.llm.common import Scratch
    from gridpulse.llm.components import components

    random = np.random.default_rng(5)
    fps = [int(x) for x in random.integers(0, 1 << 63, 60)]
    for f in list(fps):
        for n in (2, 4, 5):
            bits = random.choice(64, n, replace=False)
            fps.append(f ^ sum(1 << int(b) for b in bits))
    fps += [fps[0] ^ (1 << b) ^ (1 << c) for b in range(12) for c in range(b)]
    fps = np.unique(np.array(fps, np.uint64))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4)
    want = bktree.spanning(len(fps), a, b)
    scratch = Scratch(spark)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components(bktree.near_pairs(frame, scratch, shard_rows=shard_rows), scratch).collect()}
    label = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(0, len(fps), 7))


def test_one_of_each_group_stays(spark):
    got = {(r.doc_id, r.fp): r.component_id for r in bktree.near_duplicates(docs(spark)).collect()}
    assert {k[0]: v for k, v in got.items()}[6] == 1 and {k[0]: v for k, v in got.items()}[3] == 2
    kept = bktree.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns
    same([(r.doc_id,) for r in kept.select("doc_id").collect()], [(1,), (2,), (4,), (5,), (7,), (None,)])
    twins = docs(spark, [(6, "a b c d e"), (6, "a b c d e")])
    assert bktree.keep_first(twins).count() == 1
    shared = docs(spark, [(6, "a b c d e"), (6, LONG), (8, LONG)])
    same([(r.doc_id, r.text) for r in bktree.keep_first(shared).collect()], [(6, "a b c d e"), (6, LONG)])
    assert bktree.keep_first(docs(spark).limit(0)).count() == 0


# 7


def plain_matches(text, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, names = cut(text), set(), set()
    for name, item in items:
        own = cut(item)
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit |= set(range(i, i + n))
                    names.add(str(name) if name is not None else "")
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [suffixes.BLOCK_WORDS, 12])
def test_benchmark_windows(spark, block_words):
    items = [(1, "A b c d e f g h i j k"), (2, "fox"), (3, None), (4, "!!"), (None, "one LINE here"), (5, "a b c d e f g h i j k"), (6, "the lazy dog again and again the quick brown fox jumps over the")]
    rows = [r if r[0] != 4 else (4, LONG[:2000]) for r in TEXTS]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, spans string")
    got = suffixes.find_matches(docs(spark, rows), bench, block_words=block_words).withColumn("n_hit", suffixes.n_hit()).collect()
    same([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], [(i, a, b, tuple(c)) for i, t in rows for a, b, c in [plain_matches(t, items)]])
    left = suffixes.remove_contaminated(docs(spark, rows), bench)
    assert left.columns == docs(spark).columns
    same([(r.doc_id, r.text) for r in left.collect()], [(i, t) for i, t in rows if not plain_matches(t, items)[1]])
    assert suffixes.remove_contaminated(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert suffixes.find_matches(docs(spark).limit(0), bench).count() == 0


def test_longest_match_of_a_long_text(spark):
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[:100]))], "item_id long, text string")
    row = suffixes.find_matches(docs(spark, [(4, LONG)]), bench).first()
    assert row.longest == 100 and row.n_words == len(LONG.split())


# 8


def test_secrets(spark):
    akia, blob = "AKIA" + "B" * 12, "Zm9vYmFyMTIzNDU2Nzg5MA"
    rows = [
        (1, f"ñ password = 'hunter2hunter2' {akia} {'0a' * 16}"), (2, "secret: token: abcdefghi"), (3, "TOKEN=short"), (4, f"{blob}"), (5, f"{blob} user: joe"),
        (6, f"{blob} " + "x " * 150 + "user: joe"), (7, "see https://a.b/c user=joe"), (8, f"https://a.b/c {blob}"), (9, None), (10, ""), (None, akia), (1, akia), (1, akia), (11, "a" * 31 + " " + akia[:15] + " api_key:12345678"),
    ]
    got = [(r.doc_id, r.spans) for r in secrets.scan(docs(spark, rows)).select("doc_id", secrets.written(F.col("parts")).alias("spans")).collect()]
    want = [
        (1, "assign:2:28,access:30:46,hex:47:79"), (2, ""), (3, ""), (4, ""), (5, "blob:0:22,ident:23:32"), (6, ""), (7, ""), (8, "endpoint:0:13,blob:14:36"),
        (9, ""), (10, ""), (None, "access:0:16"), (1, "access:0:16"), (1, "access:0:16"), (11, "assign:48:64"),
    ]
    same(got, want)
    assert secrets.scan(docs(spark).limit(0)).count() == 0


# 10


def test_bpe_equals_the_library(spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*TEXTS, (20, "qzxv" * 3000), (21, "  \n\t  ab's 12!?<|endoftext|>"), (22, "́\U0001f600x")]
    got = bpe.encode_decode(docs(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    unpack = lambda b: tuple(np.frombuffer(b, "<u4").tolist())
    same([(r.doc_id, unpack(r.token_ids), bytes(r.decoded).decode()) for r in got], [(i, tuple(library.encode_ordinary(t or "")), t or "") for i, t in rows])
    apart = bpe.decode(bpe.encode(docs(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(map(str, apart)) == sorted(map(str, got))
    assert bpe.encode(docs(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [base64.b64encode(str(k).encode()) for k in range(5000)]
    table = bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(5000)) and sorted(table.order) == list(range(5000)) and table.find(b"none") == -1


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    found = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, found, folder)
        assert left.columns == found.columns and 0 < left.count() <= found.count(), name
    assert corpus_pipeline.run(spark, folder).count() > 0
