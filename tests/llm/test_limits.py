"""What must not depend on size, on repeated ids, or on the names and types of other columns."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

from gridpulse.llm import bktree, common, linededup, quality, textbytes, toxicity
from gridpulse.llm.common import Scratch


def plain_simhash(text, n=4):
    raw = text.encode().lower()
    words = [w for w in raw.translate(bytes(0x20 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))).split(b" ") if w]
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("slice_bytes", [50, 1 << 20])
def test_byte_zero_is_part_of_a_word_at_every_length(monkeypatch, slice_bytes):
    monkeypatch.setattr(bktree, "SLICE", slice_bytes)
    monkeypatch.setattr(textbytes.cuts, "__defaults__", (slice_bytes,))
    for text in ("a\x00b c\x00 \x00d e f g h " * 20, "A\x00" * 700, "a\x00b " * 3, " \x00 "):
        assert bktree.simhash(text) == plain_simhash(text)
    long = "a\x00" * 600_000 + " b c d\x00e f g"
    assert bktree.simhash(long) == plain_simhash(long)


def test_hashes_of_words_with_byte_zero_differ():
    (_, _, hashes, bounds), = textbytes.column_words(pa.array(["a\x00b a b \x00 \x00\x00 a\x00"]), textbytes.SOLID)
    assert len(hashes) == 6 and len(np.unique(hashes)) == 6 and bounds.tolist() == [0, 6]


def many_rows_of_one_id(spark):
    train = [d for d in range(100) if zlib.crc32(str(d).encode()) % 5 and zlib.crc32(str(d).encode()) % 4 != 2][:12]
    rows = [(d, f"text {d} of class {d % 2}") for d in train] + [(train[0], f"other text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, k % 2, k % 2) for k, d in enumerate(train)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_sample_is_bounded_by_rows(spark):
    docs, labels = many_rows_of_one_id(spark)
    got = common.sampled_texts(docs, labels, "quality", quality.FOLDS, quality.HELD_OUT, 5).collect()
    assert len(got) == 10 and len({r.doc_id for r in got}) == 10
    again = common.sampled_texts(docs.repartition(7), labels, "quality", quality.FOLDS, quality.HELD_OUT, 5).collect()
    assert sorted(got) == sorted(again)
    assert len(toxicity.fit(docs, labels, examples=5).ids) == 10


def test_names_that_clash_and_text_ids(spark):
    docs, labels = many_rows_of_one_id(spark)
    some = docs.limit(40).withColumns({"score": F.lit("kept"), "n_lines": F.lit(-1)})
    scored = quality.score(some, np.zeros(quality.BUCKETS, np.float32))
    assert scored.columns == ["doc_id", "text", "score", "n_lines", "_score"]
    assert {(r["score"], r["_score"]) for r in scored.collect()} == {("kept", 0.5)}
    cut = linededup.delete_repeated_runs(some, counts=True)
    assert cut.columns == ["doc_id", "text", "score", "n_lines", "_n_lines", "n_removed"]
    assert {r["n_lines"] for r in cut.collect()} == {-1}
    text_ids = [df.withColumn("doc_id", F.col("doc_id").cast("string")) for df in (docs, labels)]
    index = toxicity.fit(*text_ids, examples=5)
    got = toxicity.score(text_ids[0].limit(20), index).collect()
    assert all(isinstance(x, str) for r in got for x in r.neighbours) and any(r.neighbours for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_quality_takes_few_bytes_of_short_texts_together():
    """Features of a slice are held at once, so slices are far shorter than those of words."""
    texts = pa.array([f"wort{k} " * 5000 for k in range(60)])
    slices = [(i, j, len(bucket)) for i, j, bucket, _ in quality.features(texts)]
    assert [i for i, _, _ in slices] == [0, *(j for _, j, _ in slices[:-1])] and slices[-1][1] == 60
    assert max(n for _, _, n in slices) < 1_000_000


def test_words_of_a_line_are_counted_without_a_map_of_characters(spark):
    docs = spark.createDataFrame([(1, "ein  Wörtchen – zwei\n" * 3)], "doc_id long, text string")
    scratch = Scratch(spark)
    linededup.repeated_runs(docs, scratch)
    hashed = next(spark.read.parquet(p) for p in scratch._paths.values() if "w" in spark.read.parquet(p).columns)
    assert hashed.first().w == [5, 5, 5]
    with open(linededup.__file__) as source:
        assert "translate(" not in source.read()
