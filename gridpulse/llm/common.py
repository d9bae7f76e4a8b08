"""What several operators share: reading tables, unused names, written tables that can be dropped."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.session import checkpoint_root


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


class Scratch:
    """Tables in the shared folder. A result that is still lazy needs its last ones, so only those that
    ``drop`` names go early; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
        self._files().deleteOnExit(self._path(self.root))
        self._paths: dict[int, str] = {}

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read back: no lineage, the same rows for every reader."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, frames: Iterable[DataFrame]) -> None:
        for df in frames:
            if path := self._paths.pop(id(df), None):
                self._files().delete(self._path(path), True)


def units_of_work(rows: DataFrame, shard: str, key: str, limit: int) -> DataFrame:
    """The rows of every shard with two or more of them, dealt to units in which they are compared:
    (``unit``, ``part``, and the columns of ``rows``).

    A shard of up to ``limit`` rows is one unit, all in part 0. A larger one is cut at random, by the hash
    of ``key``, into parts of about ``limit`` rows; each two of them make a unit as part 0 and part 1, and
    each alone one more. So a unit has about twice ``limit`` rows at most, however large a shard is.
    """
    counts = rows.groupBy(shard).count().filter("count > 1")
    cut = F.ceil(F.col("count") / limit).cast("int").alias("_cut")
    dealt = rows.join(counts.select(shard, cut), shard)
    own = F.pmod(F.xxhash64(key, F.lit("part")), F.col("_cut").cast("bigint")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_cut") - 1),
        lambda other: F.struct(
            F.when(F.col("_cut") == 1, F.col(shard))
            .otherwise(F.xxhash64(shard, F.least("_own", other), F.greatest("_own", other))).alias("unit"),
            F.when(other < F.col("_own"), 1).otherwise(0).alias("part"),
        ),
    )
    dealt = dealt.withColumn("_own", own).select(*rows.columns, F.inline(meets))
    return dealt.repartition(F.col("unit")).sortWithinPartitions("unit")


def fit_in_one_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of all rows of a sample of bounded size, run by one task; only the model comes back."""
    schema = sample.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else pa.table({f.name: [] for f in schema})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    # Unlike coalesce, this leaves the work before it in many tasks; and a task runs even without rows.
    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first().model)


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, size: int, id_column: str = "doc_id") -> DataFrame:
    """(id, label) of up to ``size`` labelled ids of each class that are not held out, those with the
    smallest hash; ids whose labels differ are left out."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & ~is_held_out(folds, held_out, id_column))
    agreed = usable.groupBy(id_column).agg(F.min(label).alias("y"), F.max(label).alias("other")).filter("y = other")
    ids = [agreed.filter(F.col("y") == y).orderBy(F.xxhash64(id_column), id_column).limit(size) for y in (0, 1)]
    return ids[0].unionAll(ids[1]).select(F.col(id_column), F.col("y").cast("int").alias("y"))


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, size: int) -> DataFrame:
    """(doc_id, y, text) of a ``labelled_sample``: one row an id, that with the smallest hash of its text where
    an id has several. So at most ``size`` rows of each class go on, however often ids repeat."""
    sample = labelled_sample(labels, label, folds, held_out, size)
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    first = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    return texts.groupBy("doc_id", "y").agg(first.alias("text"))


def is_held_out(folds: int, remainder: int, id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == remainder
