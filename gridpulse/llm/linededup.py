"""Line dedup by winnowing (4), in column expressions and joins only.

Lines end at line breaks and at sentence ends (., ! or ? before a blank); a line's hash is that of its
text without blanks around it. Three lines in a row are a window, and so is each line of ``long_words``
words for itself. A window holds two pairs of neighbouring lines; the pair with the smaller hash is its
fingerprint, so two places that share a window share its fingerprint. Fingerprints that occur once are
done with. Around the others' positions the whole windows are looked up and joined with their first
occurrence; windows that overlap extend a match both ways, and what they cover together is a repeated
run. Runs of ``min_words`` words or more are deleted, all but their first occurrence in the order of (id,
hash of the text, line).

A line that is common to many documents makes many fingerprints, but only counts and smallest positions
are gathered for each, by partial aggregation; occurrences are never paired with each other. Only hashes
and positions are shuffled for that; texts pass through one exchange, to meet their runs.

Defined results: null texts stay null, empty ones empty; nothing is deleted from them. Null ids come
first. Rows with equal id and text are one document and are cut alike. A run that overlaps its own first
occurrence (one line over and over) leaves the first line. A text may end up empty; its row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import Scratch, unused

WINDOW = 3
LONG_WORDS, MIN_WORDS = 25, 25
BREAKS = r"(?<=\n)|(?<=[.!?][ \t])"


def lines(text: str) -> Column:
    """The lines of a text with what parts them, so that together they are the text."""
    return F.filter(F.split(F.col(text), BREAKS, -1), lambda x: x != "")


def _marks(long_words: int) -> tuple[Column, Column]:
    """Of the arrays ``h`` (hashes) and ``w`` (words): (pos, mark) for each pair of lines that is the
    smaller one of a window, and, with pos = -1 - line, for each long line; and ``pairs``, which that
    reads: all pairs with their hashes."""
    pairs = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - 2))

    def pair(p: Column) -> Column:
        return F.xxhash64(F.get("h", p), F.get("h", p + 1))

    hashed = F.coalesce(F.transform(pairs, lambda p: F.struct(p.alias("pos"), pair(p).alias("mark"))), F.array())

    def smaller(of: Column) -> Column:
        # Beyond the first and the last pair, the comparison is null, which counts as false.
        return F.filter(of, lambda x, p: F.coalesce(x["mark"] <= F.get(of, p - 1)["mark"], F.lit(False)) | F.coalesce(x["mark"] <= F.get(of, p + 1)["mark"], F.lit(False)))

    long = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda p: F.get("w", p) >= long_words)
    long = F.transform(long, lambda p: F.struct((-1 - p).alias("pos"), F.xxhash64(F.get("h", p)).alias("mark")))
    return F.concat(smaller(F.col("pairs")), F.when(F.size("h") > 0, long).otherwise(F.array())), hashed


def _windows() -> Column:
    """The windows that the array ``places`` (of ``_marks``) points to: (start, n, gram, words of each line)."""
    long = F.filter("places", lambda p: p < 0)
    starts = F.flatten(F.transform(F.filter("places", lambda p: p >= 0), lambda p: F.array(p - 1, p)))
    fits = F.filter(F.array_distinct(starts), lambda s: (s >= 0) & (s + WINDOW <= F.size("h")))
    fits = F.concat(fits, long)

    def window(s: Column) -> Column:
        line = -1 - s
        w, h = (lambda k: F.get("w", s + k)), (lambda k: F.get("h", s + k))
        return F.when(
            s < 0,
            F.struct(line.alias("start"), F.lit(1).alias("n"), F.xxhash64(F.get("h", line)).alias("gram"),
                     F.get("w", line).alias("w0"), F.lit(0).alias("w1"), F.lit(0).alias("w2")),
        ).otherwise(
            F.struct(s.alias("start"), F.lit(WINDOW).alias("n"), F.xxhash64(h(0), h(1), h(2)).alias("gram"),
                     w(0).alias("w0"), w(1).alias("w1"), w(2).alias("w2"))
        )

    return F.transform(fits, window)


def repeated_runs(
    docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text",
    long_words: int = LONG_WORDS, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Per document (id, hash of the text, ``n_lines``, ``runs``: array of (start, end) lines to delete, end
    inclusive, or null)."""
    source = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("hash"), F.col(text_column).alias("text"))
    bare = F.transform(lines("text"), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    hashed = source.select("id", "hash", bare.alias("bare")).select(
        "id", "hash", F.monotonically_increasing_id().alias("row"), F.transform("bare", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("bare", lambda x: F.when(x == "", 0).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1)).alias("w"),
    )
    # Numbered rows are written before anything is joined by their numbers.
    hashed = scratch.table(hashed)
    chosen, pairs = _marks(long_words)
    marks = hashed.select("row", "h", "w", pairs.alias("pairs")).select("row", F.inline(chosen))
    repeated = marks.groupBy("mark").count().filter("count > 1").select("mark")
    found = marks.join(repeated, "mark", "left_semi").groupBy("row").agg(F.collect_list("pos").alias("places"))
    grams = hashed.join(found.hint("merge"), "row").select("id", "hash", F.inline(_windows()))
    grams = scratch.table(grams)
    place = F.struct("id", "hash", "start")
    first = grams.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.filter("first <> last").select("gram", "first")
    later = grams.join(first, "gram").filter(~F.col("first").eqNullSafe(place))
    # Per document, windows in order: one that overlaps or touches those before goes on with their run and
    # adds the words of the lines that are new.
    in_order = Window.partitionBy("id", "hash").orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce("before", F.lit(0))))
    last = F.when(F.col("n") == 1, F.array("w0")).otherwise(F.array("w0", "w1", "w2"))
    words = F.aggregate(F.slice(last, F.col("n") - F.col("fresh") + 1, F.col("fresh")), F.lit(0), lambda t, x: t + x)
    told = later.withColumn("before", before).withColumn("fresh", fresh).withColumn("words", words)
    begins = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    runs = told.withColumn("run", F.sum(begins).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("id", "hash", "run").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - 1).alias("end"), F.sum("words").alias("words")
    )
    runs = runs.filter(F.col("words") >= min_words)
    runs = runs.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    sizes = hashed.groupBy("id", "hash").agg(F.max(F.size("h")).cast("bigint").alias("n_lines"))
    same = sizes["id"].eqNullSafe(runs["id"]) & (sizes["hash"] == runs["hash"])
    return sizes.join(runs, same, "left").select(sizes["id"], sizes["hash"], "n_lines", "runs")


def _without(parts: Column, runs: Column) -> Column:
    """The lines that no run has: those before, between and after the runs, each as one slice."""
    def between(k: Column) -> Column:
        start = F.coalesce(F.get(runs, k - 1)["end"] + 1, F.lit(0))
        stop = F.coalesce(F.get(runs, k)["start"], F.size(parts))
        return F.slice(parts, start + 1, stop - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), between))


def delete_repeated_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", counts: bool = False, **options
) -> DataFrame:
    """``docs`` with the repeated runs deleted from the texts, and all other columns as they are. ``counts`` adds
    ``n_lines`` and ``n_removed``, the lines before and those deleted, with underscores before the names where
    ``docs`` has such columns."""
    scratch = Scratch(docs.sparkSession)
    # The same plan at every size: texts meet their runs in an exchange, never by a broadcast.
    runs = scratch.table(repeated_runs(docs, scratch, id_column, text_column, **options))
    runs = runs.select(F.col("id").alias("_run_id"), F.col("hash").alias("_run_hash"), F.col("runs").alias("_runs"), F.col("n_lines").alias("_n_lines"))
    hashed = unused(docs, "text_hash")
    source = docs.withColumn(hashed, F.xxhash64(F.col(text_column)))
    names = [(c, unused(source, c)) for c in runs.columns]
    runs = runs.select(*[F.col(c).alias(n) for c, n in names]).hint("merge")
    run_id, run_hash, run_list, n_lines = (n for _, n in names)
    joined = source.join(runs, source[id_column].eqNullSafe(runs[run_id]) & (source[hashed] == runs[run_hash]), "left")
    cut = F.when(F.col(run_list).isNull(), F.col(text_column)).otherwise(F.array_join(_without(lines(text_column), F.col(run_list)), ""))
    out = [cut.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        removed = F.aggregate(F.col(run_list), F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"] + 1)
        out += [F.coalesce(n_lines, F.lit(0)).alias(unused(docs, "n_lines")), F.coalesce(removed, F.lit(0)).cast("bigint").alias(unused(docs, "n_removed"))]
    return joined.select(*out)
