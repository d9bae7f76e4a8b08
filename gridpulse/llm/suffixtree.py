"""Language-model scores by a probabilistic suffix tree (12).

A state of the tree is a context, the last k words before a token (k up to ``depth``). Level by level,
a context of length k + 1 is a candidate if its count in the training rows reaches ``least_count`` and
the share ``least_share`` of all training tokens, so a level has 1 / ``least_share`` candidates at most,
however large the corpus is; their next-symbol distributions are over all words and grow with it. A
candidate is retained if its next-symbol distribution diverges from that of its parent (the context
without its oldest word): if the tokens after it, each predicted from all the others, gain ``GAIN`` nats
in sum over the parent's distribution; or if a longer retained context ends with it. (The plain divergence
of counts would keep nearly all rare contexts, whose followers are mostly seen once.) Distributions are
smoothed towards the parent's (Witten and Bell): P(w | s) = (n(s, w) + t(s) P(w | parent)) / (n(s) + t(s)),
where t(s) counts the different words after s. The root has (c + 1/2) / (N + (V + 1) / 2). A token is scored in the longest
retained context before it; contexts do not reach across the start of a text.

Counts are taken block by block (some two million tokens), each task adding up equal (context, word)
pairs first, and are dealt by the hash of the word, packed as arrays that equal words stand together in.
A part thus has a word's counts in all contexts, from the root down; each pair's count is written beside
that of the parent, for the tests. Only the candidates (with totals) reach the driver and are sent to all
tasks; their number is bounded as said. Words above ``HOT_SHARE`` are dealt by the word before them too.
To score, a pair that is itself frequent is looked up where its text is; the others go to the part of
their word, together with the place of their document in its block, and come back as one sum for each
document and part. So no text is shuffled, and no word, pair or document can fill one task.

Defined results: a null text has one token, its end, like an empty one. Without training rows all words
are unknown. Labels are not used. Repeated rows are counted each and scored each; a null id is held out
as empty text would be. Other columns are not read. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from gridpulse.llm.common import Scratch, is_held_out
from gridpulse.llm.textbytes import SOLID_LOWER, column_words, groups, text_bytes

DEPTH, LEAST_COUNT, LEAST_SHARE, GAIN = 2, 8, 2e-6, 4.0
HOT_SHARE = 1e-3
BLOCK_TOKENS = 2_000_000
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0)  # no word has this hash
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (word ^ ((context.astype(np.uint64) + np.uint64(1)) * A)) * B
    return h ^ (h >> np.uint64(31))


@dataclass
class Pairs:
    """(context, word) pairs with their counts, sorted by key. As contexts of the next level, pairs are
    known by their places here."""

    context: np.ndarray
    word: np.ndarray
    n: np.ndarray
    key: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        key = pair_key(self.context, self.word)
        order = np.argsort(key, kind="stable")
        self.context, self.word, self.n, self.key = self.context[order], self.word[order], self.n[order], key[order]

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each pair, -1 for those that are not here."""
        if not len(self.key):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.key, pair_key(context, word)), len(self.key) - 1)
        return np.where((self.word[at] == word) & (self.context[at] == context), at, -1)

    def counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        at = self.find(context, word)
        return np.where(at >= 0, self.n[at] if len(self.n) else 0, 0)


def summed(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> Pairs:
    """Equal pairs added up."""
    all_ = Pairs(context, word, n)
    if not len(all_.key):
        return all_
    first = np.append(True, (all_.word[1:] != all_.word[:-1]) | (all_.context[1:] != all_.context[:-1]))
    start = np.flatnonzero(first)
    return Pairs(all_.context[start], all_.word[start], np.add.reduceat(all_.n, start))


@dataclass
class Contexts:
    """Candidates of one level: totals, different words after each, parents in the level before, the
    place of the last word among those of level 1, and whether each is retained."""

    n: np.ndarray
    kinds: np.ndarray
    parent: np.ndarray
    last: np.ndarray
    kept: np.ndarray


@dataclass
class Tree:
    tokens: int
    words: int
    parts: int
    pairs: list[Pairs]  # of each level, the frequent ones: they are the contexts of the next
    contexts: list[Contexts]
    chance: list[np.ndarray] = field(default_factory=list)  # P(word | context) of the frequent pairs

    @property
    def depth(self) -> int:
        return len(self.contexts) - 1

    def states(self, block: Block, depth: int) -> list[np.ndarray]:
        """For each length up to ``depth``, the place of the context of that length before each token; -1
        if it is no candidate."""
        out = [np.zeros(len(block.tokens), np.int64)]
        for k in range(depth):
            now = np.full(len(block.tokens), -1)
            some = np.flatnonzero((out[k] >= 0) & ~block.last)
            now[some + 1] = self.pairs[k].find(out[k][some], block.tokens[some])
            out.append(now)
        return out

    def part(self, word: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The part that a word is dealt to; hot words by the word before too (``last``, -1: none)."""
        h = word
        if self.pairs:
            at = self.pairs[0].find(np.zeros(len(word), np.int64), word)
            hot = (at >= 0) & (last >= 0)
            hot[hot] = self.pairs[0].n[at[hot]] >= HOT_SHARE * self.tokens
            h = np.where(hot, word ^ ((last.astype(np.uint64) + np.uint64(7)) * B), word)
        h = (h ^ (h >> np.uint64(33))) * A
        return ((h >> np.uint64(33)) % np.uint64(self.parts)).astype(np.int64)

    def root(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def smoothed(self, level: int, context: np.ndarray, n: np.ndarray, below: np.ndarray) -> np.ndarray:
        """P(w | context) from the pair's count and P(w | parent); that of the parent where the context is
        not retained."""
        c = self.contexts[level]
        total, kinds = c.n[context], c.kinds[context]
        return np.where(c.kept[context], (n + kinds * below) / np.maximum(total + kinds, 1), below)


@dataclass
class Block:
    tokens: np.ndarray
    doc: np.ndarray  # place of each token's row in the block
    last: np.ndarray  # whether a token is the end of its text
    rows: pa.Table  # the rows without their texts

    @property
    def sizes(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows.num_rows)


def _block(batches: list[pa.RecordBatch]) -> Block:
    tokens, docs, before = [], [], 0
    for batch in batches:
        for i, j, words, bounds in column_words(batch.column("text"), SOLID_LOWER):
            n = np.diff(bounds)
            doc = np.repeat(np.arange(j - i), n + 1)
            out = np.full(len(doc), END)
            end = np.cumsum(n + 1) - 1
            inner = np.ones(len(doc), bool)
            inner[end] = False
            out[inner] = words
            tokens.append(out)
            docs.append(doc + before + i)
        before += batch.num_rows
    tokens, doc = np.concatenate(tokens), np.concatenate(docs)
    return Block(tokens, doc, tokens == END, pa.Table.from_batches(batches).drop_columns("text"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    limit = 6 * BLOCK_TOKENS  # a token has some six bytes
    held, size = [], 0
    for batch in batches:
        offsets = text_bytes(batch.column("text"))[1]
        for i, j in groups(offsets, limit):
            if held and size + offsets[j] - offsets[i] > limit:
                yield _block(held)
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
    if held:
        yield _block(held)


def _lists(part: np.ndarray, columns: dict[str, np.ndarray], schema: pa.Schema, **same: object) -> pa.RecordBatch:
    """One row for each part, with its share of every column as a list; ``same`` values go to all rows."""
    order = np.lexsort((columns["context"], columns["word"], part))
    names, start = np.unique(part[order], return_index=True)
    offsets = pa.array(np.append(start, len(part)), pa.int32())
    out = []
    for f in schema:
        if f.name == "part":
            out.append(pa.array(names, f.type))
        elif f.name in columns:
            values = pa.array(columns[f.name][order], f.type.value_type)
            out.append(pa.ListArray.from_arrays(offsets, values, type=f.type))
        else:
            out.append(pa.array([same.get(f.name)] * len(names), f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table[name].combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _pairs(table: pa.Table) -> Pairs:
    return Pairs(_flat(table, "context").astype(np.int64), _flat(table, "word").view(np.uint64), _flat(table, "n"))


PAIRS = "part int, context array<int>, word array<bigint>, n array<bigint>, up array<bigint>"
PAIRS_ARROW = pa.schema([("part", pa.int32()), *[(c, pa.list_(t)) for c, t in (("context", pa.int32()), ("word", pa.int64()), ("n", pa.int64()), ("up", pa.int64()))]])


def _columns(pairs: Pairs, up: np.ndarray | None = None) -> dict[str, np.ndarray]:
    return {"context": pairs.context, "word": pairs.word.view(np.int64), "n": pairs.n, "up": pairs.n if up is None else up}


def count_pairs(texts: DataFrame, tree: Tree, level: int, before: DataFrame | None) -> DataFrame:
    """Counts of (context of length ``level``, word) in all training rows: one row a part, with the counts
    ``up`` of (the context's parent, word), which the table ``before`` of the level before has."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tree = shared.value
        for block in blocks(batches):
            state = model.states(block, level)[level]
            some = np.flatnonzero(state >= 0)
            found = summed(state[some], block.tokens[some], np.ones(len(some), np.int64))
            last = model.contexts[level].last[found.context] if level else np.full(len(found.n), -1)
            yield _lists(model.part(found.word, last), _columns(found), PAIRS_ARROW)

    def add_beside(key: tuple, table: pa.Table, parents: pa.Table | None) -> pa.Table:
        model, at = shared.value, _pairs(table)
        at, up = summed(at.context, at.word, at.n), None
        if parents is not None and len(at.n):
            parent = model.contexts[level].parent[at.context]
            up = _pairs(parents).counts(parent, at.word)
            if level == 1:  # a hot word's own count may be in another part
                up = np.maximum(up, model.pairs[0].counts(parent, at.word))
        return pa.Table.from_batches([_lists(np.full(len(at.n), key[0].as_py()), _columns(at, up), PAIRS_ARROW)], PAIRS_ARROW)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return add_beside(key, table, None)

    dealt = texts.select("text").mapInArrow(run, PAIRS).groupBy("part")
    if before is None:
        return dealt.applyInArrow(add, PAIRS)
    return dealt.cogroup(before.groupBy("part")).applyInArrow(add_beside, PAIRS)


def frequent(counted: DataFrame, least: int) -> Pairs:
    """Pairs with ``least`` or more, at most one for each ``least`` training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _pairs(pa.Table.from_batches([batch]))
            some = found.n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.context[some]), pa.array(found.word[some].view(np.int64)), pa.array(found.n[some])], ["context", "word", "n"]
            )

    rows = counted.mapInArrow(run, "context bigint, word bigint, n bigint").toArrow()
    return Pairs(rows["context"].to_numpy(), rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def _next_level(tree: Tree, level: int) -> Contexts:
    """The frequent pairs of a level as contexts of the next."""
    pairs = tree.pairs[level]
    last = tree.pairs[0].find(np.zeros(len(pairs.n), np.int64), pairs.word)
    parent = np.zeros(len(pairs.n), np.int64)
    if level:  # the pair of the context's parent and the same word is at least as frequent
        parent = tree.pairs[level - 1].find(tree.contexts[level].parent[pairs.context], pairs.word)
    return Contexts(pairs.n, np.zeros(len(pairs.n), np.int64), parent, last, np.zeros(len(pairs.n), bool))


def _by_context(counted: DataFrame, many: int, value: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``value`` of all pairs of each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many)
        for batch in batches:
            context = batch.column("context").flatten().to_numpy()
            total += np.bincount(context, value(batch), many)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["context", "value"])

    # Sums of decimals do not depend on their order, and so neither does what is retained.
    exact = F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("value")
    rows = counted.mapInArrow(run, "context bigint, value double").groupBy("context").agg(exact).toArrow()
    out = np.zeros(many)
    out[rows["context"].to_numpy()] = rows["value"].to_numpy()
    return out


def _retain(counted: DataFrame, tree: Tree, level: int) -> None:
    """Fill in the different words after each context of a level, and which contexts are retained."""
    own, above = tree.contexts[level], tree.contexts[level - 1]
    many = len(own.n)
    own.kinds = _by_context(counted, many, lambda b: np.ones(len(b.column("n").flatten()))).astype(np.int64)
    totals, kinds = own.n, own.kinds
    parents = above.n[own.parent]

    def gain(batch: pa.RecordBatch) -> np.ndarray:
        context, n, up = (batch.column(c).flatten().to_numpy() for c in ("context", "n", "up"))
        share = np.maximum(up, 1) / np.maximum(parents[context], 1)
        others = (n - 1 + kinds[context] * share) / np.maximum(totals[context] - 1 + kinds[context], 1)
        return n * np.log(others / share)

    own.kept = (own.kinds > 0) & (_by_context(counted, many, gain) > GAIN)


def fit(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text",
        depth: int = DEPTH, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE) -> tuple[Tree, list[DataFrame]]:
    """The tree's contexts, and for each level the counts of all pairs, in parts."""
    spark = docs.sparkSession
    texts = docs.filter(~is_held_out(FOLDS, HELD_OUT, id_column)).select(F.col(text_column).alias("text"))
    one = np.zeros(1, np.int64)
    tree = Tree(0, 0, int(spark.conf.get("spark.sql.shuffle.partitions")), [], [Contexts(one, one, one, one - 1, one == 0)])
    counted = [scratch.table(count_pairs(texts, tree, 0, None))]
    size = counted[0].agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda t, n: t + n))).first()
    tree.words, tree.tokens = (int(x or 0) for x in size)
    tree.contexts[0].n[0], tree.contexts[0].kinds = tree.tokens, np.array([tree.words])
    least = max(least_count, int(np.ceil(least_share * tree.tokens)))
    tree.pairs.append(frequent(counted[0], least))
    for level in range(1, depth + 1):
        tree.contexts.append(_next_level(tree, level - 1))
        counted.append(scratch.table(count_pairs(texts, tree, level, counted[level - 1])))
        _retain(counted[level], tree, level)
        tree.pairs.append(frequent(counted[level], least))
    for level in range(depth, 1, -1):
        c = tree.contexts[level]
        tree.contexts[level - 1].kept[c.parent[c.kept]] = True
    for level, pairs in enumerate(tree.pairs):
        if level == 0:
            tree.chance.append(tree.root(pairs.n))
        else:
            up = tree.contexts[level].parent[pairs.context]
            below = tree.chance[level - 1][tree.pairs[level - 1].find(up, pairs.word)]
            tree.chance.append(tree.smoothed(level, pairs.context, pairs.n, below))
    return tree, counted


def _longest(tree: Tree, states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Length and place of the longest retained context before each token."""
    level, state = np.zeros(len(states[0]), np.int64), np.zeros(len(states[0]), np.int64)
    for k in range(1, tree.depth + 1):
        at = np.flatnonzero(states[k] >= 0)
        at = at[tree.contexts[k].kept[states[k][at]]]
        level[at], state[at] = k, states[k][at]
    return level, state


def _kept_only(counted: DataFrame, tree: Tree, level: int) -> DataFrame:
    """The pairs of retained contexts."""
    if level == 0:
        return counted.select("part", "context", "word", "n")
    kept = tree.contexts[level].kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                columns = {c: row.column(c).flatten().to_numpy() for c in ("context", "word", "n")}
                some = kept[columns["context"]]
                lists = [pa.ListArray.from_arrays(pa.array([0, int(some.sum())], pa.int32()), pa.array(columns[c][some])) for c in columns]
                yield pa.RecordBatch.from_arrays([row.column("part"), *lists], ["part", *columns])

    return counted.select("part", "context", "word", "n").mapInArrow(run, "part int, context array<int>, word array<bigint>, n array<bigint>")


def score(docs: DataFrame, tree: Tree, counted: list[DataFrame], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, ``n_tokens``, ``n_known``, ``base_score`` and ``score``."""
    kind = docs.schema[id_column].dataType
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    lists = {"word": LongType(), "context": IntegerType(), "id": kind, "doc": IntegerType(), "base": DoubleType(), "score": DoubleType(), "known": IntegerType(), "tokens": LongType()}
    sent = StructType([StructField("part", IntegerType()), StructField("block", LongType()), *[StructField(c, ArrayType(t)) for c, t in lists.items()]])
    back = StructType([f for f in sent if f.name not in ("part", "word", "context")])
    first = np.cumsum([0, *[len(c.n) for c in tree.contexts]])  # contexts of all levels, numbered through

    def one_row(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
        out = []
        for f in schema:
            v = columns.get(f.name)
            if isinstance(v, np.ndarray):
                v = pa.array(v, f.type.value_type)
            if isinstance(v, pa.Array):
                v = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v, type=f.type)
            out.append(v if isinstance(v, pa.Array) else pa.array([v], f.type))
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Tree = shared.value
        for number, block in enumerate(blocks(batches)):
            name = (TaskContext.get().partitionId() << 20) + number
            ids = block.rows["id"].combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            types = {"word": pa.int64(), "context": pa.int32(), "id": ids.type, "doc": pa.int32(), "base": pa.float64(), "score": pa.float64(), "known": pa.int32(), "tokens": pa.int64()}
            schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), *[(c, pa.list_(t)) for c, t in types.items()]])
            states = model.states(block, model.depth)
            level, state = _longest(model, states)
            chance = np.zeros(len(level))
            for k in range(model.depth + 1):
                own = np.flatnonzero(level == k)
                found = model.pairs[k].find(state[own], block.tokens[own])
                chance[own[found >= 0]] = model.chance[k][found[found >= 0]]
            told, rest = np.flatnonzero(chance), np.flatnonzero(chance == 0)
            many = block.rows.num_rows
            # A frequent pair's word is frequent, so its own count is at hand as well.
            word = model.pairs[0].find(np.zeros(len(told), np.int64), block.tokens[told])
            doc = block.doc[told]
            yield one_row(
                schema, part=(name * 0x9E3779B1 >> 7) % model.parts, block=name, id=ids, doc=np.arange(many), tokens=block.sizes,
                base=np.bincount(doc, np.log10(model.root(model.pairs[0].n[word])) if len(told) else None, many) + 0.0,
                score=np.bincount(doc, np.log10(chance[told]), many), known=np.bincount(doc, minlength=many),
            )
            if len(rest):
                words = block.tokens[rest]
                last = states[1][rest] if model.depth else np.full(len(rest), -1)
                columns = {"word": words.view(np.int64), "context": first[level[rest]] + state[rest], "doc": block.doc[rest]}
                yield _lists(model.part(words, last), columns, schema, block=name)

    def look_up(key: tuple, entries: pa.Table, counts: pa.Table) -> pa.Table:
        model: Tree = shared.value
        levels = [_pairs(counts.filter(pc.equal(counts["level"], k))) for k in range(model.depth + 1)]
        found = [entries.filter(pc.is_null(entries["word"])).select(back.names)]
        for k in np.flatnonzero(entries["word"].is_valid().to_numpy()).tolist():
            row = entries.slice(k, 1)
            word, context = _flat(row, "word").view(np.uint64), _flat(row, "context").astype(np.int64)
            level = np.searchsorted(first, context, "right") - 1
            n = levels[0].counts(np.zeros(len(word), np.int64), word)
            n = np.maximum(n, model.pairs[0].counts(np.zeros(len(word), np.int64), word))
            base = model.root(n)
            chance, up = base.copy(), np.full(len(word), -1)
            chain = []  # of each token, the retained contexts from the longest to the shortest
            for j in range(model.depth, 0, -1):
                longer = np.flatnonzero(up >= 0)
                up[longer] = model.contexts[j + 1].parent[up[longer]] if len(longer) else up[longer]
                own = level == j
                up[own] = context[own] - first[j]
                chain.append((j, up.copy()))
            for j, at in reversed(chain):
                some = np.flatnonzero(at >= 0)
                n_pair = levels[j].counts(at[some], word[some])
                chance[some] = model.smoothed(j, at[some], n_pair, chance[some])
            doc, at = np.unique(_flat(row, "doc"), return_inverse=True)
            found.append(pa.Table.from_batches([one_row(
                found[0].schema, block=row["block"][0].as_py(), doc=doc, base=np.bincount(at, np.log10(base)),
                score=np.bincount(at, np.log10(chance)), known=np.bincount(at[n > 0], minlength=len(doc)),
            )]))
        return pa.concat_tables(found)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        whole = rows.filter(pc.is_valid(rows["id"]))
        ids = pa.concat_arrays([c.flatten() for c in whole["id"].chunks])
        # Added in a fixed order, so that a task that runs again gives the same sums.
        doc, total, base, known = (_flat(rows, c) for c in ("doc", "score", "base", "known"))
        order = np.lexsort((base, total, doc))
        sums = [np.bincount(doc[order], x[order], len(ids)) for x in (base, total)]
        return pa.table({
            id_column: ids, "n_tokens": pa.array(_flat(whole, "tokens")), "n_known": pa.array(np.bincount(doc, known, len(ids)).astype(np.int64)),
            "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
        })

    model_rows = [_kept_only(counted[level], tree, level).withColumn("level", F.lit(level)) for level in range(len(counted))]
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    entries = texts.mapInArrow(run, sent).groupBy("part")
    looked_up = entries.cogroup(reduce(DataFrame.unionAll, model_rows).groupBy("part")).applyInArrow(look_up, back)
    result = StructType([
        StructField(id_column, kind), StructField("n_tokens", LongType()), StructField("n_known", LongType()),
        StructField("base_score", DoubleType()), StructField("score", DoubleType()),
    ])
    return looked_up.groupBy("block").applyInArrow(add, result)


def log_probabilities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """All rows scored by the tree of those that are not held out; ``train_tokens`` tells its size."""
    tree, counted = fit(docs, Scratch(docs.sparkSession), id_column, text_column, **options)
    return score(docs, tree, counted, id_column, text_column).withColumn("train_tokens", F.lit(tree.tokens).cast("bigint"))
