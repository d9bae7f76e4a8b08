"""Secret scans with multipart credential linking (8), in column expressions and joins only.

Strong parts are reported wherever they are: values assigned to a password, secret, token or key
(``assign``), cloud access identifiers (``access``) and long hex strings (``hex``). Weak parts say little
alone: user or client names (``ident``), long mixed tokens (``blob``) and addresses (``endpoint``). A weak
part is reported only if a part that complements it lies within ``scope`` code points of it: a secret for
an identifier or an endpoint, an identifier or an endpoint for a secret. Parts meet in an interval join:
both sides are dealt to stretches of ``scope`` code points, so a document full of parts is spread, and no
two parts further apart than a scope meet. Weak parts that overlap a strong one are part of it.

Spans come from splitting a text at a pattern: the lengths of what lies between matches and of the
matches, summed up, give every start. Only documents with a match are split; texts are not shuffled.

Defined results: null and empty texts have no parts. Repeated rows are scanned each. Only the id and the
text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import Scratch

SCOPE = 200


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    role: str  # what it is part of: a secret, an identifier or an endpoint
    strong: bool
    group: int = 0  # the group whose length counts
    at_least: int = 0
    holds: str = ""  # what that group must hold besides


# The three base kinds.
KINDS = [
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True, 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", "identifier", True),
    Kind("hex", r"[0-9a-f]{32,}", "secret", True),
    Kind("ident", r"""(?i)(username|user|login|client_id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", "identifier", False, 2, 3),
    Kind("blob", r"[A-Za-z0-9+/=_-]{20,}", "secret", False, holds="[0-9]"),
    Kind("endpoint", r"""https?://[^\s"'<>]+""", "endpoint", False),
]
COMPLEMENT = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def _parts(kind: Kind, number: int) -> Column:
    """Per match: the gap before it, its length, whether it counts. Empty without a match."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split("text", kind.pattern, -1), lambda x: F.length(x))

    def counts(m: Column) -> Column:
        value = F.regexp_extract(m, kind.pattern, kind.group) if kind.group else m
        enough = F.length(value) >= kind.at_least
        return enough & value.rlike(kind.holds) if kind.holds else enough

    found = F.transform(
        F.regexp_extract_all("text", pattern, F.lit(0)),
        lambda m, k: F.struct(
            F.lit(number).alias("kind"), k.alias("k"), F.get(gaps, k).alias("gap"), F.length(m).alias("size"), counts(m).alias("counts")
        ),
    )
    return found


def _found(kind: Kind, number: int) -> Column:
    empty = F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,counts:boolean>>")
    if kind.name == "access":
        some = F.contains(F.col("text"), F.lit("AKIA"))
    elif kind.name == "endpoint":
        some = F.contains(F.col("text"), F.lit("://"))
    else:
        some = F.col("text").rlike(kind.pattern)
    return F.when(some, _parts(kind, number)).otherwise(empty)


def _near(weak: DataFrame, others: DataFrame, scope: int, distance: int, condition: Column) -> DataFrame:
    """Weak parts that lie within ``distance`` of another part under ``condition``; (row, kind, start, end)."""
    stretch = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    a = weak.withColumn("bin", stretch(F.greatest(F.col("start") - distance, F.lit(0)), F.col("end") + distance)).alias("a")
    b = others.select("row", "role", "strong", F.col("start").alias("from"), F.col("end").alias("to"), stretch(F.col("start"), F.col("end")).alias("bin")).alias("b")
    meet = (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin"))
    close = (F.col("from") <= F.col("a.end") + distance) & (F.col("to") >= F.col("a.start") - distance)
    return a.join(b, meet & close & condition, "left_semi").select("row", "kind", "start", "end").distinct()


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row its id and ``parts``: array of (start, kind, end) in order, kinds by their number in
    ``KINDS``, code points, end exclusive."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    found = rows.select("row", "id", F.concat(*[_found(kind, k) for k, kind in enumerate(KINDS)]).alias("found"))
    found = found.select("row", "id", F.inline_outer("found")).repartition(F.col("row"))
    until = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(until)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # Documents without a part keep one row with nulls, so that all come back.
    role = F.element_at(F.array(*[F.lit(x.role) for x in KINDS]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(x.strong) for x in KINDS]), F.col("kind") + 1)
    placed = placed.withColumn("kind", F.when(F.col("counts"), F.col("kind")))
    placed = scratch.table(placed.select("row", "id", "kind", "start", "end", role.alias("role"), strong.alias("strong")))
    parts = placed.filter("kind is not null")
    weak = parts.filter("not strong").select("row", "kind", "start", "end", "role")
    inside = _near(weak, parts.filter("strong"), scope, 0, (F.col("from") < F.col("a.end")) & (F.col("to") > F.col("a.start")))
    complements = F.lit(False)
    for own, wanted in COMPLEMENT.items():
        complements = complements | ((F.col("a.role") == own) & F.col("b.role").isin(*wanted))
    free = scratch.table(weak.join(inside, ["row", "kind", "start", "end"], "left_anti"))
    # A weak part inside a strong one says nothing new, so it complements nothing either.
    others = parts.filter("strong").select("row", "role", "strong", "start", "end").unionByName(
        free.select("row", "role", F.lit(False).alias("strong"), "start", "end")
    )
    linked = _near(free, others, scope, scope, complements)
    reported = placed.select("row", "id", F.when(F.col("strong"), F.struct("start", "kind", "end")).alias("part")).unionByName(
        linked.select("row", F.lit(None).cast(docs.schema[id_column].dataType).alias("id"), F.struct("start", "kind", "end").alias("part"))
    )
    out = reported.groupBy("row").agg(F.max("id").alias("id"), F.array_sort(F.collect_list("part")).alias("parts"))
    return out.select(F.col("id").alias(id_column), "parts")


def written(parts: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(x.name) for x in KINDS])
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
