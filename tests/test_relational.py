import random

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import relational


def by_hand(batch, known, columns):
    """Insert one row after the other."""
    used = {c: {r[c] for r in known} for c in columns}
    accepted, reasons = [], {}
    for row in sorted(batch, key=lambda r: r["n"]):
        taken = [c for c in columns if row[c] is not None and row[c] in used[c]]
        if taken:
            reasons[row["n"]] = f"{taken[0].capitalize()} already registered"
            continue
        accepted.append(row["n"])
        for c in columns:
            used[c].add(row[c])
    return accepted, reasons


@pytest.mark.parametrize("columns", [["email"], ["email", "username"]])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bulk_insert_equals_row_by_row(spark, columns, seed):
    rng = random.Random(seed)
    known = [{"id": 40 + i, "email": f"e{i}", "username": f"u{i}"} for i in range(3)]
    batch = [
        {"n": i, "email": rng.choice([None, *[f"e{k}" for k in range(25)]]), "username": f"u{rng.randrange(25)}"}
        for i in range(60)
    ]
    target = spark.createDataFrame([tuple(r.values()) for r in known], "id long, email string, username string")
    rows = spark.createDataFrame([tuple(r.values()) for r in batch], "n int, email string, username string")
    inserted, rejected = relational.insert_unique(rows, target, columns, ["n"])
    got = inserted.orderBy("id").collect()
    want, reasons = by_hand(batch, known, columns)
    assert [r.n for r in got] == want
    assert [r.id for r in got] == list(range(43, 43 + len(want)))
    assert sorted(r.n for r in rejected.collect()) == sorted(set(range(60)) - set(want))
    assert {r.n: r.reason for r in rejected.collect()} == reasons


@pytest.mark.parametrize("group_rows", [200_000, 40])
def test_long_chains_need_few_rounds(spark, monkeypatch, group_rows):
    """Each row shares a value with the next; with small groups the chain is cut, and grouped anew."""
    monkeypatch.setattr(relational, "GROUP_ROWS", group_rows)
    many = 120
    rows = [(i, f"e{(i + 1) // 2}", f"u{i // 2}") for i in range(many)]
    # A second chain in which the first rows come last in one column, so that nothing is first in all but its head.
    rows += [(1000 + i, f"x{i}", f"x{i - 1}") for i in range(many)]
    batch = [dict(zip(("n", "email", "username"), (n, e, u))) for n, e, u in rows]
    # Names and addresses share no values: tie them the way that a chain needs.
    target = spark.createDataFrame([], "id long, email string, username string")
    df = spark.createDataFrame(rows, "n int, email string, username string")
    inserted, rejected = relational.insert_unique(df, target, ["email", "username"], ["n"])
    want, _ = by_hand(batch, [], ["email", "username"])
    assert [r.n for r in inserted.orderBy("id").collect()] == want
    assert rejected.count() == len(rows) - len(want)


def test_groups_of_conflicts(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "b", 2), (3, "c", 3), (4, None, 3), (5, None, None), (6, None, None), (7, "d", 9)], "_row long, x string, y int")
    got = {r["_row"]: r["_group"] for r in relational.conflict_groups(rows, ["x", "y"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_child_ids_continue_the_stored_ones(spark):
    users = spark.createDataFrame([(1,)], "id long")
    stored = spark.createDataFrame([(41,), (12,)], "id long")
    batch = spark.createDataFrame([("a", 1), ("b", 1)], "title string, owner_id long")
    ok, _ = relational.insert_children(batch, {"owner_id": users}, {}, order=["title"], target=stored)
    assert [(r.id, r.title) for r in ok.orderBy("id").collect()] == [(42, "a"), (43, "b")]


def test_insert_into_an_empty_table(spark):
    target = spark.createDataFrame([], "id long, code string")
    batch = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "code string, n int")
    inserted, _ = relational.insert_unique(batch, target, ["code"], ["n"])
    assert [(r.id, r.n) for r in inserted.orderBy("id").collect()] == [(1, 1), (2, 3)]


def test_children_get_defaults_and_orphans_are_reported(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    courses = spark.createDataFrame([(7,)], "id long")
    batch = spark.createDataFrame(
        [("a", 1, 7, None), ("b", 1, None, True), ("c", 3, 7, None), ("d", 2, 8, None), ("e", None, 7, None)],
        "title string, owner_id long, course_id long, is_completed boolean",
    )
    ok, orphans = relational.insert_children(
        batch, {"owner_id": users, "course_id": courses},
        {"is_completed": F.lit(False), "due_date": F.lit("2024-01-01").cast("timestamp"), "description": F.lit(None).cast("string")},
        required=("owner_id",),
    )
    assert {(r.title, r.is_completed) for r in ok.collect()} == {("a", False), ("b", True)}
    assert all(r.due_date is not None and r.description is None for r in ok.collect())
    assert {r.title for r in orphans.collect()} == {"c", "d", "e"}


def test_nested_lists_are_whole_and_sorted(spark):
    users = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "id int, name string")
    courses = spark.createDataFrame([(7, "math")], "id int, code string")
    lines = [(i, 1 if i < 40 else 2, 7 if i % 2 else None) for i in range(43)] + [(5, 1, 7)] * 8 + [(9, 4, 7)]
    deadlines = spark.createDataFrame(lines, "due int, owner_id int, course_id int")
    lookup = relational.Lookup(courses, "id", "course_id")
    nested = relational.nest_children(users, deadlines, "id", "owner_id", ["due"], lookup).orderBy("id").collect()
    long = relational.child_rows(users, deadlines, "id", "owner_id", ["due"], lookup).collect()
    assert [r.id for r in nested] == [1, 2, 3]
    for r in nested:
        items = [(d.due, d.course.code if d.course else None) for d in r.deadlines]
        want = sorted((due, "math" if c else None) for due, o, c in lines if o == r.id)
        assert items == sorted(items, key=lambda x: x[0]) and sorted(items, key=repr) == sorted(want, key=repr)
        own = sorted((x.position, x.deadline.due) for x in long if x.id == r.id and x.deadline)
        assert own == [(k, due) for k, (due, _) in enumerate(items)]
    assert nested[2].deadlines == []
    assert [(x.position, x.deadline) for x in long if x.id == 3] == [(None, None)]


def test_one_owner_of_very_many_children(spark):
    owners = spark.range(2)
    children = spark.range(250_000).select(F.lit(1).cast("bigint").alias("owner"), "id")
    rows = relational.child_rows(owners, children, "id", "owner", ["id"], name="child")
    found = rows.groupBy("id").agg(F.count("position").alias("n"), F.max("position").alias("last"), F.count_if(F.col("position") != F.col("child.id")).alias("bad"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, None, 0), (1, 250_000, 249_999, 0)]
    nested = relational.nest_children(owners, children, "id", "owner", ["id"])
    assert sorted((r.id, r.n) for r in nested.select("id", F.size("deadlines").alias("n")).collect()) == [(0, 0), (1, 250_000)]


def test_existing_rows_are_split_off(spark):
    batch = spark.createDataFrame([("a",), ("b",), (None,)], "email string")
    accepted, rejected = relational.split_existing(batch, spark.createDataFrame([("a",)], "email string"), "email")
    assert {r.email for r in accepted.collect()} == {"b", None} and [r.email for r in rejected.collect()] == ["a"]
