from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deckspark.operators import quality, worklist as L
from deckspark.schemas import CARD_FORMAT_STATUS, CARDS, DECK_CARDS, DECKS

NOW = datetime(2024, 6, 1, 12)


def as_of():
    return F.lit(NOW)


def ago(minutes):
    return None if minutes is None else NOW - timedelta(minutes=minutes)


def units(spark, rows):
    return spark.createDataFrame([(c, f, s, e, ago(m), "w" if m else None) for c, f, s, e, m in rows], CARD_FORMAT_STATUS)


def decks(spark, rows):
    return spark.createDataFrame(
        [(f, i, None, None, 0, None, None, ago(age), None, s, ago(lease), "w" if lease else None, None, None) for f, i, s, age, lease in rows],
        DECKS,
    )


def cards(spark, names):
    return spark.createDataFrame([(i, n) for i, n in names.items()], "id int, card_name string")


STATUS = [
    (9, "modern", False, True, None),
    (5, "pauper", False, False, 31),
    (5, "modern", False, False, 31),
    (4, "modern", False, False, 29),
    (3, "modern", False, False, 30),
    (8, "modern", False, False, None),
    (2, "modern", True, False, None),
    (7, "modern", False, True, 500),
    (1, "modern", False, False, None),
    (6, "modern", False, False, 90),
]


def test_next_sweeps(spark):
    got = [(r["card_id"], r["format"]) for r in L.next_sweeps(units(spark, STATUS), as_of(), 20).collect()]
    assert got == [(1, "modern"), (8, "modern"), (6, "modern"), (5, "modern"), (5, "pauper"), (9, "modern"), (7, "modern")]
    plan = L.next_sweeps(units(spark, STATUS), as_of(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_sweep_worklist(spark):
    names = cards(spark, {1: "A // B", 9: "C"})
    got = {tuple(r) for r in L.sweep_worklist(units(spark, STATUS), names, as_of(), 20).collect()}
    assert got == {(1, "A // B", "A", "modern", "full"), (9, "C", "C", "modern", "incremental")}


DECK_ROWS = [
    ("modern", "old", "discovered", 900, None),
    ("pauper", "p1", "claimed", 50, 29),
    ("pauper", "p2", "done", 60, 700),
    ("pauper", "p3", "claimed", 40, 31),
    ("pauper", "p4", "discovered", 40, None),
    ("pauper", "p5", "discovered", 80, 5),
    ("pauper", "p6", "error", 99, None),
]


def test_deck_worklist(spark):
    df = decks(spark, DECK_ROWS)
    assert [r["moxfield_id"] for r in L.deck_worklist(df, as_of(), 2).collect()] == ["p5", "p3"]
    assert {r["moxfield_id"] for r in L.deck_worklist(df, as_of(), 50).collect()} == {"p5", "p3", "p4"}
    got = {(r["format"], r["moxfield_id"]): r["batch"] for r in L.number_batches(df, as_of(), 2).collect()}
    assert got == {("modern", "old"): 0, ("pauper", "p5"): 0, ("pauper", "p3"): 0, ("pauper", "p4"): 1}


def test_stamps(spark):
    df = decks(spark, DECK_ROWS)
    stamped = L.stamp_leases(df, L.deck_worklist(df, as_of(), 2), ["format", "moxfield_id"], "me", as_of())
    rows = {r["moxfield_id"]: (r["status"], r["claimed_by"]) for r in stamped.collect()}
    assert rows["p5"] == ("claimed", "me") and rows["p3"] == ("claimed", "me")
    assert rows["p4"] == ("discovered", None) and rows["p1"] == ("claimed", "w") and len(rows) == 7
    sweeps = units(spark, STATUS)
    stamped = L.stamp_leases(sweeps, L.next_sweeps(sweeps, as_of(), 1), ["card_id", "format"], "me", as_of())
    assert [r["card_id"] for r in stamped.filter("claimed_by = 'me'").collect()] == [1]


def test_stale_leases_and_drained(spark):
    df = decks(spark, DECK_ROWS)
    assert [tuple(r) for r in L.stale_leases(df, as_of()).collect()] == [("w", 1, ago(31))]
    drained = {r["format"]: (r["pending"], r["drained"]) for r in L.drained_formats(df.filter("moxfield_id <> 'old'").unionByName(decks(spark, [("legacy", "x", "error", 1, None)]))).collect()}
    assert drained == {"pauper": (4, False), "legacy": (0, True)}


def test_completion(spark):
    done = spark.createDataFrame([(1, "modern"), (1, "modern"), (9, "legacy"), (None, "modern")], "card_id int, format string")
    marked, lost = L.complete_sweeps(units(spark, STATUS), done)
    rows = {(r["card_id"], r["format"]): (r["swept"], r["ever_swept"]) for r in marked.collect()}
    assert rows[1, "modern"] == (True, True) and rows[2, "modern"] == (True, False) and rows[9, "modern"] == (False, True)
    assert len(rows) == len(STATUS)
    assert {tuple(r) for r in lost.collect()} == {(9, "legacy"), (None, "modern")}


def test_cycle(spark):
    idle = decks(spark, [("modern", "a", "done", 1, None), ("legacy", "b", "error", 1, None)])
    busy = decks(spark, [("modern", "a", "claimed", 1, 1)])
    leased = units(spark, [(1, "modern", True, True, None), (2, "modern", False, False, 5)])
    open_ = units(spark, [(1, "modern", True, True, None), (2, "modern", False, False, None)])
    assert not L.cycle_is_over(open_, idle, as_of())
    assert not L.cycle_is_over(leased, busy, as_of())
    after = L.next_cycle(leased, idle, as_of())
    assert [(r["swept"], r["ever_swept"]) for r in after.orderBy("card_id").collect()] == [(False, True), (False, False)]
    assert L.next_cycle(leased, busy, as_of()).filter("swept").count() == 1


def test_corpus_report(spark):
    def card(i, name, cmc=0.0):
        return (i, name, *[None] * 4, cmc, *[None] * 6, 0, 0, None, 0, 0, 0, *[None] * 8)

    all_cards = spark.createDataFrame([card(1, "a"), card(2, "a"), card(3, "b", None)], CARDS)
    status = units(spark, [(1, "modern", False, False, None), (1, "modern", False, False, None), (8, "brawl", False, False, None)])
    deck_rows = decks(spark, [("modern", "d", "odd", 1, None), ("pauper", "d", "done", 1, None)]).withColumn("card_ids", F.array(F.lit(1), F.lit(77), F.lit(77)))
    bridge = spark.createDataFrame([("modern", "d", 1, "mainboard", None), ("modern", "d", 9, "mainboard", 1), ("legacy", "d", 1, "mainboard", 1)], DECK_CARDS)
    got = {r["check"]: r["violations"] for r in quality.check_corpus(all_cards, status, deck_rows, bridge).collect()}
    assert {k: v for k, v in got.items() if v} == {
        "cards: one row per name": 1,
        "status: one row per card and format": 1,
        "cards: required columns": 1,
        "deck cards: required columns": 1,
        "status: format": 1,
        "decks: status": 1,
        "status: card exists": 1,
        "deck cards: card exists": 1,
        "deck cards: deck exists": 1,
        "deck arrays: card exists": 4,
    }


def test_delete_and_require(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "card_id int, x string")
    left, rest = quality.delete_with_children(parents, children, parents.filter("id = 2"), ["id"], ["card_id"])
    assert left.count() == 1 and [r["x"] for r in rest.collect()] == ["a"]
    with pytest.raises(ValueError):
        quality.require_cards(parents.filter("false"))
    quality.require_cards(parents)
