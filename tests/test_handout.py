"""Keyed tables, the work log, leases and completions, and sweeps that are cut over several landings."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from deckspark.__main__ import Tables, main
from deckspark.operators.lifecycle import deck_states
from deckspark.operators.paging import cut_landed
from deckspark.operators.stubs import parse_stubs
from deckspark.plans.corpus import build_decks
from deckspark.plans.handout import Handout
from deckspark.schemas import CARD_FORMAT_STATUS, DECKS, SEARCH_PAGE, STUB_LOG, SUBMISSION_LOG, SWEEP_STATE, WORK_LOG
from deckspark.sources.keyed import KeyedTable
from deckspark.streaming.discovery import StubSink
from deckspark.streaming.logs import BatchLog, WorkLog

KEY = ("format", "moxfield_id")
DAY = datetime(2024, 5, 1)


def at(minutes):
    return F.lit(DAY + timedelta(minutes=minutes)).cast("timestamp")


# --- keyed tables ----------------------------------------------------------------------------------


def rows_of(spark, ids, value):
    return spark.createDataFrame([("modern", f"d{k}", value) for k in ids], "format string, moxfield_id string, n int")


def keyed(spark, path, buckets=16):
    return KeyedTable(spark, str(path / "t"), "format string, moxfield_id string, n int", KEY, buckets)


def upsert(table, ids, value, version):
    batch = rows_of(table.spark, ids, value)
    touched = table.touched(batch, below=version)
    stored = table.read(below=version, buckets=touched)
    table.write(stored.join(batch, list(KEY), "left_anti").unionByName(batch), version, buckets=touched)
    return touched, stored


def held(table, below=None):
    return {r["moxfield_id"]: r["n"] for r in table.read(below=below).collect()}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = keyed(spark, tmp_path)
    assert table.read().count() == 0 and table.latest() is None
    table.write(rows_of(spark, range(1000), 0), 1)
    assert len(table.layout()[1]) == 16
    touched, stored = upsert(table, [3, 5000], 7, 2)
    assert 1 <= len(touched) <= 2 and {b for b, v in table.layout()[1].items() if v == 2} == set(touched)
    # The scan of the stored side names the folders of these buckets, and no others are written.
    assert {f.split("bucket=")[1].split("/")[0] for f in stored.inputFiles()} == {str(b) for b in touched}
    assert held(table) == {f"d{k}": 7 if k == 3 else 0 for k in range(1000)} | {"d5000": 7}
    assert held(table, below=2) == {f"d{k}": 0 for k in range(1000)}
    # Repeated, the merge reads what it read before and leaves the same.
    upsert(table, [3, 5000], 7, 2)
    assert len(held(table)) == 1001 and table.versions() == [1, 2]
    # What was written without its manifest does not count, and a later merge replaces it.
    rows_of(spark, [9], 9).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.path}/data/v=3")
    assert len(held(table)) == 1001
    upsert(table, [1], 8, 3)
    assert held(table)["d1"] == 8 and held(table)["d9"] == 0


def test_small_merges_do_not_grow_with_the_table(spark, tmp_path):
    """Ten times the rows in ten times the buckets: a batch reads and writes as many rows."""
    read = {}
    for size in (2000, 20_000):
        (tmp_path / str(size)).mkdir()
        table = keyed(spark, tmp_path / str(size), size // 100)
        table.write(rows_of(spark, range(size), 0), 1)
        _, stored = upsert(table, [1, 2, 3], 1, 2)
        written = spark.read.parquet(f"{table.path}/data/v=2").count()
        read[size] = (stored.count(), written)
    assert all(n <= 2 * m for n, m in zip(read[20_000], read[2000])) and read[20_000][0] < 1000


def test_other_numbers_of_buckets_and_empty_buckets(spark, tmp_path):
    table = keyed(spark, tmp_path, 4)
    table.write(rows_of(spark, range(50), 0), 1)
    wide = keyed(spark, tmp_path, 32)
    assert wide.touched(rows_of(spark, [1], 1)) is None and wide.read().count() == 50
    upsert(wide, [1], 1, 2)
    assert held(wide) == {f"d{k}": int(k == 1) for k in range(50)} and wide.layout()[0] == 32
    assert held(table) == held(wide)
    # A bucket that loses its rows is empty from then on, and so may be the whole table.
    bucket = wide.touched(rows_of(spark, [1], 1))
    wide.write(wide.read(buckets=bucket).filter("false"), 3, buckets=bucket)
    assert "d1" not in held(wide) and wide.read(buckets=bucket).count() == 0
    wide.write(rows_of(spark, [], 0), 4)
    assert held(wide) == {} and wide.latest() == 4 and len(held(wide, below=4)) < 50


def test_vacuum_keeps_what_is_needed(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.write(rows_of(spark, range(200), 0), 1)
    for version in range(2, 6):
        upsert(table, [version], version, version)
    before, last = held(table), held(table, below=5)
    gone = table.vacuum(keep=2)
    assert "manifest/v=1" in gone and any(g.startswith("data/v=1/") for g in gone)
    assert table.versions() == [4, 5] and held(table) == before and held(table, below=5) == last
    assert table.vacuum(keep=2) == []


# --- events ----------------------------------------------------------------------------------------


def submission(seq, card, batch, stub_batches=1, doc=0):
    return ("modern", "d", seq, DAY, False, None, None, [(card, "mainboard", 0, 1)], [], 1, doc, stub_batches, batch, None)


def stub(deck, seq, stamp, batch):
    return (deck, f"n{seq}", "modern", None, 0, None, stamp, None, None, None, 1, seq, 0, batch)


@pytest.mark.parametrize("numbers", [(5, 5), (-3, -3), (-7, 2), (2, -7)])
def test_repeated_and_negative_landing_numbers(spark, numbers):
    """Each submission is one, whatever its number: the deck holds the contents of the one that counts."""
    stubs = spark.createDataFrame([stub("d", 1, DAY, 0), stub("d", 2, DAY + timedelta(1), 1)], STUB_LOG)
    log = [submission(numbers[0], 7, 0), submission(numbers[1], 8, 1, 2)]
    decks, rows = build_decks(stubs, spark.createDataFrame(log, SUBMISSION_LOG))
    assert [(r["status"], r["moxfield_id"]) for r in decks.collect()] == [("done", "d")]
    assert [r["card_id"] for r in rows.collect()] == [8]
    # In one batch the document that was read first counts.
    log = [submission(numbers[0], 7, 0, doc=4), submission(numbers[0], 9, 0, doc=2)]
    decks, rows = build_decks(stubs.filter("batch = 0"), spark.createDataFrame(log, SUBMISSION_LOG))
    assert decks.count() == 1 and [r["card_id"] for r in rows.collect()] == [9]


def test_leases_are_those_of_a_state_machine(spark):
    rng = random.Random(4)
    rows, state = [], {}
    for seq in range(3000):
        key, kind = f"d{rng.randrange(200)}", rng.choice(["discover", "claim", "ok", "err", "claim"])
        stamp = rng.randrange(6) if kind == "discover" else None
        rows.append((key, seq, kind, stamp, None, seq, f"w{seq % 7}"))
        deck = state.get(key)
        if kind == "discover":
            if deck is None or stamp > deck["stamp"]:
                state[key] = {"stamp": stamp, "lease": (None, None)}
            else:
                deck["stamp"] = stamp
        elif kind == "claim" and deck is not None:
            deck["lease"] = (seq, f"w{seq % 7}")
    events = spark.createDataFrame(rows, "k string, seq bigint, kind string, updated_at int, created_at int, ts bigint, holder string")
    for bits in (0, 6, 40):
        got = deck_states(events.withColumn("since", F.col("ts")), ["k"], bits, lease=("since", "holder")).collect()
        assert {r["k"]: (r["since"], r["holder"]) for r in got} == {k: d["lease"] for k, d in state.items()}


def corpus_of(spark, root):
    return Tables(spark, str(root), 4)


def test_deck_leases_survive_builds(spark, tmp_path):
    tables = corpus_of(spark, tmp_path)
    corpus = tables.corpus
    log = STUB_LOG.rpartition(",")[0]
    corpus.stub_log.put(spark.createDataFrame([stub(f"d{k}", k, DAY, 0)[:-1] for k in range(5)], log).withColumn("scraped_at", at(0)), 0)
    corpus.build()
    work = Handout(spark.createDataFrame([], CARD_FORMAT_STATUS), spark.createDataFrame([], "id int, card_name string"), corpus)

    def taken(minutes, worker, request, n=2):
        return sorted(r["moxfield_id"] for r in work.decks(at(minutes), worker, request, n).collect())

    assert taken(0, "a", "r1") == ["d0", "d1"]
    assert taken(5, "b", "r1") == ["d0", "d1"]  # the same request
    assert taken(5, "b", "r2") == ["d2", "d3"]  # no build since: the log holds the leases
    corpus.build()
    held = {r["moxfield_id"]: (r["status"], r["claimed_by"]) for r in corpus.decks.read().collect()}
    assert held == {"d0": ("claimed", "a"), "d1": ("claimed", "a"), "d2": ("claimed", "b"), "d3": ("claimed", "b"), "d4": ("discovered", None)}
    assert taken(29, "c", "r3", 9) == ["d4"]
    assert taken(31, "c", "r4", 9) == ["d0", "d1"]  # thirty minutes are over for the first two
    # A deck found changed is free again, and the lease of another one stays over two more builds.
    corpus.stub_log.put(spark.createDataFrame([stub("d2", 9, DAY + timedelta(1), 1)[:-1]], log).withColumn("scraped_at", at(40)), 1)
    corpus.build()
    corpus.build()
    held = {r["moxfield_id"]: (r["status"], r["claimed_by"]) for r in corpus.decks.read().collect()}
    assert held == {"d0": ("claimed", "c"), "d1": ("claimed", "c"), "d2": ("discovered", None), "d3": ("claimed", "b"), "d4": ("claimed", "c")}


def test_sweeps_cycle(spark, tmp_path):
    """Claims, completions and the turn of the cycle, each under its request."""
    tables = corpus_of(spark, tmp_path)
    units = [(k, "modern", False, False, None, None) for k in (1, 2, 3)]
    cards = spark.createDataFrame([(1, "One"), (2, "Two // Half"), (3, "Three")], "id int, card_name string")
    work = Handout(spark.createDataFrame(units, CARD_FORMAT_STATUS), cards, tables.corpus)

    def sweeps(minutes, request, k=2, worker="a"):
        return sorted((r["card_id"], r["mode"]) for r in work.sweeps(at(minutes), k, worker, request).collect())

    def finish(request, *names):
        done = spark.createDataFrame([(n, "modern") for n in names], "card_name string, format string")
        return [r["card_name"] for r in work.complete(done, "a", at(0), request).collect()]

    assert sweeps(0, "1") == [(1, "full"), (2, "full")]
    assert sweeps(1, "1", 3) == [(1, "full"), (2, "full")]
    assert finish("f1", "One", "Nobody") == ["Nobody"]
    assert finish("f1", "One", "Nobody") == ["Nobody"]
    assert sweeps(2, "2") == [(3, "full")]
    assert sweeps(3, "3") == []  # one is swept, the others are leased, so the cycle turns: none can be leased
    assert {r["card_id"]: (r["swept"], r["ever_swept"], r["claimed_by"]) for r in work.units().collect()} == {
        1: (False, True, "a"), 2: (False, False, "a"), 3: (False, False, "a")
    }
    assert sweeps(31, "4", 3, "b") == [(1, "incremental"), (2, "full")]
    finish("f2", "One", "Two // Half", "Three")
    # A deck that waits holds the cycle up.
    log = STUB_LOG.rpartition(",")[0]
    tables.corpus.stub_log.put(spark.createDataFrame([stub("d", 1, DAY, 0)[:-1]], log), 0)
    tables.corpus.build()
    assert sweeps(70, "5") == [] and all(r["swept"] for r in work.units().collect())
    fetched = spark.createDataFrame([submission(2, 1, 0)], SUBMISSION_LOG).drop("batch")
    tables.corpus.submission_log.put(fetched, 0)
    tables.corpus.build()
    assert sweeps(71, "6", 3) == [(1, "incremental"), (2, "incremental"), (3, "incremental")]
    assert work.log.read().filter("kind = 'reset'").count() == 2


def test_turn_of_the_cycle_is_repeatable(spark, tmp_path):
    """A job that broke off behind the turn goes on from it."""
    tables = corpus_of(spark, tmp_path)
    status = spark.createDataFrame([(1, "modern", True, True, None, None)], CARD_FORMAT_STATUS)
    work = Handout(status, spark.createDataFrame([(1, "One")], "id int, card_name string"), tables.corpus)
    work.log.append(spark.range(1).select(), "reset", "a", at(0), "x/reset")
    assert [tuple(r) for r in work.sweeps(at(1), 1, "a", "x").select("card_id", "mode").collect()] == [(1, "incremental")]
    assert work.log.read().filter("kind = 'reset'").count() == 1


# --- sweeps cut over several landings ----------------------------------------------------------------


def plain_sweeps(pages, known):
    """One page after the other, as a worker reads them: (kept page numbers, finished) per sweep and run."""
    known, kept, done = set(known), defaultdict(list), set()
    run = defaultdict(int)
    for card, mode, page, total, decks in pages:
        run[card] += page == 1
        if (card, run[card]) in done:
            continue
        new = [d for d in decks if d not in known]
        kept[card, run[card]].append(page)
        known |= set(decks)
        if page >= total or len(decks) < 100 or (mode == "incremental" and not new):
            done.add((card, run[card]))
    return dict(kept), done


@pytest.mark.parametrize("cuts", [(1,), (3, 4, 9)])
def test_stream_keeps_the_pages_a_worker_reads(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    pages = []
    for card in ("A", "B", "C"):
        for mode in ("full", "incremental"):
            total = rng.randrange(2, 6)
            for page in range(1, total + 1):
                size = 100 if rng.random() < 0.85 else 40
                old = rng.random() < 0.4 and mode == "incremental"
                decks = [f"{card}{rng.randrange(50) if old else rng.randrange(10**6)}" for _ in range(size)]
                pages.append((card, mode, page, total, decks))
    decks = KeyedTable(spark, str(tmp_path / "found"), DECKS, KEY, 4)
    state = KeyedTable(spark, str(tmp_path / "sweeps"), SWEEP_STATE, ("sweep_card", "sweep_format"), 4)
    finished = []
    sink = StubSink(decks, BatchLog(spark, str(tmp_path / "log"), STUB_LOG), str(tmp_path / "broken"), sweeps=state,
                    finished=lambda rows, batch: finished.extend(r["card_name"] for r in rows.collect()))
    ends = [0, *sorted(c for c in cuts if c < len(pages)), len(pages)]
    schema = f"{SEARCH_PAGE}, _corrupt_record string"
    for batch, (a, b) in enumerate(zip(ends, ends[1:])):
        landed = [
            (c, "modern", m, p, None, seq, t, [(d, None, None, None, None, None, None, None, None, None, None) for d in ids], None)
            for seq, (c, m, p, t, ids) in enumerate(pages[a:b], a)
        ]
        frame = spark.createDataFrame(landed, schema)
        sink.take_pages(frame, batch)
        if batch == 1:
            sink.take_pages(frame, batch)
    kept, done = plain_sweeps(pages, [])
    logged = defaultdict(set)
    run_of = {}
    run = defaultdict(int)
    for seq, (c, _, p, _, _) in enumerate(pages):
        run[c] += p == 1
        run_of[seq] = (c, run[c], p)
    for r in sink.log.read().select("seq").distinct().collect():
        c, n, p = run_of[r["seq"]]
        logged[c, n].add(p)
    assert {k: sorted(v) for k, v in logged.items()} == {k: sorted(v) for k, v in kept.items()}
    assert set(finished) == {c for c, _ in done}


def test_jobs_close_the_loop(spark, tmp_path, capsys):
    """Sweeps are leased, discovered and so completed; the next cycle sweeps them incrementally; decks are leased over a build."""
    root = ["--root", str(tmp_path / "corpus"), "--buckets", "4"]
    export = tmp_path / "cards.json"
    export.write_text(json.dumps([{"name": "Bolt", "id": "1", "legalities": {"modern": "legal"}}]))
    main([*root, "seed", "--export", str(export)])
    main([*root, "sweeps", "--limit", "5", "--worker", "w", "--request", "q1"])
    assert capsys.readouterr().out.count("full") == 2
    main([*root, "sweeps", "--limit", "5", "--worker", "v", "--request", "q2"])
    assert "full" not in capsys.readouterr().out
    (tmp_path / "pages").mkdir()
    pages = [{"card_name": "Bolt", "format": f, "mode": "full", "page": 1, "seq": k, "totalPages": 1,
              "data": [{"publicId": f"d{k}", "lastUpdatedAtUtc": "2024-01-01T00:00:00Z"}]} for k, f in enumerate(("modern", "highlanderCanadian"))]
    (tmp_path / "pages" / "1.json").write_text("\n".join(map(json.dumps, pages)))
    main([*root, "discover", "--landing", str(tmp_path / "pages")])
    main([*root, "build"])
    main([*root, "decks", "--worker", "w", "--request", "q3"])
    main([*root, "build"])
    capsys.readouterr()
    tables = Tables(spark, str(tmp_path / "corpus"), 4)
    assert {(r["swept"], r["ever_swept"]) for r in tables.handout().units().collect()} == {(True, True)}
    assert sorted((r["moxfield_id"], r["claimed_by"]) for r in tables.corpus.decks.read().collect()) == [("d0", None), ("d1", "w")]
    main([*root, "sweeps", "--limit", "5"])
    assert "incremental" not in capsys.readouterr().out  # decks are waiting
    docs = [{"format": f, "moxfield_id": f"d{k}", "seq": 9, "mainboard": {}} for k, f in enumerate(("modern", "highlanderCanadian"))]
    (tmp_path / "details").mkdir()
    (tmp_path / "details" / "1.json").write_text("\n".join(map(json.dumps, docs)))
    main([*root, "submit", "--landing", str(tmp_path / "details")])
    main([*root, "build"])
    capsys.readouterr()
    main([*root, "sweeps", "--limit", "5", "--worker", "w", "--request", "q4"])
    main([*root, "vacuum", "--keep", "1"])
    assert "folders removed" in capsys.readouterr().out
    # Once when nothing was left to lease and no deck was known yet, and once now.
    assert tables.handout().log.read().filter("kind = 'reset'").count() == 2
    with pytest.raises(SystemExit):
        main([*root, "complete", "--card", "Nobody", "--format", "modern"])
