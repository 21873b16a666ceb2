import json

from pyspark.sql import functions as F

from deckspark.__main__ import Tables, main
from deckspark.operators.stubs import fold_stubs, upsert_stubs
from deckspark.schemas import DECKS, STUB_LOG
from deckspark.sources.snapshots import SnapshotTable

KEY = ("format", "moxfield_id")


def deck_frame(spark, n):
    ids = spark.range(n).select(F.lit("modern").alias("format"), F.concat(F.lit("d"), "id").alias("moxfield_id"), F.lit("done").alias("status"))
    names = spark.createDataFrame([], DECKS).schema
    return ids.select(*[F.col(f.name) if f.name in ids.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names])


def test_bucketed_decks_are_merged_without_moving_them(spark, tmp_path):
    def table():
        return SnapshotTable(spark, str(tmp_path / "decks"), DECKS, bucket_by=KEY, buckets=4)

    decks = table()
    decks.write(deck_frame(spark, 500), 1)
    stub = ("d3", "new", "modern", None, 1, None, None, None, None, None, 1, 7, 0, 0)
    fresh = ("e1", "new", "modern", None, 1, None, None, None, None, None, 1, 8, 0, 0)
    folded = fold_stubs(spark.createDataFrame([stub, fresh], STUB_LOG))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = upsert_stubs(decks.read(), folded)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        stored = plan[plan.index("SortMergeJoin"):].split(":- ")[1].split("+- Sort")[0]
        assert "Bucketed: true" in stored and "Exchange" not in stored
        after = decks.write(merged, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert after.count() == 501 and after.filter("name = 'new'").count() == 2
    # A session that has not written the version reads it all the same.
    spark.sql(f"DROP TABLE {decks._table(2)}")
    assert table().read().count() == 501 and table().read(below=2).count() == 500
    decks.write(deck_frame(spark, 20), 2)
    assert table().read().count() == 20


def test_other_bucket_counts_keep_all_rows(spark, tmp_path):
    def table(buckets):
        return SnapshotTable(spark, str(tmp_path / "decks"), DECKS, bucket_by=KEY, buckets=buckets)

    table(8).write(deck_frame(spark, 500), 1)
    stub = ("e1", "new", "modern", None, 1, None, None, None, None, None, 1, 8, 0, 0)
    folded = fold_stubs(spark.createDataFrame([stub], STUB_LOG))
    other = table(4)
    assert other.write(upsert_stubs(other.read(), folded), 2).count() == 501
    assert table(8).read().count() == 501 and table(16).read(below=2).count() == 500
    assert other.versions() == [1, 2]


def test_jobs_end_to_end(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "corpus"), "--buckets", "4"]
    export = tmp_path / "cards.json"
    legal = {"legalities": {"modern": "legal"}}
    export.write_text(json.dumps([{"name": "Bolt", "id": "1", **legal}, {"name": "Ice // Fire", "id": "2"}, {"name": "Bolt", "id": "3"}]))
    main([*root, "seed", "--export", str(export)])
    assert "2 inserted, 0 updated, 1 repeated names dropped" in capsys.readouterr().out
    main([*root, "info"])
    assert "highlanderCanadian|2" in capsys.readouterr().out
    main([*root, "sweeps", "--limit", "9"])
    shown = capsys.readouterr().out
    assert "Ice // Fire" in shown and "|Ice " in shown and "full" in shown

    (tmp_path / "pages").mkdir()
    page = {"card_name": "Bolt", "format": "modern", "mode": "full", "page": 1, "seq": 1, "totalPages": 1,
            "data": [{"publicId": "a", "lastUpdatedAtUtc": "2024-01-01T00:00:00Z"}, {"publicId": "b"}, {"publicId": "c", "format": "commander"}]}
    (tmp_path / "pages" / "1.json").write_text(json.dumps(page))
    main([*root, "discover", "--landing", str(tmp_path / "pages")])
    (tmp_path / "details").mkdir()
    docs = [
        {"format": "modern", "moxfield_id": "a", "seq": 2, "mainboard": {"x": {"quantity": 4, "card": {"name": "Bolt"}}, "y": {"card": {"name": "Void"}}}},
        {"format": "commander", "moxfield_id": "c", "seq": 3, "commanders": {"x": {"card": {"name": "Bolt"}}}},
    ]
    (tmp_path / "details" / "1.json").write_text("\n".join(json.dumps(d) for d in docs))
    main([*root, "submit", "--landing", str(tmp_path / "details")])
    main([*root, "build"])
    capsys.readouterr()
    main([*root, "decks"])
    shown = capsys.readouterr().out
    assert "|b " in shown and "|a " not in shown
    main([*root, "check"])
    report = [line.split("|")[1:3] for line in capsys.readouterr().out.splitlines() if line.startswith("|")][1:]
    assert len(report) == 15 and all(v.strip() == "0" for _, v in report)
    corpus = Tables(spark, str(tmp_path / "corpus"), 4).corpus
    rows = corpus.deck_cards.read().collect()
    assert [(r["moxfield_id"], r["card_id"], r["quantity"]) for r in rows] == [("a", 1, 4)]
    deck = corpus.decks.read().filter("moxfield_id = 'c'").first()
    assert (deck["card_ids"], deck["commander_ids"], deck["status"]) == ([1], [1], "done")

    # A card that was unknown is seeded: the deck that names it is what a fresh submission would make it, the other one is left alone.
    export.write_text(json.dumps([{"name": "Void", "id": "9"}]))
    main([*root, "seed", "--export", str(export)])
    capsys.readouterr()
    main([*root, "resolve"])
    main([*root, "resolve"])
    assert capsys.readouterr().out.splitlines()[-2:] == ["1 decks changed", "0 decks changed"]
    rows = corpus.deck_cards.read().collect()
    assert sorted((r["moxfield_id"], r["card_id"], r["quantity"]) for r in rows) == [("a", 1, 4), ("a", 3, 1)]
    assert corpus.open_decks.read().isEmpty() and corpus.decks.read().count() == 3
    # What no kept version needs goes; the tables stay as they are.
    main([*root, "vacuum", "--keep", "1"])
    assert corpus.builds.versions() == [2] and Tables(spark, str(tmp_path / "corpus"), 4).cards.read().count() == 3
    assert corpus.deck_cards.read().count() == 2
