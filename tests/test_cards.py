import json

import pytest
from pyspark.sql import functions as F

from deckspark.operators import cards as C
from deckspark.operators import skew
from deckspark.operators.ordered import global_row_number
from deckspark.plans.seed import seed_cards, seed_from_manifest, table_stats
from deckspark.schemas import CARD_FORMAT_STATUS, CARDS
from deckspark.sources.cards import export_path, land_export, read_array, read_export, read_manifest
from deckspark.sources.snapshots import SnapshotTable, with_default

EXPORT = [
    {"name": "Bolt", "id": "b1", "cmc": 1, "colors": ["R"], "color_identity": ["R"], "reserved": "true",
     "keywords": ["Flying", "Trample"], "image_uris": {"small": "s", "normal": "n"}, "power": "1",
     "legalities": {"commander": "legal", "modern": "legal", "vintage": "restricted"}},
    {"name": "Fire // Ice", "id": "f1", "oracle_id": "o", "cmc": None, "reserved": True,
     "card_faces": [{"image_uris": {"large": "front"}}, {"image_uris": {"normal": "back"}}]},
    {"name": "Bolt", "id": "b2", "cmc": 2},
    {"name": "", "id": "x1"},
    {"id": "x2"},
    {"name": None, "id": "x3"},
    {"name": "Broken", "colors": 7},
    {"name": "Bolt", "id": "b3"},
    {"name": "bolt", "id": "lower", "cmc": 0.5, "game_changer": 1, "textless": [],
     "legalities": {"pauper": "legal", "legacy": "banned"}},
]


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "cards.json"
    path.write_text(json.dumps(EXPORT))
    return str(path)


def test_read_and_parse(spark, export, tmp_path):
    raw = land_export(spark, export, str(tmp_path / "landed"))
    good, bad = C.split_corrupt(raw)
    assert bad.count() == 1 and "Broken" in bad.first()[0]
    parsed = C.parse_cards(good)
    first = {r["scryfall_id"]: r for r in parsed.collect()}
    bolt = first["b1"]
    assert (bolt["cmc"], bolt["color_mask"], bolt["reserved"], bolt["textless"]) == (1.0, 8, 1, 0)
    assert bolt["keywords_json"] == '["Flying", "Trample"]' and bolt["image_uri"] == "n"
    assert (bolt["legal_commander"], bolt["legal_vintage"], bolt["legal_pauper"]) == ("legal", "restricted", None)
    assert bolt["oracle_id"] is None and bolt["power"] == "1"
    fire = first["f1"]
    assert (fire["cmc"], fire["image_uri"], fire["keywords_json"], fire["reserved"]) == (0.0, "front", "[]", 1)
    assert first["lower"]["game_changer"] == 1 and first["lower"]["cmc"] == 0.5
    assert first["x2"]["card_name"] == ""


def test_first_of_name_and_collisions(spark, export):
    parsed = C.parse_cards(read_export(spark, export))
    kept = {r["card_name"]: r["scryfall_id"] for r in C.first_of_name(parsed).collect()}
    assert kept["Bolt"] == "b1" and kept["bolt"] == "lower"
    assert "" not in kept and None not in kept
    assert C.count_collisions(parsed).first()[0] == 2


def test_file_order_over_several_files(spark, tmp_path):
    """The first card of a name is in the first file, though the second one is larger and read before."""
    parts = tmp_path / "parts"
    parts.mkdir()
    (parts / "a.json").write_text(json.dumps({"name": "Bolt", "id": "first"}) + "\n")
    rest = [{"name": "Bolt", "id": "second"}] + [{"name": f"c{i}", "id": str(i)} for i in range(2000)]
    (parts / "b.json").write_text("\n".join(json.dumps(c) for c in rest))
    parsed = C.parse_cards(read_export(spark, str(parts), lines=True))
    kept = {r["card_name"]: r["scryfall_id"] for r in C.first_of_name(parsed).collect()}
    assert kept["Bolt"] == "first" and len(kept) == 2001


def test_landing_is_reused(spark, export, tmp_path):
    landed = str(tmp_path / "landed")
    before = land_export(spark, export, landed).count()
    (tmp_path / "cards.json").write_text("[]")
    assert land_export(spark, export, landed).count() == before


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"data": [{"type": "all_cards", "download_uri": "u1"}, {"type": "oracle_cards", "download_uri": "u2"}]}))
    manifest = read_manifest(spark, str(path))
    assert export_path(manifest) == "u2"
    with pytest.raises(ValueError, match="all_cards.*oracle_cards"):
        export_path(manifest, "nope")


def tables(spark, tmp_path):
    return (
        SnapshotTable(spark, str(tmp_path / "cards"), CARDS),
        SnapshotTable(spark, str(tmp_path / "status"), CARD_FORMAT_STATUS),
    )


def test_seed_twice(spark, export, tmp_path):
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"data": [{"type": "oracle_cards", "download_uri": export}]}))
    cards, status = tables(spark, tmp_path)
    done = seed_from_manifest(spark, str(manifest), str(tmp_path / "landed"), cards, status, 1)
    assert tuple(done) == (0, 3, 2)
    ids = {r["card_name"]: r["id"] for r in cards.read().collect()}
    assert ids == {"Bolt": 1, "Fire // Ice": 2, "bolt": 3}
    units = {(r["card_id"], r["format"]) for r in status.read().collect()}
    assert units == {
        (1, "commander"), (1, "highlanderCanadian"), (1, "modern"),
        (2, "highlanderCanadian"), (3, "highlanderCanadian"), (3, "pauper"),
    }

    again = [{"name": "Zap", "id": "z"}, {"name": "Bolt", "id": "new", "legalities": {"legacy": "legal"}}, {"name": "Ant", "id": "a"}]
    (tmp_path / "second.json").write_text(json.dumps(again))
    raw = land_export(spark, str(tmp_path / "second.json"), str(tmp_path / "landed2"))
    assert tuple(seed_cards(raw, cards, status, 2)) == (1, 2, 0)
    rows = {r["card_name"]: r for r in cards.read().collect()}
    assert {n: r["id"] for n, r in rows.items()} == {**ids, "Zap": 4, "Ant": 5}
    assert rows["Bolt"]["scryfall_id"] == "new" and rows["Bolt"]["legal_commander"] is None
    assert rows["bolt"]["scryfall_id"] == "lower"
    # A known card gets no new unit, unless asked for.
    assert status.read().filter("card_id = 1").count() == 3
    assert status.read().filter("card_id IN (4, 5)").count() == 2
    seed_cards(raw, cards, status, 3, refresh_all=True)
    assert {r["format"] for r in status.read().filter("card_id = 1").collect()} == {
        "commander", "highlanderCanadian", "modern", "legacy",
    }
    # A repeated version is the same again.
    seed_cards(raw, cards, status, 2)
    assert cards.read(below=3).count() == 5 and cards.versions() == [1, 2, 3]

    total, per_format = table_stats(cards.read(), status.read(below=3))
    assert total.first()["total"] == 5 and not total.first()["empty"]
    assert per_format.first()["format"] == "highlanderCanadian" and per_format.first()["n"] == 5


def test_global_row_number_is_dense(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = {(r["g"], r["k"]): r["n"] for r in global_row_number(df, ["k"], within=("g",), out="n").collect()}
    for g in range(3):
        keys = sorted(k for gg, k in got if gg == g)
        assert [got[(g, k)] for k in keys] == list(range(1, len(keys) + 1))
    flat = {r["k"]: r["n"] for r in global_row_number(df, ["k"], out="n").collect()}
    assert flat == {k: k + 1 for k in range(5000)}


def test_lookup_paths_agree(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("card_name"),
        F.col("id").alias("n"),
    ).unionByName(spark.createDataFrame([(None, -1)], "card_name string, n bigint"))
    cards = spark.createDataFrame([("hot", 1)] + [(f"c{i}", i + 2) for i in range(40)], "card_name string, id int")
    small = {(r["n"], r["card_id"]) for r in C.resolve_names(rows, cards).collect()}
    large = C.resolve_names(rows, cards, broadcast_bytes=-1, hot_rows=500)
    assert {(r["n"], r["card_id"]) for r in large.collect()} == small
    assert large.count() == 3001
    units = spark.createDataFrame([(1,), (5,), (99,)], "card_id int")
    for limit in (skew.BROADCAST_BYTES, -1):
        got = C.names_of(units, cards, broadcast_bytes=limit).collect()
        assert {(r["card_id"], r["card_name"]) for r in got} == {(1, "hot"), (5, "c3")}


def test_card_usage(spark):
    entries = spark.createDataFrame([("a", 2), ("a", 1), ("b", 4), ("z", 1)], "card_name string, quantity int")
    cards = spark.createDataFrame([("a", 1), ("b", 2)], "card_name string, id int")
    got = {r["card_name"]: (r["card_id"], r["entries"], r["copies"]) for r in C.card_usage(entries, cards).collect()}
    assert got == {"a": (1, 2, 3), "b": (2, 1, 4), "z": (None, 1, 1)}


def test_column_added_later(spark):
    old = spark.createDataFrame([(1,)], "card_id int")
    assert with_default(old, "ever_swept", False).first()["ever_swept"] is False
    partly = spark.createDataFrame([(1, None), (2, True)], "card_id int, ever_swept boolean")
    assert [r[1] for r in with_default(partly, "ever_swept", False).collect()] == [False, True]


def test_defaults_of_columns_added_later(spark, tmp_path):
    """Old versions read the default, nulls of a new version stay."""
    path = str(tmp_path / "s")
    SnapshotTable(spark, path, "k int").write(spark.range(2).select(F.col("id").cast("int").alias("k")), 1)
    table = SnapshotTable(spark, path, "k int, b boolean, s string", defaults={"b": "false"})
    assert sorted(map(tuple, table.read().collect())) == [(0, False, None), (1, False, None)]
    table.write(table.read().withColumn("b", F.when(F.col("k") == 0, True)), 2)
    assert sorted(map(tuple, table.read().collect())) == [(0, True, None), (1, None, None)]


def test_upsert_reads_each_side_once(spark, tmp_path):
    spark.range(5).selectExpr("CAST(id AS int) id", "concat('c', id) card_name", "id n").write.parquet(str(tmp_path / "old"))
    spark.range(3, 9).selectExpr("concat('c', id) card_name", "id * 10 n", "id ordinal").write.parquet(str(tmp_path / "new"))
    old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("old", "new"))
    plan = C.mark_changes(old, new)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 2
    got = sorted((r["card_name"], r["id"], r["n"], r["change"]) for r in C.upsert_cards(old, new).collect())
    assert got == [(f"c{k}", k, k, "kept") for k in range(3)] + [(f"c{k}", k, 10 * k, "updated") for k in (3, 4)] + [
        (f"c{k}", k, 10 * k, "inserted") for k in range(5, 9)
    ]


def test_array_is_read_by_several_tasks(spark, tmp_path):
    """Cuts fall inside strings, escapes and nested objects; cards and ordinals are those of one task."""
    cards = EXPORT + [
        {"name": f'n{i} }} {{ "q" \\ \\" , [', "id": str(i), "legalities": {"modern": "legal"}, "image_uris": {"small": "{" * (i % 5)},
         "keywords": ["}", '"', "\\", "é€"]} for i in range(300)
    ]
    path = tmp_path / "big.json"
    path.write_text(json.dumps(cards, indent=1, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
        many = {r["ordinal"]["row"]: r for r in read_array(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    one = {r["ordinal"]["row"]: r for r in read_export(spark, str(path)).collect()}
    assert parts > 4 and set(many) == set(one) == set(range(len(cards)))
    for number, row in one.items():
        if row["_corrupt_record"] is None:
            assert str(many[number]) == str(row)
        else:
            assert "Broken" in many[number]["_corrupt_record"]


@pytest.mark.parametrize("text, names, broken", [
    ("[]", [], 0), ("", [], 0), (" [ ] \n", [], 0), ('[{"name":"a"}]', ["a"], 0), ('{"name":"a"}\n{"name":"b"}', ["a", "b"], 0),
    ('[{"name":"a"},{"name":"b', ["a"], 1), ('[{"name":"a"}, 7, {"name":"b"}]', ["a"], 1), ('[{"name":"a","x":{}}\n,\n{"name":"}"}]\n', ["a", "}"], 0),
])
def test_odd_arrays(spark, tmp_path, text, names, broken):
    path = tmp_path / "odd.json"
    path.write_text(text)
    good, bad = C.split_corrupt(read_array(spark, str(path)).persist())
    assert [r["name"] for r in good.orderBy("ordinal").collect()] == names and bad.count() == broken
