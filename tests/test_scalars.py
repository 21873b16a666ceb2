import json

import pytest
from pyspark.sql import functions as F

from deckspark.functions import formats, scalars as S


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("true", 1), ("false", 0), ('"true"', 1), ('"TRUE"', 1), ('"yes"', 0), ('"1"', 0),
        ("1", 1), ("0", 0), ("0.0", 0), ("0.5", 1), ("-3", 1), ("null", 0),
        ("[]", 0), ("[0]", 1), ("{}", 0), ('{"a": null}', 1), ('""', 0),
    ],
)
def test_flag(spark, value, expected):
    df = spark.sql("SELECT 1").select(F.parse_json(F.lit(value)).alias("v"))
    assert one(df, S.flag(F.col("v"))) == [expected]


def test_flag_of_missing_value(spark):
    df = spark.sql("SELECT CAST(NULL AS VARIANT) AS v")
    assert one(df, S.flag(F.col("v"))) == [0]


def test_color_mask(spark):
    rows = [(["W", "u", " g ", "X", None],), ([],), (None,), (["\tR\u00a0\n", "B"],), (["R", "R"],)]
    df = spark.createDataFrame(rows, "c array<string>")
    assert one(df, S.color_mask(F.col("c"))) == [19, 0, 0, 12, 8]


def test_color_mask_text(spark):
    df = spark.createDataFrame([("W, U",), ("",), (None,), ("g,,x",)], "c string")
    assert one(df, S.color_mask_text(F.col("c"))) == [3, 0, 0, 16]


def test_keywords_match_the_json_module(spark):
    everything = "".join(map(chr, range(1, 128)))
    lists = [["Flying", "Trample"], [], None, ['a "b"', "é\\", "\u0001\u001f/"], [everything], ["💎", "\\u001F\n"]]
    df = spark.createDataFrame([(x,) for x in lists], "k array<string>")
    expected = [json.dumps(x or [], ensure_ascii=False) for x in lists]
    assert one(df, S.json_list_text(F.col("k"))) == expected


def test_image_uri(spark):
    face = "struct<image_uris: map<string,string>>"
    rows = [
        ({"small": "s", "normal": "n"}, None),
        ({"small": "s", "normal": "", "large": "l"}, None),
        ({"small": "s", "normal": ""}, None),
        ({}, [({"large": "fl"},), ({"normal": "x"},)]),
        (None, [({"png": "fp"},)]),
        (None, None),
        (None, []),
        (None, [(None,)]),
        ({"normal": None}, [({"normal": "x"},)]),
    ]
    df = spark.createDataFrame(rows, f"u map<string,string>, f array<{face}>")
    expected = ["n", "l", "s", "fl", "fp", None, None, None, None]
    assert one(df, S.image_uri(F.col("u"), F.col("f"))) == expected


def test_first_filled_takes_the_last_as_it_is(spark):
    rows = [("a", "b", "c"), ("", "b", "c"), (None, "", "c"), ("", None, ""), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    expected = ["a", "b", "c", "", None]
    assert one(df, S.first_filled(F.col("a"), F.col("b"), F.col("c"))) == expected


def test_search_name_and_mode(spark):
    df = spark.createDataFrame([("A // B", True), ("A//B", False), ("A // B // C", None)], "n string, e boolean")
    assert one(df, S.search_name(F.col("n"))) == ["A", "A//B", "A"]
    assert one(df, S.sweep_mode(F.col("e"))) == ["incremental", "full", "full"]


def test_to_instant(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01T12:00:00+02:00",), ("x",)], "t string")
    got = one(df, S.to_instant(F.col("t")).cast("string"))
    assert got == ["2024-05-01 10:00:00", "2024-05-01 10:00:00", None]


def test_formats(spark):
    df = spark.createDataFrame([("commander",), ("pauper",), ("Commander",), (None,)], "f string")
    f = F.col("f")
    assert one(df, formats.known_format(f)) == [True, True, False, False]
    assert one(df, formats.priority(f)) == [0, 2, None, None]
    assert one(df, formats.is_singleton(f)) == [True, False, False, False]
    assert one(df, formats.has_commander_zone(f)) == [True, False, False, False]
