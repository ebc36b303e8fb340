"""Column builders: message filter, names, rounding, months, text cells."""

import datetime as dt
import sys

import pytest
from pyspark.sql import functions as F

from agorametrics.functions import cells, months, numbers, text
from agorametrics.options import RpmOptions, parse_rpm_options

FILTER_CASES = [
    ("Hi all", False),
    ("An ordinary sentence without tokens", True),
    ("look at http://site.test/page", False),
    ("https://site.test/some/long/path?with=query&and=more, written at 2024-01-01T00:00:00", False),
    ("<:wave:123456789012345678>", False),
    ("<:wave:123456789012345678> <:wave:123456789012345678>", False),
    ("hello <@!123456789012345678> and welcome", False),
    ("Note: a colon alone is no custom emoji", True),
    ("Meet @ noon, an at sign alone is no tag", True),
    ("98765432109876", False),
    ("9876543210987654", True),
    ("@someone see http://site.test :wave:", False),
    ("exactly 15 char", True),
    ("14 characters!", False),
    ("\U0001f600" * 14, False),
    ("\U0001f600" * 15, True),
    ("upper case HTTP://X is no link", True),
    ("animated <a:name:1> is not caught", True),
    ("comma in the name <:x:1,a> is caught", False),
    ("tag cut by a line feed <@\n>", True),
    ("tag cut by a return <@\r>", False),
    ("emoji cut by a line feed <:a\nb:1>", True),
    ("role tag <@&7> is caught", False),
]


def test_message_filter(spark):
    rows = spark.createDataFrame(FILTER_CASES, "content string, expected boolean")
    wrong = rows.where(text.is_valid_message(F.col("content")) != F.col("expected"))
    assert wrong.collect() == []


def test_filter_parts(spark):
    row = (
        spark.createDataFrame([("http <:a:1> <@1>",)], "c string")
        .select(
            text.has_link(F.col("c")),
            text.has_custom_emoji(F.col("c")),
            text.has_tag(F.col("c")),
            text.is_too_short(F.col("c")),
        )
        .first()
    )
    assert tuple(row) == (True, True, True, False)


def test_blank_is_python_white_space(spark):
    points = [i for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    rows = spark.createDataFrame([(chr(i), chr(i).isspace()) for i in points[:70000]], "c string, s boolean")
    assert rows.where(text.is_blank(F.col("c")) != F.col("s")).count() == 0
    none = spark.createDataFrame([(None,), ("",)], "c string")
    assert none.where(text.is_blank(F.col("c"))).count() == 2


def test_names(spark):
    rows = spark.createDataFrame(
        [(1, None), (2, ""), (3, "Zoë \U0001f389"), (4, "日本"), (5, "plain")],
        "id long, name string",
    )
    got = rows.select(
        "id",
        text.name_or_id(F.col("name"), F.col("id")).alias("display"),
        text.username_without_emoji(F.col("name")).alias("username"),
        text.name_or_id(text.ascii_only(F.col("name")), F.col("id")).alias("label"),
        text.member_name(F.col("name"), F.col("id")).alias("member"),
    )
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1, "User 1", None, "User 1", "User 1"),
        (2, "User 2", "", "User 2", ""),
        (3, "Zoë \U0001f389", "Zoë ", "Zo ", "Zoë \U0001f389"),
        (4, "日本", "", "User 4", "日本"),
        (5, "plain", "plain", "plain", "plain"),
    ]


def test_rounding_is_exact(spark):
    values = [2.675, 0.125, 1.005, 1.015, -0.125, 0.375, 1e15 / 7, -33.335, 0.0, 99.995]
    values += [i / 8 for i in range(-50, 50)] + [n / d for n in range(1, 60) for d in range(1, 60)]
    rows = spark.createDataFrame([(v, round(v, 2), f"{v:.2f}") for v in values], "v double, r double, t string")
    wrong = rows.where(
        (numbers.exact_round(F.col("v"), 2) != F.col("r"))
        | (numbers.fixed_point(F.col("v"), 2) != F.col("t"))
    )
    assert wrong.collect() == []


def test_ratios(spark):
    rows = spark.createDataFrame([(6, 4), (1, 0), (None, 3)], "a long, b long")
    got = rows.select(
        numbers.ratio(F.col("a"), F.col("b")), numbers.ratio_or_zero(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in got] == [(1.5, 1.5), (None, 0.0), (None, 0.0)]


def test_percent_change(spark):
    rows = spark.createDataFrame([(3.0, 0.0), (3.0, 2.0), (3.0, None), (None, 2.0)], "c double, p double")
    got = rows.select(numbers.percent_change(F.col("c"), F.col("p"))).collect()
    assert [r[0] for r in got] == [0.0, 50.0, None, None]


@pytest.mark.parametrize(
    "month, offset, expected",
    [((2024, 1), -1, (2023, 12)), ((2024, 12), 1, (2025, 1)), ((2024, 5), -29, (2021, 12)), ((2024, 5), 0, (2024, 5))],
)
def test_shift_month(spark, month, offset, expected):
    assert months.shift_month(*month, offset) == expected
    row = spark.range(1).select(
        F.year(months.shifted(F.lit(month[0]), F.lit(month[1]), offset)),
        F.month(months.shifted(F.lit(month[0]), F.lit(month[1]), offset)),
    )
    assert tuple(row.first()) == expected


def test_month_ranges_and_labels(spark):
    rows = spark.createDataFrame([(2023, 12), (2024, 1), (2024, 5), (2025, 2)], "year int, month int")
    inside = rows.where(months.from_month(2024, 1) & months.until_month(2025, 1))
    assert [tuple(r) for r in inside.orderBy("month").collect()] == [(2024, 1), (2024, 5)]
    labels = rows.where(months.in_month(2024, 5)).select(
        months.year_month(), months.month_label("MMMM yyyy"), months.month_label("MMM yyyy")
    )
    assert tuple(labels.first()) == ("2024-05", "May 2024", "May 2024")


def test_month_keys_are_utc(spark):
    row = spark.range(1).select(
        *months.month_keys(F.lit(dt.datetime(2024, 1, 31, 23, 59, tzinfo=dt.timezone.utc)))
    )
    assert tuple(row.first()) == (2024, 1)


def test_cells(spark):
    rows = spark.createDataFrame([("a much longer name than fits", 3.14159, 7)], "n string, x double, i long")
    line = rows.select(
        cells.line(
            cells.name_cell(F.col("n")),
            cells.decimal_cell(F.col("x"), 5),
            cells.right_cell(F.col("i"), 5),
            cells.left_cell(F.lit("ab"), 4),
        )
    ).first()[0]
    name = "a much longer name than fits"
    assert line == f"{name[:20]:<20} {3.14159:5.2f} {7:5d} {'ab':<4}"


def test_options():
    assert parse_rpm_options([]) == RpmOptions()
    assert parse_rpm_options(["x", "--least", "--leaderboard"]) == RpmOptions(True, True, False)
    assert parse_rpm_options(["--all", "--other"]) == RpmOptions(all_users=True)
