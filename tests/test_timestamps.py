from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from strandline.operators import timestamps


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2024-03-10 02:30:00", "America/New_York", us(2024, 3, 10, 7, 30)),
    ("2024-11-03 01:30", "America/New_York", us(2024, 11, 3, 5, 30)),
    ("2021/05/03 11:00:17", "America/Chicago", us(2021, 5, 3, 16, 0, 17)),
    ("2023-10-22T20:55:36-03:00", "UTC", us(2023, 10, 22, 23, 55, 36)),
    ("2024-06-24T05:22:29+0000", "Asia/Shanghai", us(2024, 6, 24, 5, 22, 29)),
    ("Tue, 31 May 2022 12:50:01 GMT", "Asia/Shanghai", us(2022, 5, 31, 12, 50, 1)),
    ("20 February 2025 00:58:10 CST", "Asia/Shanghai", us(2025, 2, 19, 16, 58, 10)),
    ("20 February 2025 00:58:10 CST", "America/Chicago", us(2025, 2, 20, 6, 58, 10)),
    ("Dec 8, 2021 12:44 AM", "UTC", us(2021, 12, 8, 0, 44)),
    ("12. Februar 2023, 12:09 Uhr", "UTC", us(2023, 2, 12, 12, 9)),
    ("18 août 2024 à 06h00", "UTC", us(2024, 8, 18, 6, 0)),
    ("28 de diciembre de 2025, 18:06", "UTC", us(2025, 12, 28, 18, 6)),
    ("2022年3月31日 03:08", "UTC", us(2022, 3, 31, 3, 8)),
    ("20251209T105334Z", "Asia/Tokyo", us(2025, 12, 9, 10, 53, 34)),
    ("1714044865", "Asia/Tokyo", 1714044865000000), ("1673172195726", "UTC", 1673172195726000),
    ("1619243885357910", "UTC", 1619243885357910), ("2024-12-30", "UTC", us(2024, 12, 30)),
    ("2024-13-45", "UTC", None), ("2023-02-30T10:00:00", "UTC", None), ("0000-00-00 00:00:00", "UTC", None),
    ("3 hours ago", "UTC", None), ("刚刚", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("n/a", "No/Where", None),
    ("2024-01-01T00:00:00+99:99", "UTC", None), ("2024-01-01 10:00", None, us(2024, 1, 1, 10)), ("y" * 50000, "UTC", None),
]


@pytest.fixture(scope="module")
def seen(spark):
    df = spark.createDataFrame([(i, v, z, 0) for i, (v, z, _) in enumerate(CASES)], "id long, v string, tz string, source int")
    return {r.row_key: r for r in timestamps.normalise(df, "id", "v", F.col("tz"), F.col("tz")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_instants(seen, i):
    assert seen[i].epoch_us == CASES[i][2], CASES[i]


def test_order_is_learned_from_the_source(spark):
    rows = [(i, f"{13 + i % 15}/{1 + i % 12}/2024 10:00", "a") for i in range(40)] + [(100, "3/4/2024 10:00", "a")]
    rows += [(200 + i, f"{1 + i % 12}/{13 + i % 15}/2024 10:00", "b") for i in range(40)] + [(300, "3/4/2024 10:00", "b"), (400, "3/4/2024 10:00", "c")]
    df = spark.createDataFrame(rows, "id long, v string, s string")
    got = {r.row_key: r for r in timestamps.normalise(df, "id", "v", F.col("s"), F.lit("UTC")).collect()}
    assert got[100].epoch_us == us(2024, 4, 3, 10)
    assert got[300].epoch_us == us(2024, 3, 4, 10)
    assert got[400].status == "ambiguous" and got[400].epoch_us is None


def test_empty(spark):
    df = spark.createDataFrame([], "id long, v string, tz string")
    assert timestamps.normalise(df, "id", "v", F.col("tz"), F.col("tz")).count() == 0
