from datetime import UTC, datetime

import pytest

from lineweave.functions.timestamps import ABSOLUTE, LOCAL, NO_YEAR, match_timestamp, with_local, with_utc


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        ("2023-01-01T00:00:01.735980323Z", ABSOLUTE, us(2023, 1, 1, 0, 0, 1, 735980)),
        ("2025-03-29 23:58:33,229", LOCAL, us(2025, 3, 29, 23, 58, 33, 229000)),
        ("2024-08-26 05:19", LOCAL, us(2024, 8, 26, 5, 19)),
        ("2023-06-24T07:12:16.471+0000", ABSOLUTE, us(2023, 6, 24, 7, 12, 16, 471000)),
        ("2024-03-31T01:17:35+01:00", ABSOLUTE, us(2024, 3, 31, 0, 17, 35)),
        ("2023-11-05 01:27:38 MST", ABSOLUTE, us(2023, 11, 5, 8, 27, 38)),
        ("1672531201871493149", ABSOLUTE, 1672531201871493),
        ("1672531763318", ABSOLUTE, 1672531763318000),
        ("1698538027.268", ABSOLUTE, 1698538027268000),
        ("20231029-050337", LOCAL, us(2023, 10, 29, 5, 3, 37)),
        ("20230705T211820Z", ABSOLUTE, us(2023, 7, 5, 21, 18, 20)),
        ("12/24/2024 05:16:51 PM", LOCAL, us(2024, 12, 24, 17, 16, 51)),
        ("12/24/2024 12:16:51 AM", LOCAL, us(2024, 12, 24, 0, 16, 51)),
        ("12.03.2024 09:42:25", LOCAL, us(2024, 3, 12, 9, 42, 25)),
        ("11-Mär-2023 12:12:28", LOCAL, us(2023, 3, 11, 12, 12, 28)),
        ("Sun, 01 Jan 2023 03:39:10 GMT", ABSOLUTE, us(2023, 1, 1, 3, 39, 10)),
        ("01/Jan/2023:00:00:37 +0530", ABSOLUTE, us(2022, 12, 31, 18, 30, 37)),
        ("Jun  4 15:02:33", NO_YEAR, us(2000, 6, 4, 15, 2, 33)),
    ],
)
def test_formats(text, kind, expected):
    assert match_timestamp(text) == (len(text), kind, expected)


@pytest.mark.parametrize("text", ["2024-13-41 25:61:00", "2023-02-29 00:00:00", "31/Feb/2023:00:00:00 +0000"])
def test_impossible(text):
    assert match_timestamp(text)[2] is None


@pytest.mark.parametrize("text", ["", "10.0.0.1 - -", "version 1.2.3", "12345", "ab12-34"])
def test_none(text):
    assert match_timestamp(text) is None


def test_zones_and_years(spark):
    local = us(2024, 10, 27, 2, 30)
    data = [
        (1, LOCAL, local, "Europe/Berlin", None), (2, LOCAL, local, None, None), (3, LOCAL, local, "Nowhere/City", None), (4, ABSOLUTE, 7, "Asia/Tokyo", None),
        (5, NO_YEAR, us(2000, 3, 1, 0, 0), "UTC", "2023-03-02"), (6, NO_YEAR, us(2000, 2, 29, 0, 0), "UTC", "2023-03-02"), (7, NO_YEAR, us(2000, 3, 1, 0, 0), "UTC", None), (8, LOCAL, us(2024, 3, 31, 2, 30), "Europe/Berlin", None),
        (9, LOCAL, us(2024, 4, 7, 1, 45), "Australia/Lord_Howe", None),
    ]
    df = spark.createDataFrame(data, "i int, kind int, us long, zone string, first_day string")
    got = {r.i: (r.early_us, r.late_us) for r in with_utc(with_local(df, "kind", "us", "zone", "first_day")).collect()}
    hour = 3_600_000_000
    assert got[1] == (local - 2 * hour, local - hour)
    assert got[2] == got[3] == (local, None)
    assert got[4] == (7, None)
    assert got[5] == (us(2024, 3, 1), None)
    assert got[6] == (us(2024, 2, 29), None)
    assert got[7] == (None, None)
    assert got[8] == (us(2024, 3, 31, 1, 30), None)  # skipped by the clocks: moved on
    assert got[9][1] - got[9][0] == hour // 2
