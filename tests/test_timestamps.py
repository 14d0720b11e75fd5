"""Mixed time texts against plain Python."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from catalith.operators.timestamps import add_instants, normalise_timestamps

UTC = dt.UTC


def us(*parts, zone="UTC", fold=0, micro=0):
    local = dt.datetime(*parts, micro, tzinfo=ZoneInfo(zone), fold=fold) if len(parts) == 6 else dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return (local - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)


CASES = [
    ("2022-07-28T10:40:41Z", None, None, us(2022, 7, 28, 10, 40, 41)),
    ("2023-04-28T11:38:07.054389+02:00", None, None, us(2023, 4, 28, 9, 38, 7, micro=54389)),
    ("2024-03-11 04:04:59 +1100", None, None, us(2024, 3, 10, 17, 4, 59)),
    ("2025-04-29T04:32:24+01:00[Europe/London]", None, None, us(2025, 4, 29, 3, 32, 24)),
    ("2025-04-29T04:32[Asia/Tokyo]", "Europe/Berlin", None, us(2025, 4, 29, 4, 32, zone="Asia/Tokyo")),
    ("2025-08-13T06:49:53", "Europe/Helsinki", None, us(2025, 8, 13, 6, 49, 53, zone="Europe/Helsinki")),
    ("20240509T215839Z", None, None, us(2024, 5, 9, 21, 58, 39)),
    ("30/04/2021 06:48", "Asia/Kathmandu", "en-GB", us(2021, 4, 30, 6, 48, zone="Asia/Kathmandu")),
    ("04/05/2021 06:48 PM", "America/New_York", "en-US", us(2021, 4, 5, 18, 48, zone="America/New_York")),
    ("04/05/2021 12:48 AM", "America/New_York", "en-US", us(2021, 4, 5, 0, 48, zone="America/New_York")),
    ("04.06.2025 07:41", "Europe/Berlin", "de-DE", us(2025, 6, 4, 7, 41, zone="Europe/Berlin")),
    ("31. Januar 2024, 10:41 Uhr", "Europe/Berlin", "de-DE", us(2024, 1, 31, 10, 41, zone="Europe/Berlin")),
    ("13 de febrero de 2022 20:10", None, "es-ES", us(2022, 2, 13, 20, 10)),
    ("30 août 2023 01h39", "Australia/Sydney", "fr-FR", us(2023, 8, 30, 1, 39, zone="Australia/Sydney")),
    ("July 13, 2023 at 6:10 am", "America/Los_Angeles", "en-US", us(2023, 7, 13, 6, 10, zone="America/Los_Angeles")),
    ("Sun, 31 Dec 2023 15:14:00 GMT", "Europe/Berlin", None, us(2023, 12, 31, 15, 14)),
    ("Tue, 02 Jul 2024 20:18:24 CEST", None, None, us(2024, 7, 2, 18, 18, 24)),
    (" 1629842608\n", None, None, 1629842608_000_000),
    ("1635305064627", None, None, 1635305064627_000),
    ("1635637716339098", None, None, 1635637716339098),
    ("2021-05-06", "Europe/London", None, us(2021, 5, 6, zone="Europe/London")),
    ("2023-10-29 02:30", "Europe/Berlin", None, us(2023, 10, 29, 2, 30, zone="Europe/Berlin")),  # occurs twice: the first
    ("2023-03-26 02:30", "Europe/Berlin", None, us(2023, 3, 26, 1, 30)),  # skipped: offset before the change
    ("2023-13-45T99:00:00Z", None, None, None), ("2023-02-29", None, None, None), ("0000-00-00 00:00:00", None, None, None),
    ("soon", None, None, None), ("", None, None, None), (None, None, None, None), ("2023-01-01 10:00", "Mars/Olympus", None, None),
    ("13:30 PM 2023", None, None, None), ("x" * 20000, None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, z, l) for i, (t, z, l, _) in enumerate(CASES)], "i int, t string, z string, l string")
    got = {r["i"]: r["epoch_us"] for r in add_instants(df, "t", "z", "l").collect()}
    assert {CASES[i][0]: got[i] for i in got} == {c[0]: c[3] for c in CASES}


@pytest.mark.parametrize("policy, text, expected", [
    ({"ambiguous": "second"}, "2023-10-29 02:30", us(2023, 10, 29, 2, 30, zone="Europe/Berlin", fold=1)),
    ({"ambiguous": "second"}, "2023-10-29 05:30", us(2023, 10, 29, 5, 30, zone="Europe/Berlin")),
    ({"skipped": "null"}, "2023-03-26 02:30", None),
])
def test_policies(spark, policy, text, expected):
    df = spark.createDataFrame([(text, "Europe/Berlin", None)], "t string, z string, l string")
    assert add_instants(df, "t", "z", "l", **policy).first()["epoch_us"] == expected
    with pytest.raises(ValueError):
        add_instants(df, "t", "z", "l", ambiguous="perhaps")


def test_sources_and_empty_tables(spark, rows):
    posts = spark.createDataFrame([(1, "a", "2020-01-01", None), (2, "zz", "2020-01-01", "n/a"), (3, None, None, "2020-06-01")], "id int, src string, published string, updated string")
    sources = spark.createDataFrame([("a", "Asia/Tokyo", "en-GB"), ("a", "Asia/Tokyo", "en-GB"), (None, "UTC", None)], "src string, zone string, locale string")
    out = normalise_timestamps(posts, "id", ["published", "updated"], sources, "src", "zone", "locale")
    assert rows(out) == [(1, "published", us(2020, 1, 1, zone="Asia/Tokyo")), (2, "published", us(2020, 1, 1)), (3, "updated", us(2020, 6, 1))]
    assert normalise_timestamps(posts.limit(0), "id", ["published"], sources.limit(0), "src", "zone", "locale").count() == 0
