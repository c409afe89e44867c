from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators.timestamps import abbreviation_offset, normalise_strings, normalise_timestamps, plan_for, transitions

LOW, HIGH = (int(datetime(*d, tzinfo=timezone.utc).timestamp()) * 1_000_000 for d in ((1990, 1, 1), (2025, 7, 3)))


def utc(text, tz="", mdy=False):
    us, ok = normalise_strings(pa.array([text], pa.string()), np.array([tz], object), np.array([mdy]), LOW, HIGH)
    return (datetime(1970, 1, 1) + timedelta(microseconds=int(us[0]))).isoformat() if ok[0] else None


@pytest.mark.parametrize(
    ("text", "tz", "mdy", "expected"),
    [
        ("2024-02-29T10:00:00Z", "", False, "2024-02-29T10:00:00"),
        ("2023-02-29", "", False, None),
        ("Wed, 07 Jun 2023 07:21:56 +0900", "", False, "2023-06-06T22:21:56"),
        ("9 février 2020 à 11 h 56", "Europe/Paris", False, "2020-02-09T10:56:00"),
        ("10 de setembro de 2024 às 21h37", "America/Sao_Paulo", False, "2024-09-11T00:37:00"),
        ("24. Oktober 2022, 23:47 Uhr", "Europe/Berlin", False, "2022-10-24T21:47:00"),
        ("5 september 2020 om 10:04", "Europe/Amsterdam", False, "2020-09-05T08:04:00"),
        ("04/05/2022 3:00 PM", "", True, "2022-04-05T15:00:00"),
        ("04/05/2022 12:00 AM", "", False, "2022-05-04T00:00:00"),
        ("30.04.21 18:35", "", False, "2021-04-30T18:35:00"),
        ("20240208", "America/New_York", False, "2024-02-08T05:00:00"),
        ("20210517073918", "", False, "2021-05-17T07:39:18"),
        ("20210517T073918Z", "Asia/Kolkata", False, "2021-05-17T07:39:18"),
        ("1672005336.960484", "", False, "2022-12-25T21:55:36.960484"),
        ("631152000", "", False, "1990-01-01T00:00:00"),
        ("1710049512535", "", False, "2024-03-10T05:45:12.535000"),
        ("1620235093881819", "", False, "2021-05-05T17:18:13.881819"),
        ("2020-10-23T11:11:11.123456789Z", "", False, "2020-10-23T11:11:11.123456"),
        ("2020-10-23T11:11:11,9-03:30", "", False, "2020-10-23T14:41:11.900000"),
        ("14 Aug 2022 20:42 UTC-07:00", "", False, "2022-08-15T03:42:00"),
        (' "2021-10-06  03:32:02 GMT"\n', "Europe/London", False, "2021-10-06T03:32:02"),
        ("2020-10-25 02:30:00", "Europe/Berlin", False, "2020-10-25T00:30:00"),  # repeated: first passage
        ("2020-03-29 02:30:00", "Europe/Berlin", False, "2020-03-29T01:30:00"),  # skipped: offset before
        ("2021-03-14 02:30:00", "America/New_York", False, "2021-03-14T07:30:00"),
        ("2021-01-01 10:00:00 IST", "Asia/Kolkata", False, "2021-01-01T04:30:00"),
        ("2021-01-01 10:00:00 EST", "Australia/Sydney", False, "2021-01-01T00:00:00"),
        ("2025-07-03T00:00:00Z", "", False, "2025-07-03T00:00:00"),
        ("2025-07-03T00:00:00.000001Z", "", False, None),
        ("1989-12-31T23:59:59Z", "", False, None),
        ("2020-08-13T42:46:35", "", False, None),
        ("March 2024", "", False, None),
        ("week 12", "", False, None),
        ("", "", False, None),
        ("x" * 10_000, "", False, None),
    ],
)
def test_spellings(text, tz, mdy, expected):
    assert utc(text, tz, mdy) == expected


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1991, 1, 1), datetime(2025, 6, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"]))
def test_local_times_follow_the_zone(when, name):
    when = when.replace(microsecond=0)
    expected = when.replace(tzinfo=ZoneInfo(name), fold=0).astimezone(timezone.utc).replace(tzinfo=None)
    assert utc(when.isoformat(), name) == expected.isoformat()


def test_one_plan_per_shape():
    assert plan_for("9999-99-99A99:99:99A") is plan_for("9999-99-99A99:99:99A")
    assert plan_for("A A") is None
    assert abbreviation_offset("CEST", "Europe/Paris") == 120
    assert len(transitions("Etc/UTC")[0]) == 0


def test_table_with_nulls_repeats_and_clashing_names(spark, rows):
    feed = spark.createDataFrame(
        [(1, "a", "2024-01-01", None, "z"), (1, "a", "2024-01-01", None, "z"), (None, None, "2024-01-01T00:00:00Z", "", "z"), (3, "unknown", None, "nope", None)],
        "item_id bigint, source string, published_at string, created_at string, utc_us string",
    )
    sources = spark.createDataFrame([("a", "Europe/Paris", "DMY"), ("b", None, None), (None, "Europe/Rome", "MDY")], "source string, tz string, date_order string")
    midnight = 1704067200 * 1_000_000
    assert rows(normalise_timestamps(feed, sources)) == sorted([(1, "published_at", midnight - 3600 * 1_000_000), (None, "published_at", midnight)], key=str)
    assert normalise_timestamps(feed.limit(0), sources.limit(0)).count() == 0


def test_strings_of_any_length_and_the_version_of_the_zones(spark):
    rows = [(1, "2021-03-04T05:06:07." + "1" * 200 + "Z"), (2, "2021-03-04" + " " * 300), (3, "2021-03-04 or " + "x" * 500)]
    df = spark.createDataFrame([(i, "s", t) for i, t in rows], "item_id bigint, source string, published_at string")
    sources = spark.createDataFrame([("s", None, "DMY")], "source string, tz string, date_order string")
    got = {r["item_id"]: (r["utc_us"], r["zones"]) for r in normalise_timestamps(df, sources, ("published_at",), version=True).collect()}
    assert set(got) == {1, 2} and got[1][0] == 1614834367111111 and all(z for _, z in got.values())
