import pytest
from pyspark.sql import functions as F

from tickloom.functions import timeexpr as tx

# The instants in this file and what they have to give.
BASE = 1562371200  # 2019-07-06T00:00:00Z


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_bucket_iso(spark):
    assert value(spark, tx.bucket_iso(F.lit(1562371202005), 1)) == "2019-07-06T00:00:02Z"
    assert value(spark, tx.bucket_iso(F.lit(1562371212005), 5)) == "2019-07-06T00:00:10Z"


@pytest.mark.parametrize(
    "seconds, expected",
    [
        (1, "00:12:22"), (5, "00:12:20"), (15, "00:12:15"), (60, "00:12:00"), (300, "00:10:00"), (600, "00:10:00"),
        (180, "00:12:00"), (660, "00:11:00"), (3600, "00:00:00"), (86400, "00:00:00"),
    ],
)
def test_bucket_raster(spark, seconds, expected):
    got = value(spark, tx.iso_instant(tx.bucket_s_to_ms(F.lit(BASE + 12 * 60 + 22), seconds)))
    assert got == f"2019-07-06T{expected}Z"


def test_bucket_starts_anew_each_midnight(spark):
    late = BASE + 65 * 60
    assert value(spark, tx.bucket_s(F.lit(late), 660)) == BASE + 55 * 60
    assert value(spark, tx.bucket_ms(F.lit(-1), 3600)) == -3_600_000
    with pytest.raises(ValueError):
        tx.bucket_s(F.lit(0), 86_401)


def test_minute_of_day(spark):
    second = BASE + 3 * 3600 + 12 * 60 + 22
    assert [value(spark, tx.minute_of_day_s(F.lit(second), n)) for n in (1, 5, 60)] == [192, 190, 180]
    assert value(spark, tx.minute_of_day_ms(F.lit(second * 1000 + 999), 5)) == 190


def test_days_months_minutes(spark):
    assert value(spark, tx.day_of_ms(F.lit(1562371202000))) == "2019-07-06"
    assert value(spark, tx.day_of_s(F.lit(1562371202))) == "2019-07-06"
    assert value(spark, tx.day_of_ts(F.timestamp_seconds(F.lit(1562371680)))) == "2019-07-06"
    assert value(spark, tx.month_of_ms(F.lit(1562371202000))) == "2019-07"
    assert value(spark, tx.month_of_ts(F.timestamp_seconds(F.lit(1562371680)))) == "2019-07"
    assert value(spark, tx.month_of_day(F.lit("2019-07-06"))) == "2019-07"
    for second in (1562371202, 1562371200, 1562371259):
        assert value(spark, tx.minute_iso(F.lit(second))) == "2019-07-06T00:00:00Z"
        assert value(spark, tx.minute_start_s(F.lit(second))) == 1562371200


def test_instants(spark):
    assert value(spark, tx.iso_instant(F.lit(1562371202005))) == "2019-07-06T00:00:02.005Z"
    assert value(spark, tx.provider_time_to_ms(F.lit("2019-04-01T00:01:30.0000000"))) == 1554076890000
    assert value(spark, tx.provider_time_to_ms(F.lit("2019-04-01T00:01:30.1234567"))) == 1554076890123
    assert tx.day_arg_to_ms("2019-07-06") == BASE * 1000
    assert tx.instant_arg_to_ms("2019-07-06T00:00:02.005+00:00") == 1562371202005
    assert tx.ms_to_day_arg(1562371202005) == "2019-07-06"
