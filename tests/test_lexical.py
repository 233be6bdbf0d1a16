import datetime as dt
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkgml.functions.lexical import BOOL, DATE_, DOUBLE, INTEGER, STRING, TIME_, TIMESTAMP, Misfit, as_type, classify, read_scalar, scale_of, zone_of


@pytest.mark.parametrize("text, exact", [
    ("1", INTEGER | DOUBLE), ("0012", 0), ("-012", 0), ("0", INTEGER | DOUBLE), ("0.5", DOUBLE), ("1.50", DOUBLE), ("true", BOOL), ("True", 0), ("INF", 0), ("NaN", 0),
    ("2021-03-04", DATE_), ("2021-03-04Z", DATE_), ("2021-02-30", 0), ("2021-03-04T10:00:00+02:00", TIMESTAMP), ("10:11:12.5", TIME_), ("10:11:60", 0), ("123456789012345678901", 0), ("1e400", 0), ("a", 0),
])
def test_exact_types(text, exact):
    assert classify(text)[0] == exact | STRING


def test_lossy_types():
    assert classify("1")[1] & BOOL and classify("TRUE")[1] & BOOL
    assert classify("+5")[1] & INTEGER and not classify("+5")[0] & INTEGER


@pytest.mark.parametrize("kind, text, value", [
    ("bigint", "+5", 5), ("bigint", "0012", 12), ("boolean", "1", True), ("boolean", "0", False), ("double", "-INF", -math.inf), ("date", "2021-03-04-05:00", dt.date(2021, 3, 4)),
    ("time", "10:11:60", dt.time(10, 11, 59)), ("timestamp_ntz", "2021-03-04T10:00:00.123456000", dt.datetime(2021, 3, 4, 10, 0, 0, 123456)),
    ("timestamp", "2021-03-04T10:00:00+02:00", dt.datetime(2021, 3, 4, 8, tzinfo=dt.timezone.utc)),
])
def test_read(kind, text, value):
    assert read_scalar(kind, text) == value


@pytest.mark.parametrize("kind, text", [("bigint", "1.0"), ("smallint", "40000"), ("boolean", "yes"), ("double", "inf"), ("date", "2021-13-01"), ("timestamp_ntz", "2021-03-04T10:00:00Z"), ("timestamp", "2021-03-04T10:00:00"), ("timestamp_ntz", "2021-03-04T10:00:00.1234567"), ("date", "2021-03-04+15:00")])
def test_misfits(kind, text):
    with pytest.raises(Misfit):
        read_scalar(kind, text)


@given(st.integers(-(2**63), 2**63 - 1))
def test_integers_round_trip(n):
    assert classify(str(n))[0] & INTEGER and read_scalar("bigint", str(n)) == n


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_floats_round_trip(x):
    assert classify(repr(x))[0] & DOUBLE and read_scalar("double", repr(x)) == x


def test_zone_and_scale():
    assert zone_of("2021-03-04Z") == 0 and zone_of("2021-03-04") is None and zone_of("10:00:00-01:30") == -90 and zone_of("2021-03-04T10:00:00+02:00") == 120
    assert scale_of("1.50") == 2 and scale_of("-3") == 0


def test_column_rules_agree(spark):
    cases = [("bigint", " 0012"), ("bigint", "1.0"), ("boolean", "yes"), ("boolean", "1"), ("double", "-INF"), ("double", "1f"), ("date", "2021-03-04Z"), ("date", "2021-02-30")]
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[as_type(F.lit(t), k).alias(f"c{i}") for i, (k, t) in enumerate(cases)]).first()
    for value, (kind, text) in zip(row, cases, strict=True):
        try:
            want = read_scalar(kind, text.strip())
        except Misfit:
            want = None
        assert value == want, (kind, text)
