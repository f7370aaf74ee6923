from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import mood as m
from tickerloom.functions import text as tx
from tickerloom.functions import time as tm


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


MOODS = {
    "Very Bullish": [0.7, 1.0], "Bullish": [0.6, 0.3, 0.21], "Neutral": [0.0, 0.2, -0.19],
    "Bearish": [-0.2, -0.21, -0.4, -0.59], "Very Bearish": [-0.6, -0.61, -1.0, float("nan")],
}


def test_mood_cuts(spark):
    pairs = [(v, label) for label, vs in MOODS.items() for v in vs]
    assert column(spark, [v for v, _ in pairs], "double", m.mood_label) == [x for _, x in pairs]
    assert column(spark, [None], "double", m.mood) == [None]


@pytest.mark.parametrize("score", [1.0, 0.5, 0.0, -0.5, -1.0])
def test_mood_fields(spark, score):
    got = column(spark, [score], "double", m.mood)[0]
    assert all(got[f] for f in m.FIELDS)


def test_mood_bucket(spark):
    scores = [None, 0.21, 1.0, -0.21, -1.0, 0.0, 0.2, -0.2, float("nan")]
    assert column(spark, scores, "double", m.mood_bucket) == ["none", "bull", "bull", "bear", "bear", "neutral", "neutral", "neutral", "neutral"]


def test_indicator(spark):
    assert column(spark, [None, 0.5, -0.5, 0.0], "double", m.indicator) == ["No data", "up 0.50", "down -0.50", "flat 0.00"]


AGES = [(0, "just now"), (59, "just now"), (60, "1m ago"), (90, "1m ago"), (59 * 60, "59m ago"), (3600, "1h ago"), (23 * 3600, "23h ago"), (86400, "1d ago"), (7 * 86400, "7d ago"), (-100, "just now")]


def test_relative_age(spark):
    now = datetime(2026, 1, 1, 12)
    got = column(spark, [now - timedelta(seconds=s) for s, _ in AGES], "timestamp", lambda c: tm.relative_age(c, F.lit(now)))
    assert got == [a for _, a in AGES]
    assert column(spark, [None, now], "timestamp", lambda c: tm.status_label(c, F.lit(now))) == ["Never run", "Updated just now"]


def test_time_texts(spark):
    t = [datetime(2026, 1, 5, 7, 8, 9)]
    assert column(spark, t, "timestamp", tm.utc_date) == ["2026-01-05"]
    assert column(spark, t, "timestamp", tm.utc_minute) == ["2026-01-05T07:08"]
    assert column(spark, t, "timestamp", tm.month_day) == ["Jan 5"]
    assert column(spark, [0], "long", lambda c: tm.from_epoch_seconds(c).cast("string")) == ["1970-01-01 00:00:00"]
    assert column(spark, ["2026-01-05T07:08:09Z", "no"], "string", lambda c: tm.from_iso(c).cast("string")) == ["2026-01-05 07:08:09", None]


def test_in_window_is_inclusive_and_keeps_the_future(spark):
    now = datetime(2026, 1, 2)
    rows = [(now - timedelta(hours=h),) for h in (24, 25, -5)]
    df = spark.createDataFrame(rows, "t timestamp")
    assert tm.in_window(df, "t", now, "24h").count() == 2
    assert tm.in_window(df, "t", now, "other").count() == 3


CANDIDATES = {
    "EGL.LS": ["EURONEXT_LISBON"], "BCP.LS": ["EURONEXT_LISBON"], "HSBA.L": ["LSE"], "LVMH.PA": ["EURONEXT_PARIS"], "BMW.DE": ["XETRA"],
    "ASML.AS": ["EURONEXT_AMSTERDAM"], "BTC-USD": ["CRYPTO"], "ETH-USD": ["CRYPTO"], "AAPL": ["NYSE", "NASDAQ"], "MSFT": ["NYSE", "NASDAQ"], "V": ["NYSE", "NASDAQ"],
}


def test_market_candidates(spark):
    assert column(spark, list(CANDIDATES), "string", tx.market_candidates) == list(CANDIDATES.values())


def test_route_feed(spark):
    assert column(spark, ["AAPL", "BRK.B", "BTC-USD", "EDP.LS", "A.B-USD", None], "string", tx.route_feed) == ["primary", "tagged", "none", "tagged", "tagged", None]


def test_emails(spark):
    assert column(spark, [" A@B.Com "], "string", tx.normalise_email) == ["a@b.com"]
    assert column(spark, ["a@b.c", "a@b", "a b@c.d", "", None, "@b.c"], "string", tx.is_email) == [True, False, False, False, False, False]


def test_prompt_numbers_headlines(spark):
    got = column(spark, [["x", "y"]], "array<string>", lambda c: tx.scoring_prompt(F.lit("T"), c))[0]
    assert got.endswith("\n\n1. x\n2. y")


def test_parse_answer(spark):
    raw = ['{"score": 0.4, "summary": "s"}', '```json {"score": 0.4} ```', '{"score": "0.4"}', "no", "", None]
    assert column(spark, raw, "string", lambda c: tx.parse_answer(c)["score"]) == [0.4, None, None, None, None, None]
