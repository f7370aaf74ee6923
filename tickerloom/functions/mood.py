"""Sentiment levels and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels from the top, each with the score it must exceed, emoji, label, gradient,
#: chart colour and text style.
LEVELS = (
    (0.6, "🚀", "Very Bullish", "from-emerald-400 to-green-500", "#22c55e", "text-emerald-600 dark:text-emerald-400"),
    (0.2, "📈", "Bullish", "from-green-300 to-emerald-400", "#4ade80", "text-green-600 dark:text-green-400"),
    (-0.2, "😐", "Neutral", "from-slate-500 to-slate-600", "#64748b", "text-slate-500 dark:text-slate-400"),
    (-0.6, "📉", "Bearish", "from-orange-300 to-red-400", "#f97316", "text-orange-600 dark:text-orange-400"),
    (None, "🔻", "Very Bearish", "from-red-400 to-rose-500", "#ef4444", "text-red-600 dark:text-red-400"),
)
FIELDS = ("emoji", "label", "gradient", "chart_color", "text")
BUCKET_CUT = 0.2


def _chain(score: Column, value) -> Column:
    above = None
    for floor, *fields in LEVELS:
        v = value(fields)
        if floor is None:
            return above.otherwise(v)
        # NaN is above everything in Spark but exceeds no cut here
        hit = ~F.isnan(score) & (score > floor)
        above = F.when(hit, v) if above is None else above.when(hit, v)
    raise AssertionError


def mood(score: Column) -> Column:
    """Struct of emoji, label, gradient, chart_color and text; null for a null score.

    Cuts are exclusive: 0.6 is Bullish, -0.2 is Bearish. NaN is Very Bearish.
    """
    level = _chain(score, lambda f: F.struct(*[F.lit(x).alias(n) for n, x in zip(FIELDS, f, strict=True)]))
    return F.when(score.isNotNull(), level)


def mood_label(score: Column) -> Column:
    return F.when(score.isNotNull(), _chain(score, lambda f: F.lit(f[1])))


def mood_bucket(score: Column) -> Column:
    """none for null, else bull over 0.2, bear under -0.2, neutral between and for NaN."""
    return (
        F.when(score.isNull(), "none")
        .when(F.isnan(score), "neutral")
        .when(score > BUCKET_CUT, "bull")
        .when(score < -BUCKET_CUT, "bear")
        .otherwise("neutral")
    )


def indicator(score: Column) -> Column:
    """A watchlist row's badge: ``No data``, or trend and score with two digits."""
    trend = F.when(mood_bucket(score) == "bull", "up").when(mood_bucket(score) == "bear", "down").otherwise("flat")
    return F.when(score.isNull(), "No data").otherwise(F.format_string("%s %.2f", trend, score))
