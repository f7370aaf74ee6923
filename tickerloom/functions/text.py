"""Tickers, e-mail addresses, prompts and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Market names by ticker suffix, tested in this order; the rest is American.
SUFFIX_MARKETS = (
    (".LS", ("EURONEXT_LISBON",)),
    (".L", ("LSE",)),
    (".PA", ("EURONEXT_PARIS",)),
    (".DE", ("XETRA",)),
    (".AS", ("EURONEXT_AMSTERDAM",)),
    ("-USD", ("CRYPTO",)),
)
DEFAULT_MARKETS = ("NYSE", "NASDAQ")

#: Fixed value: the shape of an e-mail address.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def market_candidates(ticker: Column) -> Column:
    """Market names that a ticker may belong to, best first; null for null."""
    names = lambda ms: F.array(*[F.lit(m) for m in ms])
    chain = F.when(ticker.isNull(), F.lit(None))
    for suffix, markets in SUFFIX_MARKETS:
        chain = chain.when(ticker.endswith(suffix), names(markets))
    return chain.otherwise(names(DEFAULT_MARKETS))


def route_feed(ticker: Column) -> Column:
    """Which feed serves a ticker: tagged (has a dot), none (crypto), primary."""
    return F.when(ticker.contains("."), "tagged").when(ticker.endswith("-USD"), "none").when(ticker.isNotNull(), "primary")


def normalise_email(email: Column) -> Column:
    return F.trim(F.lower(email))


def is_email(email: Column) -> Column:
    return F.coalesce(email.rlike(EMAIL), F.lit(False))


def headline_list(headlines: Column) -> Column:
    """An array of headlines as a numbered list, one a line."""
    return F.array_join(F.transform(headlines, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h)), "\n")


def scoring_prompt(ticker: Column, headlines: Column) -> Column:
    """The request for one stock. The wording is ours; the answer's two fields are the contract."""
    return F.concat(
        F.lit("Judge the mood of these news headlines towards the stock "),
        ticker,
        F.lit('.\nAnswer with JSON only: {"score": number from -1.0 to 1.0, "summary": one sentence}.\n\n'),
        headline_list(headlines),
    )


ANSWER = "score double, summary string"


def parse_answer(raw: Column) -> Column:
    """Struct(score, summary) of a model's answer; score is null where it is not a JSON number."""
    return F.from_json(raw, ANSWER)
