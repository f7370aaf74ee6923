"""Scoring of headlines by a pluggable model, and what becomes of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_answer, scoring_prompt
from ..functions.time import in_window
from .rank import top_k_per_group

#: Words of the built-in scorer; they count once a headline.
UP = ("gain", "gains", "surge", "surges", "beat", "beats", "rise", "rises", "upgrade", "record", "profit", "growth")
DOWN = ("loss", "losses", "fall", "falls", "miss", "misses", "cut", "cuts", "downgrade", "lawsuit", "fraud", "warning")


def recent_headlines(links: DataFrame, articles: DataFrame, watched: DataFrame, as_of: datetime, n: int = 10, window: str = "7d") -> DataFrame:
    """The latest ``n`` headlines of the window for each watched stock; stocks with none are absent."""
    fresh = in_window(articles, "published_at", as_of, window).select("article_id", "headline", "published_at")
    own = links.join(watched.select("stock_id", "ticker"), "stock_id").join(fresh, "article_id")
    return top_k_per_group(own, ["stock_id"], [F.desc("published_at"), F.asc("article_id")], n)


def build_prompts(headlines: DataFrame) -> DataFrame:
    """(stock_id, ticker, headlines, prompt), one row a stock."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "headline"))), lambda x: x["headline"])
    return headlines.groupBy("stock_id", "ticker").agg(ordered.alias("headlines")).withColumn(
        "prompt", scoring_prompt(F.col("ticker"), F.col("headlines"))
    )


def score(df: DataFrame, scorer: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """(stock_id, ticker, raw, error): answers of ``scorer`` to the prompts, batch by batch.

    A batch that fails is tried again prompt by prompt, so one bad prompt costs only its row.
    """

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = scorer(prompts)
            if len(answers) == len(prompts):
                return [(a, None) for a in answers]
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        except Exception as e:  # any failure of the user's model is a reject
            return [(None, str(e))] if len(prompts) == 1 else [r for p in prompts for r in ask([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            prompts = pdf["prompt"].tolist()
            got = [r for i in range(0, len(prompts), batch) for r in ask(prompts[i : i + batch])]
            yield pdf[["stock_id", "ticker"]].assign(raw=[a for a, _ in got], error=[e for _, e in got])

    kind = df.schema["stock_id"].dataType.simpleString()
    return df.select("stock_id", "ticker", "prompt").mapInPandas(run, f"stock_id {kind}, ticker string, raw string, error string")


def word_score(headlines: Column) -> Column:
    """A number from -1 to 1 by counting words; needs no model. 0 without any such word."""
    words = F.split(F.lower(F.array_join(headlines, " ")), "[^a-z]+")
    ups = F.size(F.filter(words, lambda w: w.isin(*UP)))
    downs = F.size(F.filter(words, lambda w: w.isin(*DOWN)))
    return F.when(ups + downs > 0, (ups - downs) / (ups + downs)).otherwise(F.lit(0.0))


def score_by_words(prompts: DataFrame) -> DataFrame:
    """Answers in the model's format, made with column expressions only."""
    answer = F.to_json(F.struct(word_score(F.col("headlines")).alias("score"), F.lit("word count").alias("summary")))
    return prompts.select("stock_id", "ticker", answer.alias("raw"), F.lit(None).cast("string").alias("error"))


def with_parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("__a", parse_answer(F.col("raw"))).withColumn(
        "__ok", F.coalesce(F.col("__a.score").isNotNull() & ~F.isnan("__a.score"), F.lit(False))
    )


def parse_scores(raw: DataFrame, key: str = "stock_id") -> tuple[DataFrame, DataFrame]:
    """(readings, rejects) of raw answers. Scores are taken as they are; no number is a reject."""
    parsed = with_parsed(raw)
    ok = parsed.where("__ok").select(key, F.col("__a.score").alias("score"), F.col("__a.summary").alias("summary"))
    message = F.coalesce(F.col("error") if "error" in raw.columns else F.lit(None).cast("string"), F.lit("answer has no numeric score"))
    rejects = parsed.where("not __ok").select(F.lit("score").alias("stage"), F.col(key).cast("string").alias("key"), message.alias("message"))
    return ok, rejects
