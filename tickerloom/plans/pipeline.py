"""The full run: feeds to articles, links and readings, with a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, scoring
from ..operators.scope import watched_stocks
from ..sources import schemas
from ..sources.landing import REJECTS, Landed
from ..sources.storage import written, written_and_counted

@dataclass
class RunResult:
    """Rows to append to each table, rejects (stage, key, message), and a one-row report."""

    articles: DataFrame
    links: DataFrame
    readings: DataFrame
    rejects: DataFrame
    report: DataFrame


def _feed(spark: SparkSession, feed: DataFrame | Landed | None, ddl: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a feed."""
    if isinstance(feed, Landed):
        rows, rejects = feed.rows, feed.rejects
    else:
        rows, rejects = feed, spark.createDataFrame([] if feed is not None else [(name, None, "the feed is missing")], REJECTS)
    return rows if rows is not None else spark.createDataFrame([], ddl), rejects


def run_pipeline(
    tables: dict[str, DataFrame], general: DataFrame | Landed | None, company: DataFrame | Landed | None, tagged: DataFrame | Landed | None,
    as_of: datetime, scorer: Callable[[list[str]], list[str]] | None = None, symbols: int = 5,
) -> RunResult:
    """One run over landed feeds; a fixed number of shuffles however many stocks there are.

    ``company`` news has a ticker, ``tagged`` news entities. Of one url the general feed wins,
    then company, then tagged news; within a feed the first to arrive. Articles that were stored
    before are still linked. Company news counts for watched tickers of the primary feed only,
    tagged news for those of the tagged feed, and if it has the ``batch`` of its request, only for
    the ``symbols`` tickers that this asked for. Without a ``scorer`` the word list judges. ``tags``
    counts attempted links, ``saved`` stored articles.

    A feed that is None could not be had: it leaves a reject and the others go on. So do the failed
    requests, torn lines and broken files of a ``Landed`` feed, rows without a url or headline, rows
    that a table would refuse, and prompts without a numeric answer. Each step is written before it
    is used, so nothing is computed twice, and counted as it is written; the result outlives the
    caller's ``scratch``.
    """
    spark = tables["stock"].sparkSession
    watched = written(watched_stocks(tables["stock"], tables["user_stock"]), "watched")
    primary, dotted = watched.where("feed = 'primary'"), watched.where("feed = 'tagged'")
    general, no_general = _feed(spark, general, schemas.NEWS, "general")
    company, no_company = _feed(spark, company, f"{schemas.NEWS}, ticker string", "company")
    entity = "url string, title string, description string, published_at string, source string, entities array<struct<symbol:string>>"
    tagged, no_tagged = _feed(spark, tagged, entity, "tagged")
    general, n_general = written_and_counted(general, "general")
    company, n_company = written_and_counted(company.join(primary.select("ticker"), "ticker", "left_semi"), "company")
    tagged, n_tagged = written_and_counted(tagged, "tagged")
    if "batch" in tagged.columns:
        dotted = written(ingest.request_batches(dotted, symbols), "request-batches")

    general_ok = ingest.normalize_news(ingest.valid_articles(general))
    company_ok = ingest.normalize_news(ingest.valid_articles(company))
    tagged_ok = ingest.normalize_tagged(ingest.valid_articles(tagged, ("url", "title")))
    batch, refused = ingest.split_storable(ingest.union_feeds(general_ok, company_ok, tagged_ok))
    stored = tables["article"]
    new, saved = written_and_counted(ingest.insert_new_articles(stored, batch, ("feed_rank", "pos", "published_at")), "new-articles", keep=True)
    ids = stored.select("url", "article_id").unionByName(new.select("url", "article_id"))

    attempted = ingest.link_primary(company_ok, primary, ids).unionByName(ingest.link_entities(tagged_ok, dotted, ids))
    attempted, tags = written_and_counted(attempted, "attempted-links")
    new_links, linked = written_and_counted(ingest.insert_new_links(tables["article_stock"], attempted), "new-links", keep=True)
    links = tables["article_stock"].select("article_id", "stock_id").unionByName(new_links)
    articles = stored.select("article_id", "headline", "published_at").unionByName(new.select("article_id", "headline", "published_at"))

    prompts = scoring.build_prompts(scoring.recent_headlines(links, articles, watched, as_of))
    raw = written(scoring.score(prompts, scorer) if scorer else scoring.score_by_words(prompts), "answers")
    scored, unscored = scoring.parse_scores(raw)
    readings, sentiments = written_and_counted(ingest.append_sentiment(scored, as_of), "readings", keep=True)

    rejects = no_general.unionByName(no_company).unionByName(no_tagged)
    invalid = [ingest.invalid_articles(f, name, ("url", c)) for f, name, c in ((general, "general", "headline"), (company, "company", "headline"), (tagged, "tagged", "title"))]
    for part in (*invalid, refused, unscored):
        rejects = rejects.unionByName(part)
    rejects = written(rejects, "rejects", keep=True)

    counts = (n_general + n_company + n_tagged, saved, tags, linked, sentiments)
    report = spark.createDataFrame([counts], "fetched long, saved long, tags long, new_links long, sentiments long")
    return RunResult(new, new_links, readings, rejects, report)
