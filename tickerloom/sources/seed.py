"""Seed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markets (name, description).
MARKETS = (
    ("NYSE", "New York Stock Exchange"),
    ("NASDAQ", "National Association of Securities Dealers"),
    ("LSE", "London Stock Exchange"),
    ("CRYPTO", "Cryptocurrency"),
    ("FOREX", "Foreign Exchange"),
    ("EURONEXT_LISBON", "Euronext Lisbon (PSI)"),
)

#: Stocks (ticker, name, market).
STOCKS = (
    ("AAPL", "Apple Inc.", "NASDAQ"),
    ("MSFT", "Microsoft Corporation", "NASDAQ"),
    ("GOOGL", "Alphabet Inc.", "NASDAQ"),
    ("AMZN", "Amazon.com Inc.", "NASDAQ"),
    ("META", "Meta Platforms Inc.", "NASDAQ"),
    ("TSLA", "Tesla Inc.", "NASDAQ"),
    ("NVDA", "NVIDIA Corporation", "NASDAQ"),
    ("JPM", "JPMorgan Chase & Co.", "NYSE"),
    ("V", "Visa Inc.", "NYSE"),
    ("JNJ", "Johnson & Johnson", "NYSE"),
    ("XOM", "Exxon Mobil Corporation", "NYSE"),
    ("SPY", "SPDR S&P 500 ETF", "NYSE"),
    ("QQQ", "Invesco QQQ Trust", "NASDAQ"),
    ("BTC-USD", "Bitcoin", "CRYPTO"),
    ("ETH-USD", "Ethereum", "CRYPTO"),
    ("EGL.LS", "Greenvolt — Energias Renováveis", "EURONEXT_LISBON"),
    ("BCP.LS", "Millennium BCP", "EURONEXT_LISBON"),
    ("GALP.LS", "Galp Energia", "EURONEXT_LISBON"),
    ("EDP.LS", "EDP — Energias de Portugal", "EURONEXT_LISBON"),
    ("JMT.LS", "Jerónimo Martins", "EURONEXT_LISBON"),
    ("NOS.LS", "NOS SGPS", "EURONEXT_LISBON"),
)

#: Icons of markets; others get the last.
MARKET_ICONS = {"NYSE": "🏛️", "NASDAQ": "💻", "LSE": "🇬🇧", "EURONEXT_LISBON": "🇵🇹", "CRYPTO": "₿", "FOREX": "💱"}
OTHER_ICON = "📊"


def seed_dims(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(market, stock) with ids made from names and tickers; a stock of no known market is left out."""
    markets = spark.createDataFrame(list(MARKETS), "name string, description string").select(
        F.sha2("name", 256).alias("market_id"), "name", "description"
    )
    stocks = (
        spark.createDataFrame(list(STOCKS), "ticker string, name string, market string")
        .join(F.broadcast(markets.select("market_id", F.col("name").alias("market"))), "market")
        .select(F.sha2("ticker", 256).alias("stock_id"), "ticker", "name", "market_id")
    )
    return markets, stocks
