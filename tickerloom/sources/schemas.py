"""Schemas of tables and feed records, as DDL text."""

from __future__ import annotations

TABLES = {
    "market": "market_id string, name string, description string",
    "stock": "stock_id string, ticker string, name string, market_id string",
    "article": "article_id string, headline string, summary string, url string, source string, published_at timestamp, created_at timestamp",
    "article_stock": "article_id string, stock_id string",
    "sentiment": "sentiment_id string, stock_id string, score double, summary string, date timestamp, created_at timestamp",
    "user_stock": "user_id string, stock_id string",
    "user_market": "user_id string, market_id string",
    "app_user": "user_id string, external_id string, email string, role string, created_at timestamp",
    "invitation": "invitation_id string, email string, invited_by_id string, accepted_at timestamp, accepted_by_user_id string, created_at timestamp",
}

NEWS = "category string, datetime long, headline string, id long, image string, related string, source string, summary string, url string"
TAGGED = "data array<struct<uuid:string,title:string,description:string,url:string,published_at:string,source:string,entities:array<struct<symbol:string>>>>"
SYMBOLS = "count long, result array<struct<description:string,displaySymbol:string,symbol:string,type:string>>"

#: The column that keeps the text of a record that is no JSON.
CORRUPT = "_corrupt_record"

ROLES = ("USER", "ADMIN")
