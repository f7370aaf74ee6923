"""Adapter views: the domain tables over generic star-schema tables, whole tables all of them.

Users without a watchlist, stocks without readings and accounts without an identity come from keys
that match nothing, not from filters.

The same SQL text runs in Spark and in DuckDB, so results can be compared.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF_ARTICLES = datetime(2001, 8, 1)
AS_OF_READINGS = datetime(2024, 1, 31)

_SUFFIXES = "case {0} % 8 when 0 then '.LS' when 1 then '.L' when 2 then '.PA' when 3 then '.DE' when 4 then '.AS' when 5 then '-USD' when 6 then '.B' else '' end"
_TICKER = "'T' || cast({0} as string) || " + _SUFFIXES
_INVITED = "'guest' || cast({} as string) || '@example.com'"

VIEWS = {
    "market": "select n_nationkey as market_id, n_name as name from nation",
    "stock": "select s_suppkey as stock_id, s_name as ticker, s_nationkey as market_id from supplier",
    "article": """select o_orderkey as article_id,
        o_orderpriority || ' ' || c_mktsegment || ' order ' || cast(o_orderkey as string) as headline,
        'https://news.example.com/a/' || cast(o_orderkey as string) as url,
        o_orderstatus as source, o_orderdate as published_at
        from orders join customer on o_custkey = c_custkey""",
    "article_stock": "select distinct l_orderkey as article_id, l_suppkey as stock_id from lineitem",
    # every seventh stock has no reading
    "sentiment": """select event_id as sentiment_id, user_id + cast(floor(user_id / 6) as bigint) as stock_id, (value - 50) / (value + 50) as score,
        event_type as summary, ts as date from events""",
    # suppliers are users who follow nothing
    "app_user": "select c_custkey as user_id from customer union all select -1 - s_suppkey as user_id from supplier",
    "user_stock": """select distinct o_custkey as user_id, l_suppkey as stock_id
        from orders join lineitem on l_orderkey = o_orderkey""",
    "user_market": """select distinct o_custkey as user_id, s_nationkey as market_id
        from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey""",
    # tickers of every kind
    "listing": f"select s_suppkey as stock_id, {_TICKER.format('s_suppkey')} as ticker, s_name as name from supplier",
    "exchange": """select 100 + n_nationkey as market_id, case n_nationkey when 0 then 'NYSE' when 1 then 'NASDAQ' when 2 then 'LSE'
        when 3 then 'CRYPTO' when 4 then 'FOREX' when 5 then 'EURONEXT_LISBON' else n_name end as name from nation""",
    # accounts and invitations
    "account": """select c_custkey as user_id, 'ext-' || cast(c_custkey as string) as external_id,
        case when c_custkey % 10 <> 0 then 'user' || cast(c_custkey as string) || '@example.com' end as email from customer""",
    "invitation": f"""select o_orderkey as invitation_id, {_INVITED.format('o_orderkey')} as email, o_custkey as invited_by_id,
        case when o_orderstatus = 'F' then o_orderdate end as accepted_at,
        case when o_orderstatus = 'F' then (o_custkey * 7) % 1000 end as accepted_by_user_id,
        o_orderdate as created_at from orders""",
    "invite_request": f"""select event_id as request_id, case event_id % 5
        when 0 then 'not an address ' || cast(event_id as string)
        when 1 then ' User' || cast(user_id as string) || '@Example.COM '
        when 2 then {_INVITED.format('event_id')}
        when 3 then 'new' || cast(user_id as string) || '@example.org'
        else 'Guest' || cast(event_id - event_id % 3 as string) || '@example.com' end as email from events""",
    "signup": f"""select case when o_orderkey % 4 = 0 then 'ext-' || cast(o_custkey as string) else 'new-' || cast(o_orderkey as string) end as external_id,
        case when o_orderkey % 11 = 5 then null else {_INVITED.format('o_orderkey - o_orderkey % 2')} end as email
        from orders""",
    "identity": "select 'ext-' || cast(c_custkey * 4 as string) as external_id, ' Found' || cast(c_custkey as string) || '@Example.com' as email from customer",
    # feeds
    "page_news": "select doc_id as pos, md5(text) as url, text as headline, source, text is not null as there from documents",
    "tagged_event": "select event_id as article_id, cast(replace(replace(props, '{\"k\": ', ''), '}', '') as bigint) as k, user_id, event_type from events",
    # what the three feeds of a full run bring, in order of ``seq``, and what was stored before
    "general_feed": """select o_orderkey as seq, 'https://news.example.com/a/' || cast(cast(floor(o_orderkey / 2) as bigint) as string) as url,
        case when o_orderstatus = 'P' then '' else o_orderpriority || ' order ' || cast(o_orderkey as string) end as headline,
        o_orderstatus as source, o_orderdate as published_at from orders""",
    "company_feed": f"""select l_orderkey * 10 + l_linenumber as seq, {_TICKER.format('l_suppkey')} as ticker,
        'https://news.example.com/a/' || cast(l_orderkey as string) as url,
        case l_returnflag when 'R' then 'loss and warning' when 'A' then 'record profit but a loss' else 'growth' end || ' ' || cast(l_partkey as string) as headline,
        case when l_linenumber <> 7 then l_linestatus end as source, l_shipdate as published_at from lineitem""",
    "tagged_feed": f"""select event_id as seq, 'https://news.example.com/t/' || cast(cast(floor(event_id / 3) as bigint) as string) as url,
        case when event_type = 'error' then '' else event_type || ' surge' end as title, ts as published_at,
        {_TICKER.format('user_id')} as first_symbol, {_TICKER.format('(event_id % 50)')} as second_symbol from events""",
    "stored_article": """select 'c' || cast(c_custkey as string) as article_id, 'https://news.example.com/a/' || cast(c_custkey * 3 as string) as url,
        c_name as headline, cast('2001-07-30 00:00:00' as timestamp) as published_at from customer""",
    "stored_link": "select 'c' || cast(c_custkey as string) as article_id, c_nationkey as stock_id from customer",
    "raw_answer": """select event_id as stock_id, case event_id % 5
        when 0 then '{"score": 0.4, "summary": "' || event_type || '"}'
        when 1 then '```json {"score": 0.4} ```'
        when 2 then '{"score": "0.4", "summary": "quoted"}'
        when 3 then 'no answer' else '' end as raw from events""",
}
NEEDS = {name: [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents") if f" {t}" in sql] for name, sql in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name]}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in frames:
        text = _named(text, t)
    return spark.sql(text, **frames)


def _named(text: str, name: str) -> str:
    for before in ("from ", "join "):
        for after in (" ", "\n"):
            text = text.replace(f"{before}{name}{after}", f"{before}{{{name}}}{after}")
        if text.endswith(before + name):
            text = text[: -len(name)] + "{" + name + "}"
    return text


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it uses in front."""
    parts = ", ".join(f"{n} AS ({VIEWS[n].replace(' as string)', ' as varchar)')})" for n in names)
    return f"WITH {parts} {sql}"
