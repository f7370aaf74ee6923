"""Set-based merges of the small tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_email, market_candidates, normalise_email
from .rank import dedupe_first, dedupe_last, top_k_per_group


def upsert_stocks(existing: DataFrame, batch: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The stock table after the merge: name and market of a known ticker are overwritten.

    ``batch`` has ticker, name and market_id. Of several rows of a ticker the last to arrive counts,
    by ``order``, or else by all other columns. A null ticker is left out. New stocks get the hash of
    their ticker as id (as text), or the batch's own stock_id if it has one.
    """
    new_id = F.col("__new_id") if "stock_id" in batch.columns else F.sha2("ticker", 256)
    ties = [c for c in batch.columns if c != "ticker" and c not in order]
    last = dedupe_last(batch.where(F.col("ticker").isNotNull()), ["ticker"], [*order, *ties])
    renamed = last.select(
        "ticker", F.lit(True).alias("__in"), F.col("name").alias("__name"), F.col("market_id").alias("__market_id"),
        *([F.col("stock_id").alias("__new_id")] if "stock_id" in batch.columns else []),
    )
    return existing.join(renamed, "ticker", "full_outer").select(
        F.coalesce("stock_id", new_id).alias("stock_id"), "ticker",
        F.when(F.col("__in"), F.col("__name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("__in"), F.col("__market_id")).otherwise(F.col("market_id")).alias("market_id"),
    )


def insert_new_markets(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Markets to append: names not stored yet; a stored one is not changed."""
    return dedupe_first(batch, ["name"], [c for c in batch.columns if c != "name"]).join(existing.select("name"), "name", "left_anti")


def apply_follow_log(state: DataFrame, log: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """The state after a change log (keys, op ADD or DELETE, seq): the last op of a key decides.

    Adding what is there and deleting what is not are no errors.
    """
    last = log.groupBy(*keys).agg(F.max_by("op", F.struct("seq", "op")).alias("op"))
    kept = state.select(*keys).distinct().join(last.where("op = 'DELETE'").select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where("op = 'ADD'").select(*keys)).distinct()


#: Child tables of each parent, by the parent's key.
CHILDREN = {
    "stock": ("stock_id", ("article_stock", "sentiment", "user_stock")),
    "article": ("article_id", ("article_stock",)),
    "app_user": ("user_id", ("user_stock", "user_market")),
    "market": ("market_id", ("user_market",)),
}


def cascade_delete(tables: dict[str, DataFrame], parent: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted parents' rows and what hangs on them.

    Deleting a market also deletes its stocks, and what hangs on those.
    """
    key, children = CHILDREN[parent]
    out = dict(tables)
    for name in (parent, *children):
        if name in out:
            out[name] = out[name].join(deleted.select(key), key, "left_anti")
    if parent == "market" and "stock" in out:
        gone = tables["stock"].join(deleted.select(key), key, "left_semi").select("stock_id")
        out = cascade_delete(out, "stock", gone)
    return out


def infer_market(df: DataFrame, markets: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Add ``market_id``: the first existing market among a ticker's candidates, else the first by name.

    Markets are few; Spark broadcasts them by their size. An empty market table gives null.
    """
    names = markets.groupBy("name").agg(F.min("market_id").alias("market_id"))
    fallback = names.agg(F.min_by("market_id", "name").alias("__any"))
    tickers = df.select(F.col(ticker).alias("__t")).where("__t is not null").distinct()
    found = (
        tickers.select("__t", F.posexplode(market_candidates(F.col("__t"))).alias("pos", "name"))
        .join(names, "name", "left")
        .groupBy("__t")
        .agg(F.min_by("market_id", F.when(F.col("market_id").isNotNull(), F.col("pos"))).alias("__found"))
    )
    return (
        df.join(found, F.col(ticker) == F.col("__t"), "left")
        .crossJoin(F.broadcast(fallback))
        .withColumn("market_id", F.coalesce("__found", "__any"))
        .drop("__t", "__found", "__any")
    )


def search_stocks(results: DataFrame, security_type: str = "Common Stock", limit: int = 10) -> DataFrame:
    """At most ``limit`` hits of each query: of the asked type, with a symbol, each symbol once.

    ``results`` has query, pos, symbol, description and type. An empty query finds nothing; a blank
    one is asked like any other.
    """
    hits = results.where((F.length("query") > 0) & (F.col("type") == security_type) & (F.length("symbol") > 0))
    first = dedupe_first(hits, ["query", "symbol"], ["pos"])
    return top_k_per_group(first, ["query"], [F.asc("pos"), F.asc("symbol")], limit)


def stocks_from_search(hits: DataFrame, markets: DataFrame) -> DataFrame:
    """(ticker, name, market_id) to upsert, one row a symbol; the last query's wording stays."""
    one = dedupe_last(hits.select(F.col("symbol").alias("ticker"), F.col("description").alias("name"), "query", "pos"), ["ticker"], ["query", "pos"])
    return infer_market(one, markets).select("ticker", "name", "market_id")


# ---- users and invitations ------------------------------------------------------------------


def invitation_status(accepted_at: Column) -> Column:
    return F.when(accepted_at.isNull(), "pending").otherwise("accepted")


def invitations_view(invitation: DataFrame, app_user: DataFrame, order: str = "pending") -> DataFrame:
    """Invitations with the inviter's and acceptor's e-mail; pending first, or newest first.

    An invitation whose inviter is unknown is absent. The rank is left to the caller's sort:
    the frame is ordered.
    """
    who = app_user.select(F.col("user_id").alias("invited_by_id"), F.col("email").alias("invited_by"))
    by = app_user.select(F.col("user_id").alias("accepted_by_user_id"), F.col("email").alias("accepted_by"))
    view = (
        invitation.join(who, "invited_by_id")
        .join(by, "accepted_by_user_id", "left")
        .select("invitation_id", "email", invitation_status(F.col("accepted_at")).alias("status"), "invited_by", "accepted_by", "accepted_at", "created_at")
    )
    newest = [F.desc("created_at"), F.asc("invitation_id")]
    return view.orderBy(*([F.asc_nulls_first("accepted_at")] if order == "pending" else []), *newest)


def classify_invites(requests: DataFrame, app_user: DataFrame, invitation: DataFrame) -> DataFrame:
    """(request_id, email, outcome) of invitation requests (request_id, email).

    In this order: invalid, user_exists, already_accepted, already_invited, ok. Of several good
    requests for one address in a batch the first is ok, the others are already_invited.
    """
    asked = requests.select("request_id", normalise_email(F.col("email")).alias("email"))
    users = app_user.select(F.col("email")).where("email is not null").distinct().withColumn("__user", F.lit(True))
    invited = invitation.groupBy("email").agg(F.max(F.col("accepted_at").isNotNull()).alias("__accepted"))
    first = asked.groupBy("email").agg(F.min("request_id").alias("__first"))
    return (
        asked.join(users, "email", "left")
        .join(invited, "email", "left")
        .join(first, "email", "left")
        .select(
            "request_id", "email",
            F.when(~is_email(F.col("email")), "invalid")
            .when(F.col("__user"), "user_exists")
            .when(F.col("__accepted"), "already_accepted")
            .when(F.col("__accepted").isNotNull() | (F.col("request_id") != F.col("__first")), "already_invited")
            .otherwise("ok")
            .alias("outcome"),
        )
    )


def admit_signups(signups: DataFrame, app_user: DataFrame, invitation: DataFrame) -> DataFrame:
    """(external_id, email, outcome, invitation_id) of sign-ups (external_id, email).

    known: the id has an account. blocked: no e-mail, or no invitation that is still pending.
    created: a new account, and the invitation to mark as accepted. If two sign-ups name one
    invitation, the smaller external_id is admitted and the other blocked.
    """
    known = app_user.select("external_id").distinct().withColumn("__known", F.lit(True))
    pending = invitation.where("accepted_at is null").select(F.col("email").alias("__email"), "invitation_id")
    asked = signups.select("external_id", normalise_email(F.col("email")).alias("email"))
    joined = asked.join(known, "external_id", "left").join(pending, F.col("email") == F.col("__email"), "left")
    claims = (
        joined.where("__known is null and invitation_id is not null")
        .groupBy(F.col("invitation_id").alias("__claimed"))
        .agg(F.min("external_id").alias("__winner"))
    )
    wins = F.col("__winner") == F.col("external_id")
    return joined.join(claims, F.col("invitation_id") == F.col("__claimed"), "left").select(
        "external_id", "email",
        F.when(F.col("__known"), "known").when(wins, "created").otherwise("blocked").alias("outcome"),
        F.when(F.col("__known").isNull() & wins, F.col("invitation_id")).alias("invitation_id"),
    )


def accept_invitations(invitation: DataFrame, admitted: DataFrame, as_of: datetime) -> DataFrame:
    """The invitation table after admission: accepted_at and the new user's id are filled in."""
    won = admitted.where("outcome = 'created'").select("invitation_id", F.sha2("external_id", 256).alias("__user"))
    now = F.lit(as_of).cast(invitation.schema["accepted_at"].dataType)
    return invitation.join(won, "invitation_id", "left").select(
        *[
            F.when(F.col("__user").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "accepted_at"
            else F.coalesce(F.col("__user"), F.col(c).cast("string")).alias(c) if c == "accepted_by_user_id"
            else F.col(c)
            for c in invitation.columns
        ]
    )


def backfill_emails(app_user: DataFrame, identity: DataFrame) -> DataFrame:
    """Users with missing e-mails filled from an identity feed (external_id, email)."""
    known = identity.groupBy("external_id").agg(F.min(normalise_email(F.col("email"))).alias("__email"))
    return app_user.join(known, "external_id", "left").withColumn("email", F.coalesce("email", "__email")).select(*app_user.columns)


def revocable(invitation: DataFrame, ids: DataFrame) -> DataFrame:
    """(invitation_id, outcome) of requests to revoke: not_found, accepted or revoked."""
    known = invitation.select("invitation_id", F.lit(True).alias("__there"), "accepted_at")
    return ids.select("invitation_id").distinct().join(known, "invitation_id", "left").select(
        "invitation_id",
        F.when(F.col("__there").isNull(), "not_found").when(F.col("accepted_at").isNotNull(), "accepted").otherwise("revoked").alias("outcome"),
    )


def remaining_invitations(invitation: DataFrame, outcomes: DataFrame) -> DataFrame:
    return invitation.join(outcomes.where("outcome = 'revoked'").select("invitation_id"), "invitation_id", "left_anti")
