"""Campaign fan-out, message payloads, outcome rollup, closing.

The source loops over active subscribers and calls the mail service once per
recipient.  Here the fan-out is a DataFrame of payloads (one row per
recipient, written by an external sender), and the sender's responses come
back as a DataFrame that is classified and rolled up.  The campaign side is
one row selected by primary key, so attaching it to each recipient is an
equi-join on the campaign id with a one-row broadcast side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lit_ts, null_safe_concat
from .kpis import send_rollup


def recipients(campaigns: DataFrame, subs: DataFrame, campaign_id: int, force: bool = False) -> DataFrame:
    """Active subscribers of one campaign (draft only unless ``force``, S36)."""
    camp = campaigns.filter(F.col("id") == campaign_id)
    if not force:
        camp = camp.filter(F.col("status") == "draft")
    camp = camp.select(F.col("id").alias("campaign_id"), "subject", "body_html")
    active = subs.filter(F.col("status") == "active").select(
        F.lit(campaign_id).cast("bigint").alias("campaign_id"), "email", "confirm_token")
    return active.join(F.broadcast(camp), "campaign_id", "inner")


#: Parts of the default footer: before the sender name, before the link, after it.
FOOTER = ("<footer>", ': <a href="', '">unsubscribe</a></footer>')


def render_messages(rcpts: DataFrame, from_name: str, unsub_base: str, footer: tuple[str, str, str] = FOOTER) -> DataFrame:
    """Body plus footer with the sender name and a personal unsubscribe link.

    NULL parts count as empty text, like the source's ``||``.
    """
    link = null_safe_concat(F.lit(unsub_base), F.col("confirm_token"))
    start, middle, end = (F.lit(part) for part in footer)
    return rcpts.withColumn("html", null_safe_concat(F.col("body_html"), start, F.lit(from_name), middle, link, end))


def message_payload(messages: DataFrame) -> DataFrame:
    """Mail-service JSON request per recipient."""
    body = F.struct(
        F.struct(
            F.col("subject").alias("subject"),
            F.struct(F.lit("HTML").alias("contentType"), F.col("html").alias("content")).alias("body"),
            F.array(F.struct(F.struct(F.col("email").alias("address")).alias("emailAddress"))).alias("toRecipients"),
        ).alias("message"),
        F.lit(False).alias("saveToSentItems"),
    )
    return messages.select("campaign_id", "email", F.to_json(body).alias("payload"))


def classify_outcomes(responses: DataFrame) -> DataFrame:
    """I4: 202 -> sent; other code -> 'HTTP <code> <body 400>'; no code -> error text (400)."""
    code = F.col("http_code")
    status = F.when(code == 202, F.lit("sent")).otherwise(F.lit("failed"))
    msg = (F.when(code == 202, F.lit(None).cast("string"))
           .when(code.isNotNull(), F.substring(null_safe_concat(F.lit("HTTP "), code, F.lit(" "),
                                                                F.substring(F.col("body"), 1, 400)), 1, 2000))
           .otherwise(F.substring(F.col("error"), 1, 400)))
    return responses.select("campaign_id", "email", status.alias("status"), msg.alias("error_msg"))


def close_campaigns(campaigns: DataFrame, log: DataFrame, as_of, token_failed: list[int] | None = None) -> DataFrame:
    """Campaigns with a send log become 'sent' with counters and sent_at;
    campaigns whose access-token step failed go back to 'draft'."""
    roll = send_rollup(log).select(F.col("campaign_id").alias("id"), F.col("recipients").alias("_n"),
                                   F.col("sent").alias("_s"), F.col("failed").alias("_f"))
    out = campaigns.join(roll, "id", "left")
    done = F.col("_n").isNotNull()
    failed_ids = token_failed or []
    token_bad = F.col("id").isin(*failed_ids) if failed_ids else F.lit(False)
    return out.select(
        "id", "subject", "body_html",
        F.when(token_bad, F.lit("draft")).when(done, F.lit("sent")).otherwise(F.col("status")).alias("status"),
        F.when(done & ~token_bad, F.col("_n")).otherwise(F.col("recipients")).alias("recipients"),
        F.when(done & ~token_bad, F.col("_s")).otherwise(F.col("sent_count")).alias("sent_count"),
        F.when(done & ~token_bad, F.col("_f")).otherwise(F.col("fail_count")).alias("fail_count"),
        "created_at",
        F.when(done & ~token_bad, lit_ts(as_of)).otherwise(F.col("sent_at")).alias("sent_at"),
        "created_by",
    )


def campaign_list(campaigns: DataFrame) -> DataFrame:
    """All campaigns newest first with formatted times."""
    return campaigns.orderBy(F.col("id").desc()).select(
        "id", "subject", "status", "recipients", F.col("sent_count").alias("sent"),
        F.col("fail_count").alias("fail"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
        F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("sent_at"))
