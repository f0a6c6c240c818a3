"""Acquisition over snapshots: response classes, page caps, batch status and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Acquisition states.
STATES = ("ok", "partial", "empty", "blocked", "robots_denied", "needs_browser", "needs_credentials", "unsupported", "error")
MAX_PAGES = 3
_CHALLENGE = r"(?i)captcha|challenge-platform|checking your browser|access denied|자동입력 방지|보안 ?문자"


def http_state(status: Column, text: Column, content_range: Column | None = None) -> Column:
    """Class of a response: credentials, block, partial content or error by its status, a challenge by its text, else ok."""
    ranged = content_range.isNotNull() if content_range is not None else F.lit(False)
    return (
        F.when(status.isin(401, 407), "needs_credentials").when(status.isin(403, 429), "blocked")
        .when((status == 206) | ranged | ~F.coalesce(status.between(200, 299), F.lit(False)), "error")
        .when(text.rlike(_CHALLENGE), "needs_browser").otherwise("ok")
    )


def page_state(html: Column, content_type: Column, adapter: Column) -> Column:
    """What a page without postings is: a login, a challenge, no text at all, a page that needs a browser, or unsupported; the first that fits."""
    return (
        F.when(html.rlike(r"(?i)<input[^>]+type\s*=\s*[\"']?password"), "needs_credentials").when(html.rlike(_CHALLENGE), "blocked")
        .when(~F.coalesce(content_type.rlike(r"(?i)^(?:text/|application/(?:xhtml|json|xml))"), F.lit(True)), "unsupported")
        .when(html.rlike(r"(?i)<(?:script|iframe)\b") | (adapter != "generic"), "needs_browser").otherwise("unsupported")
    )


def batch_state(rows: Column, full: Column, truncated: Column, interrupted: Column, declared: Column) -> Column:
    """State of one collection from counts: postings, those with full text, whether it was cut or interrupted, and the declared total."""
    return (
        F.when((rows > 0) & (truncated | interrupted | (full < rows)), "partial").when(rows > 0, "ok")
        .when(interrupted, "error").when(declared == 0, "empty").otherwise("unsupported")
    )


def capped_pages(pages: DataFrame, source: str, page: str, rows: str, limit: int) -> DataFrame:
    """The leading pages of each source until the limit is reached, a page brings nothing, or MAX_PAGES; pages beyond the cap are dropped before the window."""
    near = pages.filter(F.col(page).between(1, MAX_PAGES))
    before = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    open_ = (F.coalesce(F.sum(rows).over(before), F.lit(0)) < limit) & (F.coalesce(F.min(rows).over(before), F.lit(1)) > 0)
    return near.withColumn("_open", open_).filter("_open").drop("_open")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def latest_by(events: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """The last event of each key with the first time seen and the number of events; combines before the shuffle."""
    last = F.max_by(F.struct(*fields), F.struct(*order))
    grouped = events.groupBy(key).agg(last.alias("_last"), F.min(order[0]).alias("first_at"), F.count(F.lit(1)).alias("events"))
    return grouped.select(key, "_last.*", "first_at", "events")
