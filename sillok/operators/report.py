"""Report rows and their page; what is shown is escaped in the rows, the page is put together from them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillok.functions.text import fence, html_escape


def report_rows(postings: DataFrame, labels: DataFrame, on: str, label: str, fallback: str = "-") -> DataFrame:
    """Postings left-joined with their labels; a posting without label shows the fallback."""
    named = labels.select(on, F.col(label).alias("_label"))
    return postings.join(named, on, "left").withColumn("label", html_escape(F.coalesce("_label", F.lit(fallback)))).drop("_label")


def packet(rows: DataFrame, *fields: str) -> DataFrame:
    """Each text field between fences that its own content cannot close."""
    return rows.withColumns({f: fence(F.coalesce(F.col(f), F.lit("")), "text") for f in fields})


def write_report(rows: DataFrame, path: str, limit: int = 10_000) -> int:
    """Write a page of all rows to a new file, all or nothing; an existing file is never replaced. A report is for reading, so more than ``limit`` rows are refused, not cut."""
    shown = rows.select(*[html_escape(F.col(c).cast("string")).alias(c) for c in rows.columns]).limit(limit + 1).collect()
    if len(shown) > limit:
        raise ValueError(f"a report of more than {limit} rows; choose the rows first")
    head = "".join(f"<th>{c}</th>" for c in rows.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{v or ''}</td>" for v in r) + "</tr>" for r in shown)
    csp = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\">"
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as out:
        out.write(f"<!doctype html><meta charset=utf-8>{csp}<table><tr>{head}</tr>\n{body}\n</table>")
    try:
        os.link(out.name, path)  # fails where the file exists
    finally:
        os.unlink(out.name)
    return len(shown)
