"""Fetched pages and the metadata taken from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions import html as H
from linkweave.functions.urls import title_from_url
from linkweave.functions.webtags import page_tags
from linkweave.schemas import PAGES


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAGES).format(fmt).load(path)


def _column(pages: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in pages.columns else default


def extract_metadata(
    pages: DataFrame, extracted_at: dt.datetime | None = None, with_tags: bool = False
) -> DataFrame:
    """(url, outcome, title, description, image_url, code, message, extracted_at, fetched_at) per page; no shuffle.

    outcome is 'ok', 'fallback' (title from the URL only) or 'error' (bad status; nothing else is set).
    Pages without status, content type or size columns count as fetched HTML of their own size.
    """
    html, url = F.col("html"), F.col("url")
    status = _column(pages, "status", F.lit(200))
    text = F.coalesce(_column(pages, "status_text", F.lit("")), F.lit(""))
    fetched = _column(pages, "fetched_at", F.lit(None)).cast("timestamp")
    outcome = H.fetch_outcome(
        html,
        status,
        _column(pages, "content_type", F.lit("text/html")),
        F.coalesce(_column(pages, "n_bytes", F.octet_length(html)), F.octet_length(html)),
    )
    ok, failed = F.col("outcome") == "ok", F.col("outcome") == "error"
    when = F.lit(extracted_at).cast("timestamp") if extracted_at else F.current_timestamp()
    columns = [
        F.when(ok, H.page_title(html, url)).when(~failed, title_from_url(url)).alias("title"),
        F.when(ok, H.page_description(html)).when(~failed, F.lit("")).alias("description"),
        F.when(ok, H.page_image(html)).alias("image_url"),
        F.when(failed, F.lit(C.CODE_EXTERNAL)).alias("code"),
        F.when(failed, F.concat(F.lit("HTTP "), F.col("_status").cast("string"), F.lit(": "), F.col("_text"))).alias("message"),
        when.alias("extracted_at"),
        F.col("_fetched").alias("fetched_at"),
    ]
    if with_tags:
        none = F.array().cast("array<string>")
        columns.append(F.when(ok, page_tags(html)).otherwise(none).alias("page_tags"))
    return pages.select("url", "html", status.alias("_status"), text.alias("_text"), fetched.alias("_fetched"), outcome.alias("outcome")).select(
        "url", "outcome", *columns
    )


def latest_metadata(extracted: DataFrame) -> DataFrame:
    """One row per URL: the latest fetch; of equally late ones, or without times, the greatest row."""
    rest = [c for c in extracted.columns if c not in ("url", "fetched_at")]
    best = F.max(F.struct("fetched_at", *rest)).alias("best")
    return extracted.groupBy("url").agg(best).select("url", *[F.col(f"best.{c}") for c in (*rest, "fetched_at")])


def metadata_for_urls(
    urls: DataFrame, pages: DataFrame, extracted_at: dt.datetime | None = None, with_tags: bool = False
) -> DataFrame:
    """Metadata of each URL; a URL without a page counts as one that could not be fetched.

    `pages` are fetched pages, or what extract_metadata made of them.  HTML never enters a shuffle: pages are extracted
    where they are read, and the narrow rows are joined.  Whoever asks many times keeps the extracted table.
    """
    urls = urls.select("url").distinct()
    extracted = pages if "outcome" in pages.columns else extract_metadata(pages, extracted_at, with_tags)
    found = urls.join(latest_metadata(extracted.join(urls, "url", "left_semi")), "url", "left")
    missing = F.col("outcome").isNull()
    return (
        found.withColumn("title", F.when(missing, title_from_url(F.col("url"))).otherwise(F.col("title")))
        .withColumn("description", F.when(missing, F.lit("")).otherwise(F.col("description")))
        .withColumn("outcome", F.coalesce("outcome", F.lit("fallback")))
    )
