"""Keyed tables where the last write wins: reports, type overrides, the index, calls a day.

Plain tables can't be merged into, so an upsert is a union of old and new rows, the newest of each key
kept; the result is written to a new place and swapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

REPORT_KEY = ("document_hash", "ruleset_id", "ruleset_version", "prompt_version")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str], newest: str, tie: str | None = None) -> DataFrame:
    """All rows of both, one a key: the newest; of equally new ones a row of ``new``, then the largest ``tie``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc(newest), F.desc("_new"), *([F.desc(tie)] if tie else [])]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def latest(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest), F.desc(tie)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def not_cached(hashes: DataFrame, reports: DataFrame, ruleset_id: str, version: int, prompt: str) -> DataFrame:
    """Documents (uri, document_hash) for which no report of this ruleset and prompt is stored."""
    have = reports.where((F.col("ruleset_id") == ruleset_id) & (F.col("ruleset_version") == version) & (F.col("prompt_version") == prompt)).select("document_hash").distinct()
    return hashes.join(have, "document_hash", "left_anti")


def with_overrides(documents: DataFrame, overrides: DataFrame) -> DataFrame:
    """Documents with the type a user has set, if any: confidence 1, origin user. ``overrides`` is joined as its size allows."""
    o = overrides.select("uri", F.col("doc_type").alias("_type"))
    joined = documents.join(o, "uri", "left")
    has = F.col("_type").isNotNull()
    return (
        joined.withColumn("doc_type", F.coalesce("_type", "doc_type"))
        .withColumn("doc_type_confidence", F.when(has, 1.0).otherwise(F.col("doc_type_confidence")))
        .withColumn("doc_type_origin", F.when(has, "user").otherwise(F.col("doc_type_origin")))
        .drop("_type")
    )


def with_link_status(links: DataFrame, checked: DataFrame) -> DataFrame:
    """Links with the status that was found for their href, else the one they had."""
    new = checked.select("uri", "href", F.col("status").alias("_status"))
    return links.join(new, ["uri", "href"], "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def links_to_check(links: DataFrame, limit: int = fixed.LINKS_CHECKED) -> DataFrame:
    """uri, href: each document's first distinct internal and attachment links."""
    first = links.where(F.col("target").isin("internal", "attachment")).groupBy("uri", "href").agg(F.min("link_pos").alias("p"))
    n = F.row_number().over(Window.partitionBy("uri").orderBy("p"))
    return first.withColumn("n", n).where(F.col("n") <= limit).select("uri", "href")


def status_of(http_status: Column) -> Column:
    """Link status from an HTTP status (null: no answer)."""
    return F.when(http_status.isNull(), "unchecked").when(http_status.isin(404, 410), "broken").otherwise("ok")


def calls_by_day(usage: DataFrame, limit: int = fixed.CALLS_A_DAY) -> DataFrame:
    """user_id, day (UTC), calls, denied (whether the next call is)."""
    out = usage.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("calls").alias("calls"))
    return out.withColumn("denied", F.col("calls") >= limit)


def model_gate(documents: DataFrame, usage: DataFrame, enabled: bool, limit: int = fixed.CALLS_A_DAY) -> DataFrame:
    """uri, gate: why a document (uri, user_id, chars) gets no model call (disabled, too-large, quota, in this order), or null."""
    used = usage.groupBy("user_id").agg(F.sum("calls").alias("calls"))
    rows = documents.join(used, "user_id", "left")
    gate = F.when(~F.lit(enabled), "disabled").when(F.col("chars") > fixed.MAX_MODEL_CHARS, "too-large").when(F.coalesce("calls", F.lit(0)) >= limit, "quota")
    return rows.select("uri", gate.alias("gate"))


def newest_reports(reports: DataFrame, uri: str, limit: int = 20) -> DataFrame:
    return reports.where(F.col("document_uri") == uri).orderBy(F.desc("created_at"), F.desc("report_id")).limit(max(1, min(100, limit)))
