"""The analytical query: events, unique users, top events and top pages of a tenant over a range of UTC days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.bounds import hll_error
from tidewell.functions.scalar import json_string
from tidewell.operators.sketches import estimates
from tidewell.operators.validate import check_range
from tidewell.sources.events import scan


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("events"), F.countDistinct("distinct_id").alias("unique_users"))


def top_events(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(limit)


def top_pages(df: DataFrame, limit: int = 10) -> DataFrame:
    pages = df.where("name = 'page_view'").select(json_string(F.col("properties"), "path").alias("key")).where("key is not null")
    return pages.groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(limit)


def _row(start: str, end: str, one: DataFrame, events: DataFrame, pages: DataFrame) -> DataFrame:
    listed = lambda df, name: df.agg(F.expr("transform(array_sort(collect_list(struct(-count as c, key))), x -> struct(x.key as key, -x.c as count))").alias(name))
    out = one.crossJoin(listed(events, "top_events")).crossJoin(listed(pages, "top_pages"))  # of one row each
    return out.select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"), F.lit(False).alias("approximate"), "events", "unique_users", "top_events", "top_pages")


def stats(ev: DataFrame, tenant: str, start: str, end: str, *, limit: int = 10, most_days: int = 31) -> DataFrame:
    """The exact answer, one row, from a scan of the range."""
    check_range(start, end, limit, most_days=most_days)
    df = scan(ev, tenant, start, end)
    return _row(start, end, totals(df), top_events(df, limit), top_pages(df, limit))


def in_days(rollup: DataFrame, tenant: str, start: str, end: str) -> DataFrame:
    """Rows of a tenant and of days; where they have instants, also as a half-open range of them, which raw files can use."""
    out = rollup.where((F.col("tenant_id") == tenant) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return scan(out, tenant, start, end) if "occurred_at" in rollup.columns else out


def approximate(states: DataFrame, tenant: str, start: str, end: str, *, limit: int = 10) -> DataFrame:
    """The approximate answer from stored states: users from merged registers, the rest from merged Count-Min cells. Events are exact.

    A range has at most 366 days of three bounded states, so it is read as one partition and merged there without a shuffle.
    States of other parameters than the engine's are an error.
    """
    check_range(start, end, limit)
    each = estimates(in_days(states, tenant, start, end).coalesce(1), ["kind"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    listed = lambda kind: F.transform(F.slice(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("ranked")))), 1, limit), lambda x: F.struct(x["item"].alias("key"), x["n"].alias("count")))
    out = each.agg(F.coalesce(of("events", "total"), F.lit(0)).alias("events"), F.coalesce(F.bround(of("users", "users")), F.lit(0.0)).cast("bigint").alias("unique_users"), listed("events").alias("top_events"), listed("pages").alias("top_pages"))
    return out.select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"), F.lit(True).alias("approximate"), "events", "unique_users", "top_events", "top_pages")


def band(estimate: DataFrame, p: int = 14) -> DataFrame:
    """The 95 % band of an estimate."""
    e = 2 * hll_error(p)
    return estimate.withColumn("low", F.col("estimate") * (1 - e)).withColumn("high", F.col("estimate") * (1 + e))
