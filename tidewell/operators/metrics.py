"""Operational metrics: windows, ratios, alarms, batch counters and log counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(df: DataFrame, at: str, value: str, size: str, keys: list[str]) -> DataFrame:
    """Sum, extremes, mean, median and 99th percentile of tumbling windows."""
    out = df.groupBy(*keys, F.window(at, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.99).alias("p99"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "total", "least", "most", "mean", "p50", "p99")


def rate(df: DataFrame, bad: Column, keys: list[str]) -> DataFrame:
    """Errors for each hundred requests."""
    out = df.groupBy(*keys).agg(F.count_if(bad).alias("errors"), F.count("*").alias("requests"))
    return out.withColumn("error_rate", 100.0 * F.col("errors") / F.greatest("requests", F.lit(1)))


def alarms(counts: DataFrame, keys: list[str], period: str, value: str, first: Column, last: Column, step: str, threshold: float, periods: int, missing_breaches: bool = False) -> DataFrame:
    """Per key and period whether the value has reached the threshold so many periods in a row. Periods without rows are filled in."""
    calendar = counts.select(*keys).distinct().withColumn(period, F.explode(F.sequence(first, last, F.expr(f"interval {step}"))))
    full = calendar.join(counts, [*keys, period], "left").withColumn("breach", F.coalesce(F.col(value) >= threshold, F.lit(missing_breaches)))
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(1 - periods, 0)
    return full.withColumn("alarm", F.bool_and("breach").over(w) & (F.count("*").over(w) == periods))


def log_counters(lines: DataFrame, value: str = "value") -> DataFrame:
    """Sums of the counters that workers write to their logs."""
    found = lambda p: F.coalesce(F.sum(F.aggregate(F.regexp_extract_all(value, F.lit(p), F.lit(1)), F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))), F.lit(0))
    seen = lambda t: F.coalesce(F.sum(F.regexp_count(value, F.lit(t))), F.lit(0)).cast("bigint")
    return lines.agg(found(r"\((\d+) retried deliveries").alias("retried_deliveries"), found(r"(\d+) already applied\)").alias("already_applied"), seen("commit failed").alias("commit_failures"), seen(r"\(will retry\)").alias("write_failures"))


def observed(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """df, which reports aggregates under a name to listeners while it runs, without another pass."""
    return df.observe(name, *[c.alias(k) for k, c in columns.items()])


def record(namespace: str, dimensions: dict[str, str], values: dict[str, tuple[float, str]], at_ms: int) -> str:
    """A metric record: one JSON line with its values, their units, and totals by dimension and over the whole fleet."""
    import json

    about = {"Timestamp": at_ms, "CloudWatchMetrics": [{"Namespace": namespace, "Dimensions": [list(dimensions), []], "Metrics": [{"Name": k, "Unit": u} for k, (_, u) in values.items()]}]}
    return json.dumps({"_aws": about, **dimensions, **{k: v for k, (v, _) in values.items()}})


def steps(breach: Column, large: float = 120) -> Column:
    """How many workers to add when the oldest message's age is so many seconds above the threshold: two if far above, one less if below."""
    return F.when(breach >= large, 2).when(breach >= 0, 1).when(breach < 0, -1).otherwise(0)


def load_summary(requests: DataFrame, seconds: float, *, most_errors: float = 0.01, p99_ms: float = 500.0) -> DataFrame:
    """Rates, latencies and the verdict of a load test from its requests (kind, ms, ok, events)."""
    ingest, read = F.col("kind") == "ingest", F.col("kind") == "stats"
    out = requests.agg((F.sum(F.when(ingest & F.col("ok"), F.col("events"))) / seconds).alias("events_per_s"), (F.count_if(ingest) / seconds).alias("requests_per_s"), (F.count_if(~F.col("ok")) / F.count("*")).alias("errors"), F.percentile(F.when(ingest, F.col("ms")), 0.5).alias("p50"), F.percentile(F.when(ingest, F.col("ms")), 0.99).alias("p99"), F.percentile(F.when(read, F.col("ms")), 0.95).alias("stats_p95"))
    return out.withColumn("passed", (F.col("errors") < most_errors) & (F.col("p99") < p99_ms) & (F.coalesce("stats_p95", F.lit(0.0)) < p99_ms))
