"""Idempotence: which deliveries of an event count, which batch owns it, and what is billed.

Two notions of identity are kept apart. The direct sink knows an event by (tenant, event id) for ever; the queued path knows
it by (tenant, event id, instant), and the first batch to write it owns it, also when that batch is delivered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant_id", "event_id"]


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key, chosen before the shuffle is sorted: a group limit runs on either side of it."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def ingest(stored: DataFrame, sent: DataFrame, *order: Column | str) -> DataFrame:
    """Rows of sent that the direct sink inserts: new by (tenant, event id), and the first of their kind in the order given."""
    return first_of(sent, KEY, *order).join(stored.select(*KEY), KEY, "left_anti")


def accepted(sent: DataFrame, inserted: DataFrame, by: str = "tenant_id") -> DataFrame:
    """How many rows each key sent, how many were inserted, and how many were duplicates."""
    n = inserted.groupBy(by).agg(F.count("*").alias("inserted"))
    out = sent.groupBy(by).agg(F.count("*").alias("sent")).join(n, by, "left")
    return out.select(by, "sent", F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("sent") - F.coalesce("inserted", F.lit(0))).alias("duplicates"))


def last_in_message(df: DataFrame, message: list[str], event: str, position: str) -> DataFrame:
    """Of a message's rows with one event id the last, at the first one's position."""
    both = df.groupBy(*message, event).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*message, event, position)]), position).alias("__last"), F.min(position).alias(position))
    return both.select(*message, event, position, "__last.*")


def owned(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows whose batch owns them: the first to write (tenant, event id, instant), or the batch that already owns it."""
    key = ["tenant_id", "event_id", "occurred_at"]
    owner = df.groupBy(*key).agg(F.min("batch_id").alias("__owner"))
    if stored is not None:
        have = stored.select(*key, F.col("batch_id").alias("__had"))
        owner = owner.join(have, key, "left").select(*key, F.coalesce("__had", "__owner").alias("__owner"))
    return df.join(owner, key).where(F.col("batch_id") == F.col("__owner")).drop("__owner")


def new_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches that the ledger doesn't have, once each."""
    return batches.dropDuplicates(["batch_id"]).join(ledger.select("batch_id"), "batch_id", "left_anti")


def usage(existing: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Daily usage with the rows of delta (tenant, received day, n) added; days without events get no row."""
    rows = delta.select("tenant_id", "received_day", "n")
    if existing is not None:
        rows = rows.unionByName(existing.select("tenant_id", "received_day", F.col("event_count").alias("n")))
    return rows.groupBy("tenant_id", "received_day").agg(F.sum("n").alias("event_count")).where("event_count > 0")


def pruned(ledger: DataFrame, at: Column, now: Column, days: int = 15) -> DataFrame:
    return ledger.where(F.to_date(at) >= F.date_sub(now, days))
