"""Schemas of the event model, and the model's tables read from storage or derived from the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import configured

WIRE_EVENT = "event_id string, name string, distinct_id string, properties string, occurred_at string"
ENVELOPE = f"batch_id string, tenant_id string, received_at string, events array<struct<{', '.join(x.replace(' ', ': ') for x in WIRE_EVENT.split(', '))}>>"
TENANTS = "id string, name string, plan string, rate_limit_per_sec int, rate_limit_burst int, created_at timestamp"
USERS = "id string, tenant_id string, email string, role string, created_at timestamp"
API_KEYS = "id string, tenant_id string, name string, key_prefix string, key_hash string, created_at timestamp, revoked_at timestamp"
STORED = ["tenant_id", "event_id", "distinct_id", "name", "properties", "occurred_at", "day", "batch_id", "received_day"]
#: Row predicates that the tables must satisfy.
CHECKS = {
    "tenants": ["plan in ('free', 'pro', 'enterprise')", "rate_limit_per_sec > 0", "rate_limit_burst > 0"],
    "users": ["role in ('owner', 'admin', 'member')"],
    "usage_daily": ["event_count >= 0"],
    "usage_ledger": ["event_count >= 0"],
    "sketches": ["kind in ('users', 'events', 'pages')"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configured(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the test data in the model's columns: four tenants, paths (some not strings), batches and late receipts."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("distinct_id"),
        F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("name"),
        F.when(k % 10 == 0, F.concat(F.lit('{"path":'), k.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"path":"/p/'), k.cast("string"), F.lit('"}'))).alias("properties"),
        F.col("ts").alias("occurred_at"),
        F.to_date("ts").alias("day"),
        F.expr("event_id div 100").alias("batch_id"),
        F.when(F.col("event_id") % 10 == 0, F.date_add(F.to_date("ts"), 1)).otherwise(F.to_date("ts")).alias("received_day"),
        F.col("event_id").alias("n"),
        "value",
    )


def deliveries(ev: DataFrame) -> DataFrame:
    """The events, and again every seventh of them in a later batch, as clients retry."""
    return ev.unionByName(ev.where("n % 7 = 0").withColumn("batch_id", F.col("batch_id") + 1000))


def tenants(spark: SparkSession) -> DataFrame:
    rows = [(f"t{i}", f"Tenant {i}", ("free", "pro", "enterprise", "gold")[i], (10, 20, 30, 0)[i], 40 + 10 * i) for i in range(4)]
    return spark.createDataFrame(rows, "id string, name string, plan string, rate_limit_per_sec int, rate_limit_burst int")


def api_keys(spark: SparkSession) -> DataFrame:
    """A key for each of five tenants, of which the fourth's is revoked and the fifth tenant isn't there."""
    rows = [(f"k{i}", f"t{i}", 1 if i == 3 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, revoked int")
    secret = F.concat(F.lit("tk_live_"), "tenant_id")
    return df.select("id", "tenant_id", F.substring(secret, 1, 12).alias("key_prefix"), F.sha2(secret, 256).alias("key_hash"), F.col("revoked").alias("revoked_at"))


def write_events(df: DataFrame, path: str) -> None:
    """Appends events to a table partitioned by tenant and day, so that scans of either are pruned."""
    df.write.mode("append").partitionBy("tenant_id", "day").parquet(path)


def scan(df: DataFrame, tenant: str, start: str, end: str) -> DataFrame:
    """Events of a tenant whose days lie in [start, end]: by day, which prunes partitions, and as a half-open range of instants, which reaches the file scan."""
    low, high, kind = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1), df.schema["occurred_at"].dataType.simpleString()
    kept = (F.col("tenant_id") == tenant) & (F.col("occurred_at") >= low.cast(kind)) & (F.col("occurred_at") < high.cast(kind))
    return df.where(kept & F.col("day").between(low, F.lit(end).cast("date")) if "day" in df.columns else kept)


def read_envelopes(spark: SparkSession, path: str, *, stream: bool = False, per_trigger: int = 10, shards: list[str] | None = None) -> DataFrame:
    """Messages as lines of text; as a stream, so many files at a time; of all shards, or of some of them."""
    reader = configured(spark).readStream.option("maxFilesPerTrigger", per_trigger) if stream else configured(spark).read
    return reader.schema("value string").format("text").load(f"{path}/shard={{{','.join(shards)}}}" if shards else path).select("value")
