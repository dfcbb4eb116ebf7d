"""Schema versions and dimension rows: ordered, checksummed migrations, new tenants with their keys, and a cache of key lookups."""

from __future__ import annotations

import base64
import hashlib
import secrets
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewell.session import configured
from tidewell.sources.events import API_KEYS, TENANTS

MANIFEST = "version string, checksum string, place int"
PREFIX = "tk_live_"


def applied(spark: SparkSession, root: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/schema_versions")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return configured(spark).read.schema(MANIFEST).parquet(f"{root}/schema_versions") if there else spark.createDataFrame([], MANIFEST)


def migrate(spark: SparkSession, root: str, steps: list[tuple[str, str, Callable[[], None]]]) -> list[str]:
    """Runs the steps (version, definition, action) that the manifest doesn't have, in order of version, and returns their versions.

    A step whose definition has changed since it ran is an error, before anything runs. There is one writer for each root.
    """
    done = {r.version: r.checksum for r in applied(spark, root).collect()}  # a row for each schema version
    steps = sorted(steps, key=lambda s: s[0])
    sums = {v: hashlib.sha256(d.encode()).hexdigest() for v, d, _ in steps}
    if changed := [v for v in sums if v in done and done[v] != sums[v]]:
        raise RuntimeError(f"applied versions were edited: {', '.join(changed)}")
    ran = []
    for i, (version, _, action) in enumerate(steps):
        if version not in done:
            action()
            spark.createDataFrame([(version, sums[version], i)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/schema_versions")
            ran.append(version)
    return ran


def new_key() -> tuple[str, str, str]:
    """A key, the prefix to show, and the hash to store."""
    key = PREFIX + base64.urlsafe_b64encode(secrets.token_bytes(24)).decode()
    return key, key[: len(PREFIX) + 4], hashlib.sha256(key.encode()).hexdigest()


def create_tenant(spark: SparkSession, root: str, tenant: str, name: str, plan: str, rate: int, burst: int) -> str:
    """Appends a tenant and a key of its own, and returns the key. The tenant row is written last: a key without it admits nobody."""
    if plan not in ("free", "pro", "enterprise") or rate <= 0 or burst <= 0:
        raise ValueError("plan, rate or burst breaks a constraint")
    key, prefix, hashed = new_key()
    now = spark.sql("select current_timestamp()").first()[0]
    put = lambda row, schema, where: spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{root}/{where}")
    put((hashed[:32], tenant, "default", prefix, hashed, now, None), API_KEYS, "api_keys")
    put((tenant, name, plan, rate, burst, now), TENANTS, "tenants")
    return key


def find_key(root_keys: DataFrame, tenants: DataFrame, key: str) -> Row | None:
    """The tenant of a key that is known and not revoked."""
    if not key.startswith(PREFIX):
        return None
    one = root_keys.where((F.col("key_hash") == hashlib.sha256(key.encode()).hexdigest()) & F.col("revoked_at").isNull())
    return one.select(F.col("tenant_id").alias("id")).join(tenants, "id").select("id", "rate_limit_per_sec", "rate_limit_burst").first()


class KeyCache:
    """Answers of a lookup, found or not, for some seconds: so long may a revoked key still pass. It holds a bounded number of them."""

    def __init__(self, look_up: Callable[[str], Row | None], seconds: float = 30.0, most: int = 10_000, clock: Callable[[], float] = time.monotonic) -> None:
        self.look_up, self.seconds, self.most, self.clock = look_up, seconds, most, clock
        self.held: dict[str, tuple[float, Row | None]] = {}

    def get(self, key: str) -> Row | None:
        name, now = hashlib.sha256(key.encode()).hexdigest(), self.clock()
        if name in self.held and self.held[name][0] > now:
            return self.held[name][1]
        answer = self.look_up(key)
        if len(self.held) >= self.most:
            self.held = {k: v for k, v in self.held.items() if v[0] > now}
        if len(self.held) >= self.most:
            self.held = {}
        self.held[name] = (now + self.seconds, answer)
        return answer
