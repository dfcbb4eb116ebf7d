"""The queued path as a stream: envelopes in files, ownership, ledger, usage and sketch states, published epoch by epoch.

Tables are partitioned by day and by attempt. Every micro-batch writes its rows under an attempt of its own and then
publishes its epoch: it creates the next numbered file of the manifest, which fails if another writer was first; the epoch
is then applied anew on top of that writer's rows. Readers see published attempts only, so a run that is killed at any
point and repeated, or two writers on one root, bill every event once and lose no update. Nothing is rewritten: usage
merges by sum and sketch states merge on reading. What a micro-batch reads back is limited to the days that it holds:
a batch is received again with its first instant, and an event has its instant in its identity.

A message that can't be read is delivered again with the next epochs, and after the fifth delivery goes to the dead
letters, so it blocks no other. A failed commit leaves the whole micro-batch to be repeated.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.scalar import normalized
from tidewell.operators import sketches
from tidewell.operators.ingest import accepted, ingest, last_in_message, new_batches, owned
from tidewell.operators.metrics import record
from tidewell.operators.validate import parsed
from tidewell.session import configured
from tidewell.sources.events import read_envelopes

#: Tables and the column that their partitions have besides the attempt.
TABLES = {
    "events": ("tenant_id string, event_id string, distinct_id string, name string, properties string, occurred_at timestamp, batch_id string, day date", "day"),
    "ledger": ("batch_id string, tenant_id string, event_count bigint, received_day date", "received_day"),
    "usage": ("tenant_id string, n bigint, received_day date", "received_day"),
    "sketches": (sketches.STATES, "day"),
    "retry": ("value string, deliveries int", None),
    "dead": ("value string, deliveries int", None),
}
DELIVERIES = 5
_published: dict[str, tuple[str, str]] = {}  # manifest files that were read; they never change


class Conflict(RuntimeError):
    """Another writer published first, again and again."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> tuple[list[tuple[str, str]], int]:
    """(epoch, attempt) in order of publication, and the last number in use."""
    fs, p = _fs(spark, f"{root}/manifest")
    out, last = [], 0
    for x in sorted(fs.listStatus(p), key=lambda x: x.getPath().getName()) if fs.exists(p) else []:
        path = x.getPath().toString()
        if path not in _published:
            file = fs.open(x.getPath())
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            file.close()
            if text:  # else a writer died between making and filling it, and published nothing
                _published[path] = tuple(json.loads(text))
        if path in _published:
            out.append(_published[path])
        last = int(x.getPath().getName())
    return out, last


def published(spark: SparkSession, root: str) -> list[str]:
    return [epoch for epoch, _ in manifest(spark, root)[0]]


def publish(spark: SparkSession, root: str, number: int, epoch: str, attempt: str) -> bool:
    """Makes an attempt visible under a number, unless another writer has taken the number."""
    fs, p = _fs(spark, f"{root}/manifest/{number:012d}")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(json.dumps([epoch, attempt]).encode()))
    out.close()
    return True


def read(spark: SparkSession, root: str, name: str, attempts: list[str] | None = None, days: list | None = None) -> DataFrame:
    """A table's rows of published attempts, or of those given; with days only of these partitions, which alone are listed."""
    schema, by = TABLES[name]
    if attempts is None:
        attempts = [a for _, a in manifest(spark, root)[0]]
    paths = [f"{root}/{name}"] if days is None or by is None else [f"{root}/{name}/{by}={d or '__HIVE_DEFAULT_PARTITION__'}" for d in days]
    paths = [x for x in paths if (lambda fs, p: fs.exists(p))(*_fs(spark, x))]
    if not paths or not attempts:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(f"{schema}, attempt string").option("basePath", f"{root}/{name}").parquet(*paths)
    return df.where(F.col("attempt").isin(attempts)).drop("attempt")


def _put(df: DataFrame, root: str, name: str, attempt: str) -> None:
    schema, by = TABLES[name]
    columns = df.sparkSession.createDataFrame([], schema).schema.fields
    df = df.select(*[F.col(c.name).cast(c.dataType) for c in columns], F.lit(attempt).alias("attempt"))
    df.write.mode("append").partitionBy(*([by] if by else []), "attempt").parquet(f"{root}/{name}")


def _once(spark: SparkSession, root: str, epoch: str, apply: Callable[[str, list[str]], dict], fail: Callable[[str], None], tries: int = 5) -> dict:
    """Writes an attempt and publishes it as the epoch, anew if another writer was faster; counts of what was applied, none if it was before."""
    for _ in range(tries):
        done, last = manifest(spark, root)
        if epoch in (e for e, _ in done):
            return {}
        attempt = f"{epoch}-{uuid.uuid4().hex[:12]}"
        got = apply(attempt, [a for _, a in done])
        fail("written")
        if publish(spark, root, last + 1, epoch, attempt):
            fail("published")
            return got
    raise Conflict(f"{epoch}: {tries} other writers were faster")


def commit(spark: SparkSession, root: str, epoch: str, messages: DataFrame, fail: Callable[[str], None] = lambda at: None, *, lines: DataFrame | None = None) -> dict:
    """Applies messages (batch_id, tenant_id, received_at, events) as one epoch; fail may raise to imitate a crash.

    lines (value, deliveries) are those of the epoch that could not be read. Returns counts of the commit, none for an epoch that was applied before.
    """
    configured(spark)
    batches = messages.dropDuplicates(["batch_id"]).withColumn("received_day", F.to_date(normalized(F.col("received_at")))).persist()
    rows = batches.select("batch_id", "tenant_id", F.posexplode("events").alias("pos", "e")).select("batch_id", "tenant_id", "pos", "e.*")
    rows = last_in_message(rows, ["batch_id", "tenant_id"], "event_id", "pos")
    rows = rows.withColumn("occurred_at", normalized(F.col("occurred_at"))).withColumn("day", F.to_date("occurred_at")).drop("pos").persist()
    # the days of one micro-batch
    of = F.transform("events", lambda e: F.to_date(normalized(e["occurred_at"])).cast("string"))
    days, received = batches.agg(F.array_distinct(F.flatten(F.collect_set(of))), F.collect_set(F.col("received_day").cast("string"))).first()
    received.append(None)
    held: list[DataFrame] = [batches, rows]

    def apply(attempt: str, done: list[str]) -> dict:
        began = time.perf_counter()
        stored, ledger = read(spark, root, "events", done, days), read(spark, root, "ledger", done, received)
        mine = owned(rows, stored).persist()
        fresh = new_batches(batches.select("batch_id", "tenant_id", "received_day"), ledger).persist()
        held.extend([mine, fresh])
        _put(mine.join(stored.select("tenant_id", "event_id", "occurred_at"), ["tenant_id", "event_id", "occurred_at"], "left_anti"), root, "events", attempt)
        fail("stored")
        billed = fresh.join(mine.groupBy("batch_id").agg(F.count("*").alias("n")), "batch_id", "left").withColumn("event_count", F.coalesce("n", F.lit(0)).cast("bigint")).persist()
        held.append(billed)
        _put(billed, root, "ledger", attempt)
        _put(billed.groupBy("tenant_id", "received_day").agg(F.sum("event_count").alias("n")).where("n > 0"), root, "usage", attempt)
        _put(sketches.states(sketches.sketch_items(mine.join(fresh.select("batch_id"), "batch_id", "left_semi"))), root, "sketches", attempt)
        bad = lines.agg(F.count("*"), F.count_if(F.col("deliveries") > 1), F.count_if(F.col("deliveries") >= DELIVERIES)).first() if lines is not None else (0, 0, 0)
        if bad[0] > bad[2]:
            _put(lines.where(F.col("deliveries") < DELIVERIES), root, "retry", attempt)
        if bad[2]:
            _put(lines.where(F.col("deliveries") >= DELIVERIES), root, "dead", attempt)
        total, n, events = batches.select("batch_id").join(billed.select("batch_id", "event_count"), "batch_id", "left").agg(F.count("*"), F.count("event_count"), F.coalesce(F.sum("event_count"), F.lit(0))).first()
        return {"MessagesCommitted": (total, "Count"), "MessagesRetried": (bad[1], "Count"), "MessagesFailed": (bad[0], "Count"), "MessagesAlreadyApplied": (total - n, "Count"), "EventsBilled": (events, "Count"), "CommitLatency": (round(1000 * (time.perf_counter() - began)), "Milliseconds")}

    try:
        return _once(spark, root, epoch, apply, fail)
    finally:
        for x in held:
            x.unpersist()


def _emit(spark: SparkSession, root: str, name: str, epoch: str, values: dict) -> None:
    """One metric record of a commit, as a line in a file of its own."""
    if values:
        fs, p = _fs(spark, f"{root}/metrics/{epoch}.json")
        out = fs.create(p, True)
        out.write(bytearray((record("tidewell", {"Queue": name}, values, int(time.time() * 1000)) + "\n").encode()))
        out.close()


def _pending(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lines that the last epoch of this name left to be delivered again."""
    mine = [(e, a) for e, a in manifest(spark, root)[0] if e.rsplit("-", 1)[0] == name]
    return read(spark, root, "retry", [a for _, a in mine[-1:]])


def _epoch(spark: SparkSession, root: str, name: str, epoch: str, lines: DataFrame, fail: Callable[[str], None]) -> None:
    """Lines (value, deliveries) as one epoch."""
    df = parsed(lines).persist()
    try:
        got = commit(spark, root, epoch, df.where("message is not null").select("message.*"), fail, lines=df.where("message is null").select("value", "deliveries"))
        _emit(spark, root, name, epoch, got)
    except Exception:
        _emit(spark, root, name, f"{epoch}-failed-{uuid.uuid4().hex[:8]}", {"CommitFailures": (1, "Count")})
        raise
    finally:
        df.unpersist()


def start(spark: SparkSession, landing: str, root: str, checkpoint: str, *, name: str = "main", shards: list[str] | None = None, per_trigger: int = 10, fail: Callable[[str], None] = lambda at: None) -> StreamingQuery:
    """A stream over the files in landing, a message a line, of all shards or of some; name tells the consumers of one root apart."""
    lines = read_envelopes(configured(spark), landing, stream=True, per_trigger=per_trigger, shards=shards)

    def apply(df: DataFrame, number: int) -> None:
        session = configured(df.sparkSession)
        left = _pending(session, root, name).withColumn("deliveries", F.col("deliveries") + 1)
        _epoch(session, root, name, f"{name}-{number:012d}", df.select("value", F.lit(1).alias("deliveries")).unionByName(left), fail)

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redeliver(spark: SparkSession, root: str, name: str = "main", fail: Callable[[str], None] = lambda at: None) -> int:
    """Delivers the lines left over until they are read or dead; returns how often."""
    for n in range(DELIVERIES):
        left = _pending(spark, root, name)
        if not left.take(1):
            return n
        last = [e for e in published(spark, root) if e.rsplit("-", 1)[0] == name][-1]
        number, _, again = last.rsplit("-", 1)[1].partition(".")
        _epoch(spark, root, name, f"{name}-{number}.{int(again or 0) + 1}", left.withColumn("deliveries", F.col("deliveries") + 1), fail)
    return DELIVERIES


def consume(spark: SparkSession, landing: str, root: str, checkpoint: str, *, attempts: int = 5, pause: float = 1.0, stop: Callable[[], bool] = lambda: False, **options) -> bool:  # noqa: ANN003
    """Runs the stream until it has read all, again after a pause when it fails; False if it was stopped or never got through."""
    for _ in range(attempts):
        if stop():
            return False
        query = start(spark, landing, root, checkpoint, **options)
        try:
            query.awaitTermination()
            return True
        except Exception:  # noqa: BLE001  a failed commit; the micro-batch is delivered again
            time.sleep(pause)
    return False


def usage(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "usage").groupBy("tenant_id", "received_day").agg(F.sum("n").alias("event_count"))


def states(spark: SparkSession, root: str) -> DataFrame:
    """Sketch states: the last merged base, and the published deltas after it."""
    done, _ = manifest(spark, root)
    bases = [(i, a) for i, (e, a) in enumerate(done) if e.startswith("merged-")]
    return read(spark, root, "sketches", [a for _, a in done[bases[-1][0] :]] if bases else [a for _, a in done])


def compact(spark: SparkSession, root: str) -> None:
    """Merges all states published so far to one for each tenant, day and kind, so that reading costs days and not commits."""
    def apply(attempt: str, done: list[str]) -> dict:
        _put(sketches.merged(states(spark, root)), root, "sketches", attempt)
        return {}

    _once(spark, root, f"merged-{uuid.uuid4().hex}", apply, lambda at: None)


def enqueue(messages: DataFrame, landing: str) -> None:
    """Writes envelopes as JSON lines, in a folder for each shard."""
    messages.select("shard", F.to_json(F.struct("batch_id", "tenant_id", "received_at", "events")).alias("value")).write.mode("append").partitionBy("shard").text(landing)


def insert(spark: SparkSession, root: str, rows: DataFrame, received_day: str, *order: str) -> DataFrame:
    """The direct sink: stores rows whose (tenant, event id) is new, bills them on the day of receipt, and returns per tenant what was sent, inserted and double.

    Rows and usage are published together. An event id is known for ever, so its tenant's stored keys of all days are read.
    """
    configured(spark)
    sent = rows.persist()
    out: list = []

    def apply(attempt: str, done: list[str]) -> dict:
        stored = read(spark, root, "events", done).join(F.broadcast(sent.select("tenant_id").distinct()), "tenant_id", "left_semi")  # tenants of one request
        new = ingest(stored, sent, *(order or ("occurred_at",))).withColumn("day", F.to_date("occurred_at")).persist()
        _put(new, root, "events", attempt)
        _put(new.groupBy("tenant_id").agg(F.count("*").alias("n")).withColumn("received_day", F.lit(received_day).cast("date")), root, "usage", attempt)
        out[:] = accepted(sent, new).collect()  # a row for each tenant of one request
        new.unpersist()
        return {}

    _once(spark, root, f"direct-{uuid.uuid4().hex}", apply, lambda at: None)
    sent.unpersist()
    return spark.createDataFrame(out, "tenant_id string, sent bigint, inserted bigint, duplicates bigint")


class Sinks:
    """The two sinks behind one method, chosen by name: direct tables, or envelopes for the stream."""

    def __init__(self, kind: str, path: str) -> None:
        if kind not in ("direct", "queue"):
            raise ValueError(f"no sink of the kind {kind}")
        self.kind, self.path = kind, path

    def write(self, df: DataFrame) -> DataFrame | None:
        """Rows to the tables, received today, or envelopes to the queue."""
        if self.kind == "queue":
            return enqueue(df, self.path)
        return insert(df.sparkSession, self.path, df, str(df.sparkSession.sql("select current_date()").first()[0]))
