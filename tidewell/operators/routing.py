"""Routing and limits: the hash ring, message chunks and sends, and the token bucket."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalar import hex64


def ring(spark: SparkSession, nodes: list[str], vnodes: int = 160) -> DataFrame:
    """(pos, node): so many places of each node, as hex texts. Its size is nodes * vnodes. Of equal places the first node's stays."""
    if not nodes:
        raise LookupError("the ring has no nodes")
    df = spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "__i int, node string").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    return df.groupBy(hex64(F.concat_ws("#", "node", F.col("v").cast("string"))).alias("pos")).agg(F.min_by("node", "__i").alias("node"))


def route(keys: DataFrame, key: str, ring_rows: DataFrame) -> DataFrame:
    """Keys with the node of the first place after their hash, from the last place on to the first.

    The ring is cut by the first byte of a place into 256 rows, each with its places in order and the node that follows
    them, so a lookup is a broadcast equality join (256 rows, nodes * vnodes places) and a look at a few places.
    """
    ordered = ring_rows.agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("ring"))
    byte = F.lower(F.lpad(F.hex(F.col("id")), 2, "0"))
    cut = ordered.crossJoin(ring_rows.sparkSession.range(256).select(byte.alias("__byte")))  # one row beside 256
    here = F.filter("ring", lambda x: F.substring(x["pos"], 1, 2) == F.col("__byte"))
    then = F.coalesce(F.try_element_at(F.filter("ring", lambda x: F.substring(x["pos"], 1, 2) > F.col("__byte")), F.lit(1)), F.col("ring")[0])["node"]
    cut = cut.select("__byte", here.alias("__here"), then.alias("__then"))
    hashed = keys.withColumn("__h", hex64(F.col(key))).withColumn("__byte", F.substring("__h", 1, 2))
    found = F.try_element_at(F.filter("__here", lambda x: x["pos"] > F.col("__h")), F.lit(1))["node"]
    return hashed.join(F.broadcast(cut), "__byte", "left").withColumn("node", F.coalesce(found, "__then")).drop("__h", "__byte", "__here", "__then")


def greedy(df: DataFrame, keys: list[str], order: str, size: str, most: int, entries: int | None = None) -> DataFrame:
    """Rows with the `bin` that each falls into, filling bins in order: a new one begins when a row would exceed most, or after so many entries.

    A key's rows are those of one request, which has a bounded number of events.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("s"))))
    step = lambda acc, x: F.when((acc["count"] > 0) & ((acc["size"] + x["s"] > most) | (F.lit(False) if entries is None else acc["count"] == entries)), F.struct((acc["bin"] + 1).alias("bin"), x["s"].alias("size"), F.lit(1).alias("count"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), (acc["bin"] + 1).alias("bin")))).alias("out"))).otherwise(F.struct(acc["bin"].alias("bin"), (acc["size"] + x["s"]).alias("size"), (acc["count"] + 1).alias("count"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), acc["bin"].alias("bin")))).alias("out")))
    kind = df.schema[order].dataType.simpleString()
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("count"), F.array().cast(f"array<struct<o:{kind},bin:int>>").alias("out"))
    bins = df.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x"))
    return df.join(bins.select(*keys, F.col("x.o").alias(order), F.col("x.bin").alias("bin")), [*keys, order])


def bucket_step(tokens: float, last: int, now: int, rate: float, burst: int, cost: int) -> tuple[float, int, bool, int]:
    """Tokens after a request at now (ms), its time, whether it passes, and else the wait in ms (-1: never)."""
    tokens = min(float(burst), tokens + max(0, now - last) * rate / 1000)
    if cost <= tokens:
        return tokens - cost, now, True, 0
    return tokens, now, False, -1 if cost > burst else math.ceil((cost - tokens) * 1000 / rate)


def token_bucket(requests: DataFrame, order: list[str | Column]) -> DataFrame:
    """Decisions for requests (tenant_id, request, at_ms, cost, rate, burst): allowed and retry_after_ms.

    A tenant's requests are folded in order. They are sorted by the shuffle and streamed, so memory holds one bucket.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, tokens, last = None, 0.0, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.tenant_id != who:
                    who, tokens, last = r.tenant_id, float(r.burst), r.at_ms
                tokens, last, ok, wait = bucket_step(tokens, last, r.at_ms, r.rate, r.burst, r.cost)
                out.append((r.tenant_id, r.request, ok, wait))
            yield pd.DataFrame(out, columns=["tenant_id", "request", "allowed", "retry_after_ms"])

    rows = requests.select("tenant_id", "request", "at_ms", "cost", "rate", "burst")
    return rows.repartition("tenant_id").sortWithinPartitions("tenant_id", *order).mapInPandas(fold, f"tenant_id string, request {rows.schema['request'].dataType.simpleString()}, allowed boolean, retry_after_ms long")
