"""The token bucket over a stream: a tenant's tokens and last instant are keyed state that expires once the bucket is full again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.routing import bucket_step
from tidewell.session import importable

DECISIONS = "tenant_id string, request long, allowed boolean, retry_after_ms long, retry_after_s long"


def retry_after(ms: int) -> int:
    """Whole seconds to wait, as a client is told them."""
    return -(-ms // 1000) if ms > 0 else 0


class Bucket(StatefulProcessor):
    def __init__(self, rate: float, burst: int) -> None:
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, at long", ttlDurationMs=int(self.burst * 1000 / self.rate) + 2000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        pdf = pd.concat(list(rows)).sort_values(["at_ms", "request"])  # one micro-batch of one tenant, bounded by the trigger
        have = self.state.get() if self.state.exists() else None
        tokens, at = have if have else (float(self.burst), int(pdf["at_ms"].iloc[0]))
        out = []
        for r in pdf.itertuples(index=False):
            tokens, at, ok, wait = bucket_step(tokens, at, int(r.at_ms), self.rate, self.burst, int(r.cost))
            out.append((key[0], int(r.request), ok, wait, retry_after(wait)))
        self.state.update((float(tokens), int(at)))
        yield pd.DataFrame(out, columns=["tenant_id", "request", "allowed", "retry_after_ms", "retry_after_s"])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """Decisions for a stream of (tenant_id, request, at_ms, cost). It needs the RocksDB state store."""
    importable(requests.sparkSession)
    rows = requests.select("tenant_id", F.col("request").cast("long").alias("request"), F.col("at_ms").cast("long").alias("at_ms"), F.col("cost").cast("long").alias("cost"))
    return rows.groupBy("tenant_id").transformWithStateInPandas(Bucket(rate, burst), DECISIONS, "Append", "ProcessingTime")
