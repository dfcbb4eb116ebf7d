"""Counts of 64-bit keys over all tasks, brought back to where the keys were found.

A task cuts what it reads into flushes of a bounded size. Of each flush the distinct keys and their counts go to buckets,
so a key that a third of all rows hold costs one entry for each flush. A bucket adds the counts up and sends each flush
its totals; there they meet what the flush had set aside for itself, which travels with one of its blocks.

Buckets are as many as the keys ask for, so a task holds a flush or a bucket of a size that does not grow with the input
until there are 65,536 buckets; beyond, buckets grow to 8 million keys. Flushes grow with the number of buckets, so that
a block of one for the other holds 64 keys, up to 4 million keys. (From some 10 TB on, blocks hold fewer keys.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewell.llm.common import U8
from tidewell.llm.packed import expand, framed, squeeze, unframed

Flush = tuple[np.ndarray, bytes]


class Plan(NamedTuple):
    """Numbers of buckets and of flushes, about, and keys of a flush."""

    buckets: int
    flushes: int
    held: int


def plan(keys: int, least: int, held: int = 1 << 19) -> Plan:
    """For so many keys of all flushes, distinct in each, and so many tasks at least."""
    buckets = max(least, -(-keys // min(1 << 23, max(1 << 18, keys >> 16))))
    held = min(1 << 22, max(held, 64 * buckets))
    return Plan(buckets, max(least, -(-keys // held)), held)


def census(df: DataFrame, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[Flush]], finish: Callable[[bytes, np.ndarray, np.ndarray], pd.DataFrame], schema: str, sizes: Plan) -> DataFrame:
    """Rows of finish(kept, totals, keys) of every flush.

    cut gives flushes of keys, which are hashes and may repeat, and what to keep for them. totals has the count of each of
    these keys over all flushes, in their order; keys has the keys whose total is above 1, and 0 for the others.
    """

    buckets = sizes.buckets

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for keys, kept in cut(batches):
            if not len(keys):
                continue
            serial += 1
            uniq, back, n = np.unique(keys, return_inverse=True, return_counts=True)
            bucket = (uniq % U8(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            uniq, n = uniq[order], n[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]
            kept = framed(squeeze(place[back]), kept)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in full], pa.int64()), pa.array([serial] * len(full), pa.int64()), pa.array([framed(squeeze(uniq[a:b], kind="<u8"), squeeze(n[a:b])) for _, a, b in full], pa.binary()), pa.array([kept if k == (serial + (serial >> 32)) % len(full) else b"" for k in range(len(full))], pa.binary())], ["bucket", "flush", "counts", "kept"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unframed(x) for x in pdf["counts"]]
        keys = [expand(x, 1, "<u8")[0] for x, _ in got]
        length = np.array([len(k) for k in keys])
        keys = np.concatenate(keys)
        _, back = np.unique(keys, return_inverse=True)
        total = np.minimum(np.bincount(back, np.concatenate([expand(x, 1)[0] for _, x in got]))[back], 0xFFFFFFFF).astype(np.int64)
        out, at = [], 0
        for m in length.tolist():
            t, k = total[at : at + m], keys[at : at + m]
            out.append(framed(squeeze(t), squeeze(k[t > 1], kind="<u8")))
            at += m
        return pd.DataFrame({"bucket": pdf["bucket"], "flush": pdf["flush"], "totals": out, "kept": pdf["kept"]})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        got = [unframed(x) for x in pdf["totals"]]
        total = np.concatenate([expand(x, 1)[0] for x, _ in got]).astype(np.int64)
        keys = np.zeros(len(total), U8)
        keys[total > 1] = np.concatenate([expand(x, 1, "<u8")[0] for _, x in got])
        place, kept = unframed(b"".join(pdf["kept"]))
        place = expand(place, 1)[0]
        return finish(kept, total[place], keys[place])

    rows = df.mapInArrow(sent, "bucket long, flush long, counts binary, kept binary")
    rows = rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(added, "bucket long, flush long, totals binary, kept binary")
    return rows.repartition(sizes.flushes, "flush").groupBy("flush").applyInPandas(gathered, schema)
