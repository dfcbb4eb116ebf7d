"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table hashes a vector with `hashes` random rotations (three rounds of random signs and a fast Hadamard transform); each
gives the signed axis nearest to the rotated vector. These axes name the vector's bucket. By multiprobing a vector also
looks into the buckets with the second nearest axis in any place, so two vectors meet when either looks into the other's
bucket. All such pairs are verified by their cosine in double precision. A pair that meets more than once counts where it
meets first. Pairs are never written out: a bucket gives each vector a count of its links and the smallest vector that the
bucket's links reach from it, so that these edges have the components of all links.
Keys are shuffled first, and vectors only for buckets where some meet.

Equal vectors form a class, named by a 64-bit hash of the vector, that takes part once and carries its count and its
smallest key; different vectors under one key are classes of their own. Buckets above `block` classes are split into
parts, and every pair of parts is a task of its own, so that a hot bucket is spread and nothing is dropped. Groups of
buckets are as many as the rows to compare ask for, so a task's frame stays of one size whatever the input.

Handled cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors are scaled by their largest component first, so that no finite norm overflows or vanishes; vectors
of different lengths don't link; rows without a key have no links and no component; equal rows stay in the result, and so
do different vectors under one key, each with the links of its own vector; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U8, mix, parts, prepare, saved
from tidewell.llm.components import components

#: Rows that a task compares, about.
ROWS = 20_000


def usable(v: str) -> Column:
    """Whether a vector has components, all finite and not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows over their largest components, so that sums of their squares are finite and not zero."""
    return v / np.abs(v).max(axis=1, keepdims=True)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def probes(v: np.ndarray, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Keys of the rows' buckets: an array of rows by tables by 2 ** hashes, of which the first are the nearest."""
    n, dim = v.shape
    d = 1 << max(1, dim - 1).bit_length()
    x = np.zeros((n, d))
    x[:, :dim] = scaled(v) if n else v
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, tables, 1 << hashes), np.int64)
    for t in range(tables):
        keys = np.full((n, 1), mix(np.array([(t << 32) + dim], U8))[0], U8)
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            near = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            far = np.take_along_axis(np.abs(y), near, 1)
            near = np.where((far[:, :1] >= far[:, 1:]), near, near[:, ::-1])  # the two nearest axes, the nearest first
            axis = (2 * near + (np.take_along_axis(y, near, 1) < 0)).astype(U8)
            keys = mix((keys[:, :, None] * U8(0x9E3779B97F4A7C15) + axis[:, None, :] + U8(1)).reshape(n, -1))
        out[:, t] = keys.view(np.int64)
    return out


def keys_of(col: pa.Array, tables: int, hashes: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column, some at a time, and their probes; vectors of different lengths have different keys."""
    size = np.asarray(col.value_lengths())
    for dim in np.unique(size).tolist():
        part = np.flatnonzero(size == dim)
        for i in range(0, len(part), 2000):
            yield part[i : i + 2000], probes(matrix(col.take(pa.array(part[i : i + 2000]))), tables, hashes, seed)


def reach(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row that links reach from it, itself if none; a row is read once."""
    first = np.arange(len(link))
    left = link.any(axis=1)
    for k in np.flatnonzero(left).tolist():
        if left[k]:
            left[k] = False
            edge = np.array([k])
            while len(edge):
                edge = np.flatnonzero(link[edge].any(axis=0) & left)
                left[edge] = False
                first[edge] = k
    return first


def near(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, tables: int = 10, hashes: int = 3, block: int = 2000, seed: int = 11) -> DataFrame:
    """Per row: key, n_links (other rows whose vectors link directly), component_id, kept (key = component_id)."""
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v") if "float" in df.schema[vector].dataType.simpleString() else F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("cls", F.when(usable("v") & F.col("id").isNotNull(), F.xxhash64("v")))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by("v", "id").alias("v"))

    def hashed_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * len(batch)
            for part, keys in keys_of(batch.column(3), tables, hashes, seed):
                for i, k in zip(part.tolist(), keys.astype("<i8")):
                    out[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "keys"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(len(batch), -1)
            own = np.zeros(keys.shape, bool)
            own[:, :: 1 << hashes] = True
            table = np.repeat(np.arange(tables, dtype=np.int32), 1 << hashes)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(table, len(batch))), batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), keys.shape[1]))), pa.array(own.ravel())], ["key", "t", "cls", "own"])

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["cls"], pdf["high"], pdf["low"], pdf["t"], pdf["key"]))
        pdf = pdf.iloc[order]
        key, of, low, high, cls, n = (pdf[c].to_numpy() for c in ("key", "t", "low", "high", "cls", "n"))
        part, own, vs, ks = (pdf[c].to_numpy() for c in ("i", "own", "v", "keys"))
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
        links, to = np.zeros(len(key), np.int64), cls.copy()
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a < 2 or len({len(x) for x in vs[a:b]}) > 1:  # of one length, but for a collision of keys
                continue
            v = scaled(np.stack(vs[a:b]).astype(np.float64))
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            link = v @ v.T >= cosine
            np.fill_diagonal(link, False)
            link &= own[a:b, None] | own[None, a:b]
            if low[a] != high[a]:  # two parts of a large bucket: the pairs within a part are another task's
                link &= part[a:b, None] != part[None, a:b]
            p, q = np.nonzero(np.triu(link))
            if not len(p):
                continue
            table = int(of[a])
            keys = np.stack([np.frombuffer(x, "<i8").reshape(table + 1, -1) for x in ks[a:b]])
            for i in range(0, len(p), 50_000):  # a pair counts in the first bucket where it meets
                x, y = p[i : i + 50_000], q[i : i + 50_000]
                first = np.ones(len(x), bool)
                for t in range(table + 1):
                    into_x = (keys[y, t] == keys[x, t, :1]).any(axis=1)
                    into_y = (keys[x, t] == keys[y, t, :1]).any(axis=1)
                    if t < table:
                        first &= ~(into_x | into_y)
                    else:
                        most = np.iinfo(np.int64).max
                        first &= np.minimum(np.where(into_x, keys[x, t, 0], most), np.where(into_y, keys[y, t, 0], most)) == key[a]
                np.add.at(links, a + x[first], n[a + y[first]])
                np.add.at(links, a + y[first], n[a + x[first]])
            to[a:b] = cls[a + reach(link)]
        got = (links > 0) | (to != cls)
        return pd.DataFrame({"cls": cls[got], "links": links[got], "to": to[got]})

    classes = saved(classes.mapInArrow(hashed_classes, f"{', '.join(f'{c} {t}' for c, t in classes.dtypes)}, keys binary"))
    pairs = classes.select("cls", "keys").mapInArrow(buckets, "key long, t int, cls long, own boolean")
    met = pairs.groupBy("key", "t").agg(F.count("*").alias("m"), F.count_if("own").alias("own")).where("m > 1 and own > 0").select("key", "t", "m", F.ceil(F.col("m") / block).alias("k"))
    met = saved(met)
    slots = max(4 * parts(spark), -(-(met.agg(F.sum(F.col("m") * F.col("k"))).first()[0] or 0) // ROWS))
    pairs = pairs.join(met.drop("m"), ["key", "t"]).withColumn("i", F.pmod(F.xxhash64("cls"), "k").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, cast(k as int) - 1)")))
    # a bucket needs a vector's keys of its own table and of those before
    values = classes.select("cls", "n", "v", "keys")
    pairs = pairs.select("key", "t", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "own", "cls").join(values, "cls").withColumn("keys", F.expr(f"substring(keys, 1, (t + 1) * {8 << hashes})"))
    found = saved(pairs.groupBy(F.pmod(F.xxhash64("key", "t", "low", "high"), F.lit(slots)).alias("slot")).applyInPandas(verify, "cls long, links long, to long"))
    comp = components(found.where("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "cls")
    least = comp.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    comp = comp.join(least, "component").select("cls", "least")
    per = found.groupBy("cls").agg(F.sum("links").alias("links"))
    of = classes.select("cls", "n", "rep").join(per, "cls", "left").join(comp, "cls", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "rep").alias("component"))
    out = rows.select("id", "cls").join(of, "cls", "left").select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
