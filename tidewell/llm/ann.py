"""Approximate nearest neighbours by inner product: a forest of random-projection trees and one priority queue.

The trees are fitted on a bounded sample, the `sample` classes of equal vectors least by a hash, split to leaves of about
`leaf` of the sample at every size of the table, so the model is of a fixed size and is broadcast. Each inner node splits
its sample at the median along the line through two of its vectors. Vectors are first lengthened by sqrt(M^2 - |v|^2), M
being the largest norm of all rows (queries by 0), which turns the largest inner product into the smallest distance. All
rows go to their leaves. A query walks all trees at once: a queue shared by them gives the branch nearest to the query,
and the walk ends after a set share of all leaves. A leaf's rows are scored against the queries that came to it by the
exact inner product in double precision, and each query keeps its best.

Leaves above `block` rows are split among tasks, and groups of leaves are as many as their rows ask for. Equal vectors
form a class, named by a 64-bit hash of the vector, that is searched once; of each class the k + 1 smallest keys suffice,
and these are limited before they are shuffled. Vectors of each length have a forest of their own.

Handled cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as rows or as
queries, nor do rows without a key; a query finds vectors of its own length, which alone have an inner product with it;
ties go to the smaller key; repeated rows are rows of their own, and so are different vectors under one key: each row
that asks has a result of its own, from which one row of its key and vector is left out; with fewer than k candidates all
are given; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import least_by_hash, parts, prepare, saved
from tidewell.llm.near_embed import matrix, usable


#: Rows and queries that a task scores, about.
ROWS = 60_000


class Forest:
    """Complete trees: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int, depth: int, seed: int) -> None:
        self.norm, self.depth = norm, depth
        self.trees = trees if depth else 1  # trees of one leaf are all alike
        self.inner = (1 << depth) - 1
        x = self.longer(sample)
        self.normal = np.zeros((self.trees, self.inner, x.shape[1]))
        self.offset = np.zeros((self.trees, self.inner))
        for t in range(self.trees):
            rng = np.random.default_rng([seed, t])
            at = {0: np.arange(len(x))}
            for i in range(self.inner):
                own = at.pop(i)
                if len(own) > 1:
                    a, b = x[rng.choice(own, 2, replace=False)]
                    w = a - b if (a != b).any() else rng.standard_normal(x.shape[1])
                    self.normal[t, i] = w / np.linalg.norm(w)
                    p = x[own] @ self.normal[t, i]
                    self.offset[t, i] = np.median(p)
                    right = p >= self.offset[t, i]
                    at[2 * i + 1], at[2 * i + 2] = own[~right], own[right]
                else:
                    at[2 * i + 1], at[2 * i + 2] = own[:0], own
        self.flat = self.normal.reshape(-1, x.shape[1]), self.offset.ravel()

    def longer(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.norm**2 - (v * v).sum(axis=1)))
        return np.column_stack([v, more])

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees."""
        x, out = self.longer(v), np.empty((len(v), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(v), np.int64)
            side = x @ self.normal[t].T >= self.offset[t]
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(v)), node]
            out[:, t] = node - self.inner + t * (self.inner + 1)
        return out

    def visit(self, v: np.ndarray, most: int) -> list[list[int]]:
        """The leaves that each query comes to, nearest branches of all trees first."""
        margins = (self.longer(v, True) @ self.flat[0].T - self.flat[1]).reshape(len(v), self.trees, self.inner)
        out = []
        for m in margins.tolist():
            queue, got = [(0.0, t, 0) for t in range(self.trees)], []
            while queue and len(got) < most:
                far, t, node = heapq.heappop(queue)
                while node < self.inner:
                    d = m[t][node]
                    heapq.heappush(queue, (max(far, abs(d)), t, 2 * node + 1 + (d < 0)))
                    node = 2 * node + 1 + (d >= 0)
                got.append(node - self.inner + t * (self.inner + 1))
            out.append(got)
        return out


def search(base: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 12, leaf: int = 64, share: float = 0.16, sample: int = 4096, block: int = 4096, own: bool = False, seed: int = 7) -> DataFrame:
    """Per query its k nearest rows of base: query_id, rank (from 1), vec_id, score. own: whether a row may find itself."""
    spark = prepare(base.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(usable("v") & F.col("id").isNotNull()).withColumn("cls", F.xxhash64("v"))

    rows_b = rows(base)
    classes = saved(rows_b.groupBy("cls").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v")))
    forests: dict[int, Forest] = {}
    # a row for each length of vectors, and for each at most `sample` vectors
    for dim, n, norm in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)")).alias("norm")).orderBy("dim").collect():
        fitted = least_by_hash(classes.where(F.size("v") == dim), "cls", sample).select("v").toPandas()["v"]
        depth = max(0, int(np.log2(max(1, min(n, sample) / leaf))))
        forests[dim] = Forest(np.array([np.asarray(x) for x in fitted]).reshape(len(fitted), dim), float(np.sqrt(norm)), trees, depth, seed)
    model = spark.sparkContext.broadcast(forests)

    def by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, Forest, np.ndarray]]:
        """Places of the rows of each length that has a forest, the forest, and the rows."""
        size = np.asarray(col.value_lengths())
        for dim in np.unique(size).tolist():
            if dim in model.value:
                at = np.flatnonzero(size == dim)
                for i in range(0, len(at), 2000):
                    yield at[i : i + 2000], model.value[dim], matrix(col.take(pa.array(at[i : i + 2000])))

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, forest, v in by_length(batch.column(0)):
                got = forest.leaves(v).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), v.shape[1], np.int32)), pa.array(got)], ["dim", "leaf"])

    # of each length at most trees * 2^depth rows
    counts = classes.select("v").mapInArrow(leaf_of, "dim int, leaf long").groupBy("dim", "leaf").agg(F.count("*").alias("n")).collect()
    split = {(r["dim"], r["leaf"]): -(-r["n"] // block) for r in counts}
    slots = max(2 * parts(spark), -(-sum(r["n"] for r in counts) // ROWS))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, forest, v in by_length(batch.column(2)):
                got = forest.leaves(v)
                back = pa.array(np.repeat(at, got.shape[1]))
                part = batch.column(0).take(back).to_numpy() % np.array([split[v.shape[1], x] for x in got.ravel().tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(got.size, v.shape[1], np.int32)), pa.array(got.ravel()), pa.array(part), *(batch.column(c).take(back) for c in range(3))], ["dim", "leaf", "part", "cls", "rep", "v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, forest, v in by_length(batch.column(2)):
                most = max(1, int(np.ceil(share * forest.trees * (forest.inner + 1))))
                for i in range(0, len(at), 200):
                    to = [(q, x, p) for q, leaves in enumerate(forest.visit(v[i : i + 200], most)) for x in leaves for p in range(split.get((v.shape[1], x), 0))]
                    back = pa.array(at[i + np.array([x[0] for x in to], np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), v.shape[1], np.int32)), pa.array([x[1] for x in to], pa.int64()), pa.array([x[2] for x in to], pa.int64()), *(batch.column(c).take(back) for c in range(3))], ["dim", "leaf", "part", "cls", "rep", "v"])

    def best(q: np.ndarray, cls: np.ndarray, rep: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((-score, cls, q))
        q, cls, rep, score = q[order], cls[order], rep[order], score[order]
        keep = np.concatenate([[True], (q[1:] != q[:-1]) | (cls[1:] != cls[:-1])])[: len(q)]
        q, cls, rep, score = q[keep], cls[keep], rep[keep], score[keep]
        order = np.lexsort((cls, rep, -score, q))
        q, cls, rep, score = q[order], cls[order], rep[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return pd.DataFrame({"q": q[nth <= k], "cls": cls[nth <= k], "rep": rep[nth <= k], "score": score[nth <= k]})

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        dim, at, part, cls, rep, is_q, vs = (pdf[c].to_numpy() for c in ("dim", "leaf", "part", "cls", "rep", "is_q", "v"))
        order = np.lexsort((cls, rep, is_q, part, at, dim))
        dim, at, part, cls, rep, is_q, vs = dim[order], at[order], part[order], cls[order], rep[order], is_q[order], vs[order]
        cut = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1]), [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            m = a + int((~is_q[a:b]).sum())
            if a == m or m == b:
                continue
            have = np.stack(vs[a:m])
            for i in range(m, b, 1000):
                ask = np.stack(vs[i : min(b, i + 1000)])
                s = ask @ have.T
                kk = min(k + 1, m - a)
                if kk < m - a:  # with all that tie with the last
                    bound = np.partition(s, m - a - kk, axis=1)[:, m - a - kk]
                    x, y = np.nonzero(s >= bound[:, None])
                else:
                    x, y = np.nonzero(np.ones_like(s, bool))
                out.append((cls[i + x], cls[a + y], rep[a + y], s[x, y]))
        if not out:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "cls": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        return best(*(np.concatenate(x) for x in zip(*out)))

    vectors = "dim int, leaf long, part long, cls long, rep long, v array<double>"
    rows_q = rows(queries)
    ask = rows_q.groupBy("cls").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v")).select("cls", "rep", "v")
    both = classes.select("cls", "rep", "v").mapInArrow(stored, vectors).withColumn("is_q", F.lit(False)).union(ask.mapInArrow(asked, vectors).withColumn("is_q", F.lit(True)))
    found = both.groupBy(F.pmod(F.xxhash64("dim", "leaf", "part"), F.lit(slots)).alias("slot")).applyInPandas(score, "q long, cls long, rep long, score double")
    found = found.groupBy(F.pmod(F.xxhash64("q"), F.lit(slots)).alias("slot")).applyInPandas(lambda pdf: best(*(pdf[c].to_numpy() for c in ("q", "cls", "rep", "score"))), "q long, cls long, rep long, score double")
    ids = rows_b.select("cls", "id").withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("nth") <= k + 1).select("cls", "id")
    near = found.select("q", "cls", "score").join(ids, "cls").withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k + 1)
    near = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score", "cls"))).alias("near"))  # at most k + 1
    out = rows_q.select(F.col("cls").alias("q"), F.col("id").alias("query_id")).join(near, "q")
    if not own:
        mine = F.array_position(F.transform("near", lambda x: (x["id"] == F.col("query_id")) & (x["cls"] == F.col("q"))), True)
        out = out.withColumn("mine", mine).withColumn("near", F.filter("near", lambda x, i: i + 1 != F.col("mine")))
    out = out.select("query_id", F.slice("near", 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
