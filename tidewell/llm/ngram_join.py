"""N-gram Jaccard join: which texts share at least a given part of their word shingles, found with prefix trees.

A text's set holds the 64-bit hashes of its distinct shingles. Texts of equal sets form a class, which takes part once;
different texts under one key are classes of their own, and a group's component is the smallest key of its classes. The steps:

1. Screen. Two sets of at least the asked similarity share at least `level` of the smallest hashes of either, the first
   n - ceil(t n) + level ones (n: set size, level: 0.15 n). A census counts how often each of these occurs. In the order of
   that count, rarest first, two similar sets then share one of the first n - ceil(t n) + 1; a class with as many hashes of
   its own is done.
2. Candidate blocks. Each of those few hashes links its classes to the smallest of them; the components of these links
   are blocks, which between them hold every similar pair, and no pair within a group is written out.
3. Join. A block's sets, their shingles in the order of their hashes, which is one for all sets, are the paths of a
   compressed prefix tree; shingles of one set alone are left out of it. A set walks the tree: sets with a common beginning
   share the overlap counted so far, and a subtree is left when the overlap and what may remain on either side can't reach
   the bound, or when it has no set of a fitting size outside the walker's component. Blocks above `block` classes are
   split into parts, and every pair of parts is a task of its own.
4. Components of the links found.

No step samples or drops anything, so the result is exact but for collisions of 64-bit hashes. Handled cases: null and
empty texts have no shingles and link with nothing; with fewer words than a shingle the whole sequence is one; rows
without a key link with nothing and have no component; equal rows and keys stay in the result once for each row; ties are
broken by the smaller key; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.census import Flush, census, plan
from tidewell.llm.common import U8, by_bytes, mix, parts, prepare, saved, shingle_sets, signed, text_bytes
from tidewell.llm.components import components
from tidewell.llm.packed import expand, framed, squeeze, unframed

#: Sets below a node that are compared at once, without going down to each.
FLAT = 64


def class_of(s: np.ndarray) -> int:
    """A hash of a set, as a signed 64-bit integer; of the empty set 0."""
    return int((mix(s).sum(dtype=U8) ^ mix(np.array([len(s)], U8)))[0].astype(np.int64)) if len(s) else 0


def least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest overlap of a set of n with any similar set."""
    return -(-num * n // den)


def level(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, 15 * n // 100)


def feasible(n: np.ndarray, comp: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the later sets of other components that it may resemble, by their sizes."""
    for q in range(len(n) - 1):
        need = -(-num * (n[q] + n[q + 1 :]) // (num + den))
        yield q, q + 1 + np.flatnonzero((np.minimum(n[q], n[q + 1 :]) >= need) & (comp[q + 1 :] != comp[q]))


def trie_components(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A label for each of the sets (ascending distinct hashes); sets linked through similar ones have the same."""
    m, size = len(sets), np.array([len(x) for x in sets])
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # no overlap lies in hashes of one set alone
    rank = np.cumsum(shared) - 1
    paths, at = [], 0
    for x in size.tolist():
        r = back[at : at + x]
        paths.append(rank[r[shared[r]]])
        at += x
    order = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    paths, size = [paths[i] for i in order], size[order]
    length = np.array([len(x) for x in paths])
    lcp = np.zeros(m, np.int64)
    for i in range(1, m):
        k = min(length[i - 1], length[i])
        differ = np.flatnonzero(paths[i - 1][:k] != paths[i][:k])
        lcp[i] = differ[0] if len(differ) else k
    flat = np.concatenate(paths)
    begin = np.cumsum(length) - length
    # first and last path, values of the edge, depth below, smallest and largest set, longest path, inner children, paths that go on alone
    nodes: list[tuple] = []
    stack = [(0, m, 0, -1)]
    while stack:
        lo, hi, top, parent = stack.pop()
        bottom = int(lcp[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        kids: list[int] = []
        ends = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == bottom)).tolist(), hi] if hi - lo > 1 else [lo]
        one = np.array([a for a, b in zip(ends, ends[1:]) if b - a == 1], np.int64) if hi - lo > 1 else np.array([lo])
        stack += [(a, b, bottom, len(nodes)) for a, b in zip(ends, ends[1:]) if b - a > 1]
        if parent >= 0:
            nodes[parent][7].append(len(nodes))
        nodes.append((lo, hi, paths[lo][top:bottom], bottom, int(size[lo:hi].min()), int(size[lo:hi].max()), int(length[lo:hi].max()), kids, one))
    comp = np.arange(m)
    mask, can = np.zeros(max(1, int(shared.sum())), bool), np.zeros(m, bool)
    need = lambda a, b: -(-num * (a + b) // (num + den))
    for q, able in feasible(size, comp, num, den):
        if not len(able):
            continue
        mine, n = paths[q], int(size[q])
        mask[mine] = True
        can[able], listed = True, able.tolist()
        walk = [(0, 0)]
        while walk:
            node, have = walk.pop()
            lo, hi, part, bottom, smallest, largest, longest, kids, one = nodes[node]
            ahead = able[bisect_left(listed, lo) : bisect_left(listed, hi)]
            if not len(ahead) or largest * den < num * n or smallest * num > den * n:
                continue
            top = bottom - len(part)
            if len(ahead) > FLAT:
                have += int(np.count_nonzero(mask[part]))
                left = len(mine) - (int(np.searchsorted(mine, part[-1], "right")) if len(part) else 0)
                if have + min(longest - bottom, left) < need(n, smallest):
                    continue
                walk += [(x, have) for x in kids]
                top, ahead = bottom, one[can[one]]  # those that end here, or have a leaf of their own below
            ahead = ahead[comp[ahead] != comp[q]]
            if len(ahead):  # what they have left, all at once
                count = length[ahead] - top
                ends = np.cumsum(count)
                rest = np.concatenate([[0], np.cumsum(mask[flat[np.repeat(begin[ahead] + top - ends + count, count) + np.arange(ends[-1])]])])
                for k in ahead[have + rest[ends] - rest[ends - count] >= need(n, size[ahead])].tolist():
                    if comp[k] != comp[q]:
                        comp[comp == comp[k]] = comp[q]
        mask[mine] = False
        can[able] = False
    out = np.empty(m, np.int64)
    out[order] = comp
    return out


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", num: int = 75, den: int = 100, width: int = 5, block: int = 800, hashed: bool = False) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the smallest key that links reach), with hashed text_hash (xxhash64). num / den is the similarity."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*text_bytes(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array([class_of(x) if len(x) else None for x in sets], pa.int64())], ["id", "h", "n", "cls"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Flush]:
        held: list[tuple[int, int, np.ndarray]] = []
        seen: set[int] = set()
        total = 0

        def flush() -> Flush:
            cls, n, size = np.array([x for x, _, _ in held], np.int64), np.array([x for _, x, _ in held]), np.array([len(x) for _, _, x in held])
            return np.concatenate([x for _, _, x in held]), framed(cls.tobytes(), squeeze(n, size))

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in by_bytes(off):
                for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        n = len(s)
                        held.append((c, n, s[: n - int(least(n, num, den)) + int(level(n))]))
                        total += len(held[-1][2])
                if total > sizes.held:
                    yield flush()
                    held, total = [], 0
                if len(seen) > 1 << 18:
                    seen = set()
        if held:
            yield flush()

    def rarest(kept: bytes, df: np.ndarray, token: np.ndarray) -> pd.DataFrame:
        cls, rest = unframed(kept)
        n, size = (x.astype(np.int64) for x in expand(rest, 2))
        owner = np.repeat(np.arange(len(n)), size)
        shared = df > 1
        alone = size - np.bincount(owner[shared], minlength=len(n))  # hashes of the class alone come before
        c, df, token = owner[shared], df[shared], token[shared]
        order = np.lexsort((token, df, c))
        c, token = c[order], token[order]
        first = np.searchsorted(c, np.arange(len(n)))
        keep = np.arange(len(c)) - first[c] < (n - least(n, num, den) + 1 - alone)[c]
        return pd.DataFrame({"token": signed(token[keep]), "cls": np.frombuffer(cls, np.int64)[c[keep]]})

    rows = saved(docs.mapInArrow(profile, "id long, h long, n long, cls long"))
    reps = rows.where("cls is not null and id is not null").groupBy("cls").agg(F.min(F.struct("id", "h")).alias("m"), F.max("n").alias("n"))
    sizes = plan(2 * (reps.agg(F.sum("n")).first()[0] or 0) // 5, 2 * parts(spark))  # of a set the census has two fifths
    reps = reps.select("cls", F.col("m.id").alias("rep"), F.col("m.h").alias("h"))
    tokens = saved(census(docs.where("id is not null"), prefixes, rarest, "token long, cls long", sizes))
    hub = tokens.groupBy("token").agg(F.min("cls").alias("hub"), F.count("*").alias("times")).where("times > 1").select("token", "hub")
    near = tokens.join(hub, "token").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    blocks = components(near).select(F.col("id").alias("cls"), F.col("component").alias("block"))
    members = saved(blocks.join(reps, "cls"))
    split = members.groupBy("block").agg(F.ceil(F.count("*") / block).alias("k"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shingle_sets(*text_bytes(batch.column(3)), width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in got], pa.binary())], ["block", "rep", "cls", "hashes"])

    def similar(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls").sort_values(["rep", "cls"])  # equal rows
        ids = pdf["cls"].to_numpy()
        comp = trie_components([np.frombuffer(x, "<u8") for x in pdf["hashes"]], num, den)
        _, first, back = np.unique(comp, return_index=True, return_inverse=True)
        to = ids[first[back]]
        return pd.DataFrame({"a": ids[to != ids], "b": to[to != ids]})

    full = docs.join(members.withColumnRenamed("rep", "id"), ["id", "h"]).select("block", F.col("id").alias("rep"), "cls", "text").mapInArrow(sets, "block long, rep long, cls long, hashes binary")
    full = full.join(split, "block").withColumn("i", F.pmod(F.xxhash64("cls"), "k").cast("int")).withColumn("j", F.explode(F.expr("sequence(0, cast(k as int) - 1)")))
    links = full.groupBy("block", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).applyInPandas(lambda pdf: similar(pdf), "a long, b long")
    found = components(links).withColumnRenamed("id", "cls")
    smallest = found.join(reps, "cls").groupBy("component").agg(F.min("rep").alias("least"))
    of_class = reps.join(found.join(smallest, "component"), "cls", "left").select("cls", F.coalesce("least", "rep").alias("component"))
    out = rows.join(of_class, "cls", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"), F.col("h").alias("text_hash"))
    return out if hashed else out.drop("text_hash")
