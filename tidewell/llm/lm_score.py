"""LM scoring by cross-entropy difference: bigram models of a target and of a background corpus over one vocabulary.

The vocabulary is all V - 1 words of both corpora and one unknown word, and a text starts with a start symbol. Each model
counts every word and bigram of its whole corpus:

    p(w) = (c(w) + 1) / (N + V),   p(w | u) = (c(u w) + mu p(w)) / (c(u) + mu)

A text's losses are the means over its words of -ln p under either model, and its score is their difference, target less
background: the smaller, the more it is like the target.

Words and bigrams are 64-bit hashes, and nothing grows with the vocabulary but what is shuffled. The distinct words and
bigrams of some thousand texts of one corpus, a flush, go with their counts to buckets, as many as the words ask for,
which add them up for both corpora and send each flush of the background its totals. There they meet the flush's words, which travel with one of its blocks,
and the losses are summed in double precision. Only V, N and the numbers of texts reach the driver. Texts take part under
their hash, so that copies share a result.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. Handled cases: null and empty texts
have no words and null losses; an empty target leaves a uniform target model; repeated rows count each time in the corpora;
an empty table gives no rows; other columns are not read. Results are exact but for collisions of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.census import plan
from tidewell.llm.common import LOWER, STEP, SYMBOL, U8, by_bytes, mix, parts, prepare, signed, text_bytes, word_hashes, words
from tidewell.llm.packed import expand, framed, squeeze, unframed

_START = U8(0x8EBC6AF09C88C6E3)


def grams(known: np.ndarray, ids: np.ndarray, length: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Of texts of so many words, given by their places in known: keys of the words and distinct bigrams, their order by
    bucket, the bounds of the buckets in it, each bigram's two words (the start is 0, known begins at 1), each word's bigram."""
    prev = np.concatenate([[0], ids[:-1] + 1])
    prev[np.cumsum(length) - length] = 0
    code, of = np.unique((prev << 32) | (ids + 1), return_inverse=True)
    u, w = code >> 32, code & 0xFFFFFFFF
    hashes = np.concatenate([[_START], known])
    keys = np.concatenate([known, mix(mix(hashes[u]) * U8(0x9E3779B97F4A7C15) + hashes[w] * U8(0xC2B2AE3D27D4EB4F) + U8(1))])
    bucket = (keys % U8(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return keys, order, np.searchsorted(bucket[order], np.arange(buckets + 1)), u, w, of


def score(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", mu: float = 10.0) -> DataFrame:
    """Per row of docs: key, n_words, target_loss, background_loss, difference. docs are the background corpus."""
    spark = prepare(docs.sparkSession)
    pick = lambda df, c: df.select(F.coalesce(F.col(c), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    both = pick(docs, text).withColumn("side", F.lit(0)).union(pick(target, target_text).withColumn("side", F.lit(1)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            side = batch.column(2).to_numpy()
            for i, j in by_bytes(off, 16 * STEP):
                low = LOWER[data[off[i] : off[j]]]
                s, e, bound = words(low, off[i : j + 1] - off[i], SYMBOL)
                h = word_hashes(low, s, e)
                of = np.repeat(side[i:j], np.diff(bound))
                for k in (0, 1):
                    w, n = np.unique(h[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(n if k == 0 else 0 * n), pa.array(n if k else 0 * n)], ["w", "b", "t"])

    counts = both.mapInArrow(counted, "w long, b long, t long").groupBy("w").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    distinct, *total = counts.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    texts = both.agg(F.coalesce(F.sum(1 - F.col("side")), F.lit(0)), F.coalesce(F.sum("side"), F.lit(0))).first()
    size = distinct + 1
    buckets, flushes, held_words = plan(sum(total), 2 * parts(spark))  # a flush has about as many distinct words and bigrams as words

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]  # of each side

        def flush(side: int) -> pa.RecordBatch:
            nonlocal serial
            h, length, own = (np.concatenate(x) for x in zip(*held[side]))
            held[side] = []
            known, ids, n = np.unique(h, return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")  # places of frequent words are small and pack well
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            known, n, ids = known[by], n[by], place[ids]
            keys, order, ends, _, _, of = grams(known, ids, length, buckets)
            n = np.concatenate([n, np.bincount(of)])[order]
            keys = keys[order]
            full = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]
            kept = framed(known.tobytes(), squeeze(ids), squeeze(length), own.tobytes()) if side == 0 else b""
            serial += 1
            out = [(k, serial, side, framed(squeeze(keys[a:b], kind="<u8"), squeeze(n[a:b])), kept if i == (serial + (serial >> 32)) % len(full) else b"") for i, (k, a, b) in enumerate(full)]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "flush", "side", "counts", "kept"])

        for batch in batches:
            sides = batch.column(2).to_numpy()
            for side in np.unique(sides).tolist():
                mine = np.flatnonzero(sides == side)
                d, o = text_bytes(batch.column(0).take(pa.array(mine)) if len(mine) < len(sides) else batch.column(0))
                own = batch.column(1).to_numpy().view(U8)[mine]
                for i, j in by_bytes(o):
                    low = LOWER[d[o[i] : o[j]]]
                    s, e, bound = words(low, o[i : j + 1] - o[i], SYMBOL)
                    length = np.diff(bound)
                    if len(s):
                        held[side].append((word_hashes(low, s, e), length[length > 0], own[i:j][length > 0]))
                    if sum(len(x[0]) for x in held[side]) > held_words:
                        yield flush(side)
        for side in (0, 1):
            if held[side]:
                yield flush(side)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unframed(x) for x in pdf["counts"]]
        keys = [expand(x, 1, "<u8")[0] for x, _ in got]
        length = [len(x) for x in keys]
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        n, side = np.concatenate([expand(x, 1)[0] for _, x in got]), np.repeat(pdf["side"].to_numpy(), length)
        sums = [np.bincount(back, np.where(side == k, n, 0)).astype(U8) for k in (0, 1)]
        out, at = [], 0
        for m, bucket, flush, of, kept in zip(length, pdf["bucket"], pdf["flush"], pdf["side"], pdf["kept"]):
            if of == 0:
                out.append((bucket, flush, squeeze(*(x[back[at : at + m]] for x in sums), kind="<u8"), kept))
            at += m
        return pd.DataFrame(out, columns=["bucket", "flush", "totals", "kept"]).astype({"bucket": "int64", "flush": "int64"})

    def losses(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        known, ids, length, own = unframed(b"".join(pdf["kept"]))
        known, length = np.frombuffer(known, U8), expand(length, 1)[0].astype(np.int64)
        _, order, _, u, w, of = grams(known, expand(ids, 1)[0].astype(np.int64), length, buckets)
        got = [expand(x, 2, "<u8") for x in pdf["totals"]]
        row, out = np.repeat(np.arange(len(length)), length), []
        for k in (0, 1):
            c = np.empty(len(order))
            c[order] = np.concatenate([x[k] for x in got])
            one, two = np.concatenate([[texts[k]], c[: len(known)]]), c[len(known) :]
            loss = -np.log((two + mu * (one[w] + 1) / (total[k] + size)) / (one[u] + mu))
            out.append(np.bincount(row, loss[of]) / length)
        return pd.DataFrame({"h": np.frombuffer(own, np.int64), "n": length, "t": out[1], "b": out[0]})

    per = both.mapInArrow(packed, "bucket long, flush long, side int, counts binary, kept binary").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(added, "bucket long, flush long, totals binary, kept binary")
    per = per.repartition(flushes, "flush").groupBy("flush").applyInPandas(losses, "h long, n long, t double, b double").groupBy("h").agg(*[F.min(c).alias(c) for c in "ntb"])
    out = docs.select(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).join(per, "h", "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n_words"), F.col("t").alias("target_loss"), F.col("b").alias("background_loss"), (F.col("t") - F.col("b")).alias("difference"))
