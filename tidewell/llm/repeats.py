"""Suffix-array dedup: which bytes lie in a string of a given length that starts more than once in all texts.

1. Anchors. Every window of `length` bytes has one anchor, its `gram`-byte string of least hash (the leftmost of equals).
   Equal windows have equal anchors, so windows that could be equal share an anchor string. Neighbouring windows of one
   anchor form a context. A census counts the anchors and the contexts of all texts by their hashes.
2. A context that occurs again is repeated as a whole. One whose anchor has no other kind of context is unique or done.
   Of the others, those that differ though they share an anchor, each kind must be compared.
3. Those contexts, cut out of their texts, meet by anchor, and the difference-cover algorithm sorts the suffixes of each
   bucket: it sorts and names the triples at two of three places, recurses on the names, merges the remaining suffixes,
   and compares neighbours by their whole first `length` bytes. Windows found equal are repeats. Where an anchor has more
   than `hot` contexts, their windows are dealt to families by the place of the anchor in them: two families for up to
   twice as many contexts, four for four times, and so on. Equal windows are of one family and agree in all bytes that its
   windows have in common, by which the family's pieces meet, so the sort of a hot anchor is spread over many buckets.
4. A text's repeats from 2 and 3 are joined with it and united into spans.

Each distinct text takes part under its hash; a text that occurs more than once is a repeat as a whole, so a group of
copies of any size costs a row for each task. No step samples, drops or shortens anything; the result is exact but for
collisions of 64-bit hashes. Handled cases: null and empty texts have no bytes; texts shorter than `length` keep all;
matches never cross rows; equal rows are rows of their own (and so repeat each other); an empty table gives no rows;
other columns, whatever their names, are carried along only if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.census import Flush, census, plan
from tidewell.llm.common import U8, by_bytes, mix, parts, powers, prepare, saved, signed, string_hashes, sums, text_bytes
from tidewell.llm.packed import expand, framed, squeeze, unframed
from tidewell.llm.suffixes import repeated

#: Contexts of a bucket to sort, about.
SORTED = 10_000
_HALF = U8(0xFFFFFFFF)


def contexts(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window start (within the row), anchor hash and context hash of each context."""
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    room = np.diff(off) - length + 1  # windows of each row
    if n < length or not (room > 0).any():
        return none, none, none, none.view(U8), none.view(U8)
    c = sums(data)
    p = powers(n + 1)[1]
    h = mix((c[gram:] - c[:-gram]) * p[: n - gram + 1])
    v = (h & ~_HALF) | np.arange(len(h), dtype=U8)
    pad = -len(v) % w
    v = np.concatenate([v, np.full(pad, ~U8(0))]).reshape(-1, w)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & _HALF).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    full = np.flatnonzero(room > 0)
    inside[off[full]] += 1
    inside[off[full] + room[full]] -= 1
    ok = np.cumsum(inside)[:m] > 0
    start = ok.copy()
    start[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    start[off[full]] = True
    end = ok.copy()
    end[:-1] &= ~ok[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    row = np.searchsorted(off, s, "right") - 1
    a = anchor[s]
    return row, s - off[row], e - off[row], h[a], mix(string_hashes(c, s, e + length) + (a - s).astype(U8))


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that intervals cover; runs that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], reach[last]


def spans(docs: DataFrame, *, text: str = "text", length: int = 200, gram: int = 40, hot: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(h, copies) of every distinct text, and (h, spans) of those with repeats that are not copies of a whole text.

    h is the 64-bit hash of a text; spans holds the starts and ends of its repeats as little-endian 64-bit integers.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = saved(rows.groupBy("h").agg(F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("size")))
    total = texts.agg(F.sum("size")).first()[0] or 0
    texts = texts.drop("size")
    sizes = plan(4 * total // (length - gram + 1), 2 * parts(spark), 400_000)  # two keys for about every half window

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[Flush]:
        held: list[tuple] = []
        seen: set[int] = set()
        total = 0

        def flush() -> Flush:
            doc, s, e, a, c = (np.concatenate(x) for x in zip(*held))
            return np.concatenate([mix(a), mix(a + U8(3) * c)]), framed(squeeze(doc, kind="<u8"), squeeze(s, e))

        for batch in batches:
            own = batch.column(1).to_pylist()
            keep = [i for i, x in enumerate(own) if not (x in seen or seen.add(x))]  # a task's first copy of a text
            if len(keep) < len(own):
                batch = batch.take(pa.array(keep, pa.int64()))
            data, off = text_bytes(batch.column(0))
            hashes = batch.column(1).to_numpy().view(U8)
            for i, j in by_bytes(off):
                row, s, e, a, c = contexts(data[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)
                if len(row):
                    held.append((hashes[i + row], s, e, a, c))
                    total += len(row)
                if 2 * total > sizes.held:
                    yield flush()
                    held, total = [], 0
            if len(seen) > 1 << 18:
                seen = set()
        if held:
            yield flush()

    def judged(kept: bytes, totals: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        doc, rest = unframed(kept)
        doc, (s, e) = expand(doc, 1, "<u8")[0], (x.astype(np.int64) for x in expand(rest, 2))
        n = len(s)
        of_a, of_c, a = totals[:n], totals[n:], keys[:n]
        ask = of_a > of_c  # another context has this anchor
        same = np.flatnonzero(ask & (of_c > 1))
        ask[same] = False
        ask[same[np.unique(keys[n:][same], return_index=True)[1]]] = True  # the first of each kind
        families = np.where(of_a > hot, 1 << np.ceil(np.log2(np.maximum(1, of_a / hot))).astype(np.int64), 1)
        sign = (of_c > 1) + 2 * ask
        order = np.lexsort((s, doc))
        order = order[sign[order] > 0]
        doc, s, e, sign, a, families = doc[order], s[order], e[order], sign[order], a[order], families[order]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(0, np.int64)
        out = []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            t, q = sign[x:y] & 1 > 0, sign[x:y] & 2 > 0
            start, end = united(s[x:y][t], e[x:y][t] + length)
            asked = np.stack([s[x:y][q], e[x:y][q], signed(a[x:y][q]), families[x:y][q]], 1).astype("<i8").tobytes()
            out.append((int(doc[x : x + 1].view(np.int64)[0]), np.stack([start, end], 1).astype("<i8").tobytes(), asked))
        return pd.DataFrame(out, columns=["h", "spans", "asked"]).astype({"h": "int64"})

    known = census(rows, anchored, judged, "h long, spans binary, asked binary", sizes)
    # a text read by several tasks has a row of each, which may ask for different contexts
    known = saved(known.groupBy("h").agg(F.first("spans").alias("spans"), F.collect_list("asked").alias("asked")))
    count = known.agg(F.sum(F.aggregate("asked", F.lit(0).cast("long"), lambda n, x: n + F.length(x)))).first()[0] or 0
    fine = max(8 * parts(spark), -(-count // (32 * SORTED)))

    def asked_of(lists: list[bytes]) -> np.ndarray:
        """First and last window start, anchor and families of the contexts asked for."""
        return np.unique(np.frombuffer(b"".join(lists), "<i8").reshape(-1, 4), axis=0)

    def pieces(raw: np.ndarray, s: int, e: int, anchor: int, families: int) -> Iterator[tuple[int, int, bytes]]:
        """Bucket, first window start and bytes of a context's windows of each family."""
        if families == 1:
            yield anchor % fine, s, raw[s : e + length].tobytes()
            return
        c = sums(raw[e : s + length])  # all windows hold these bytes, and the anchor is among them
        h = mix((c[gram:] - c[:-gram]) * powers(len(c))[1][: len(c) - gram])
        at = e + int(np.argmin(h & ~_HALF))
        width = -(-(length - gram + 1) // families)
        for k in range(-(-(length - gram + 1) // width)):  # windows that start k * width to (k + 1) * width - 1 before the anchor
            low, high = max(s, at - (k + 1) * width + 1), min(e, at - k * width)
            if low <= high:
                common = raw[at - k * width : at - (k + 1) * width + 1 + length].tobytes()
                yield int.from_bytes(hashlib.blake2b(common, digest_size=7, key=b"%d" % k).digest(), "little") % fine, low, raw[low : high + length].tobytes()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            out: list[tuple] = []
            for i, (h, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if h not in seen:  # its other copies follow
                    seen = {h}
                    raw = data[off[i] : off[i + 1]]
                    out += [(bucket, h, low, piece) for x in asked_of(asked).tolist() for bucket, low, piece in pieces(raw, *x)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["bucket", "h", "s", "bytes"])

    def sorted_(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "s"])
        size = pdf["bytes"].map(len).to_numpy()
        ends = np.cumsum(size)
        got = repeated(np.frombuffer(b"".join(pdf["bytes"]), np.uint8), ends, length)
        row = np.searchsorted(ends, got, "right")
        new = np.concatenate([[True], (got[1:] != got[:-1] + 1) | (row[1:] != row[:-1])])[: len(got)]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(got) - 1)[: int(new.sum())]
        first, row = got[new], row[new]
        base = pdf["s"].to_numpy()[row] - (ends - size)[row]
        return pd.DataFrame({"h": pdf["h"].to_numpy()[row], "s": first + base, "e": got[last] + base + length})

    # texts, each once for a task, with the contexts asked for
    some = known.where(F.exists("asked", lambda x: F.length(x) > 0)).select("h", "asked")
    some = rows.join(some, "h").select("h", "text", "asked").sortWithinPartitions("h")
    more = some.mapInArrow(cut_out, "bucket long, h long, s long, bytes binary").repartition(fine, "bucket").groupBy("bucket").applyInPandas(sorted_, "h long, s long, e long")
    more = more.groupBy("h").agg(F.collect_list(F.struct("s", "e")).alias("more"))  # of one distinct text

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one, two in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.concatenate([np.frombuffer(one or b"", "<i8").reshape(-1, 2), np.array([(r["s"], r["e"]) for r in two or ()], np.int64).reshape(-1, 2)])
                out.append(np.stack(united(x[:, 0], x[:, 1]), 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["h", "spans"])

    found = known.select("h", "spans").join(more, "h", "full_outer").mapInArrow(all_of, "h long, spans binary")
    return texts, found


def dedup(docs: DataFrame, *, text: str = "text", length: int = 200, gram: int = 40, hot: int = 2_000, carry: tuple[str, ...] = ("doc_id",), whole_characters: bool = False, keep_text: bool = False) -> DataFrame:
    """Per row: the carried columns, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept text.

    With whole_characters a span that would cut a character in two keeps that character, so that the kept bytes are UTF-8;
    keep_text needs it.
    """
    texts, found = spans(docs, text=text, length=length, gram=gram, hot=hot)
    df = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__h", F.xxhash64("__text"))
    info = texts.join(found, "h", "left").where("copies > 1 or spans is not null").select(F.col("h").alias("__h"), "copies", "spans")
    df = df.join(info, "__h", "left").select(*carry, "__text", F.col("copies").alias("__copies"), F.col("spans").alias("__spans"))
    names = list(carry)
    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept string"] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(names)
            data, off = text_bytes(batch.column(k))
            out: list[tuple] = []
            for i, (copies, found) in enumerate(zip(batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist())):
                raw = data[off[i] : off[i + 1]]
                n = len(raw)
                if (copies or 0) > 1 and n >= length:
                    cut = np.array([[0, n]])
                else:
                    cut = np.frombuffer(found or b"", "<i8").reshape(-1, 2)
                if whole_characters and len(cut):
                    head = np.flatnonzero((raw & 0xC0) != 0x80)
                    head = np.append(head, n)
                    cut = np.stack([head[np.searchsorted(head, cut[:, 0])], head[np.searchsorted(head, cut[:, 1], "right") - 1]], 1)
                    cut = cut[cut[:, 1] > cut[:, 0]]
                kept, last, digest = [], 0, hashlib.sha256()
                for a, b in cut.tolist():
                    kept.append(raw[last:a].tobytes())
                    last = b
                kept.append(raw[last:].tobytes())
                for x in kept:
                    digest.update(x)
                out.append((n, int((cut[:, 1] - cut[:, 0]).sum()), len(cut), digest.hexdigest(), b"".join(kept).decode() if keep_text else None))
            cols = [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))][: 5 if keep_text else 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), *cols], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: k + len(cols)])

    return df.mapInArrow(run, kinds)
