"""Packing: multiway Karmarkar-Karp differencing of token pieces into windows of a fixed capacity.

Every piece starts as a partial partition of m windows of which one holds it. The two partial partitions with the largest
imbalance (largest less smallest sum) merge again and again, the fullest windows of one with the emptiest of the other,
until one is left: m windows of nearly equal sums. If the fullest exceeds the capacity, m rises and the merging starts
anew. Documents longer than the capacity are cut first, into full windows and a rest. A few of the largest rests of a group are
cut into fine parts, which differencing places last and so levels the windows to a few tokens.

Documents are packed in groups of about a million tokens in the order in which a task reads them, so there is no shuffle,
memory is bounded whatever the input, and padding stays below about one window a group. A task's last group is packed with
the one before it if it is small.

Handled cases: null and empty texts are documents of the one end token; a very long document is cut; equal documents are
packed one by one; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewell.llm.bpe import loaded
from tidewell.llm.common import by_bytes, prepare, text_bytes, tokenizer_path

#: Tokens packed together, about.
GROUP = 1 << 20
#: Tokens of a fine part, of which each group has about one for each window.
FINE = 48


def difference(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window (0 to m - 1) of each size by Karmarkar-Karp differencing."""
    n = len(sizes)
    owner = np.arange(n)  # a window of a partial partition is named by one of its pieces; owner leads to the name in the end
    none = np.full(m, -1, np.int64)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, x in enumerate(sizes.tolist()):
        s, w = np.zeros(m, np.int64), none.copy()
        s[-1], w[-1] = x, i
        heap.append((-x, i, s, w))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, s, w = heapq.heappop(heap)
        _, _, t, v = heapq.heappop(heap)
        t, v = t[::-1], v[::-1]  # sums ascend, so the fullest meets the emptiest
        both = (w >= 0) & (v >= 0)
        owner[v[both]] = w[both]
        w = np.where(w >= 0, w, v)
        s = s + t
        order = np.argsort(s, kind="stable")
        s, w = s[order], w[order]
        heapq.heappush(heap, (-int(s[-1] - s[0]), tick, s, w))
        tick += 1
    while True:
        up = owner[owner]
        if (up == owner).all():
            break
        owner = up
    place = np.zeros(n, np.int64)
    if n:
        w = heap[0][3]
        place[w[w >= 0]] = np.flatnonzero(w >= 0)
    return place[owner]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, no window's sum above capacity; sizes above capacity are an error."""
    if len(sizes) and int(sizes.max()) > capacity:
        raise ValueError("a piece exceeds the capacity; cut it first")
    m = max(1, -(-int(sizes.sum()) // capacity))
    while len(sizes):
        out = difference(sizes, m)
        if int(np.bincount(out, sizes).max()) <= capacity:
            return out
        m += max(1, m // 256)
    return np.zeros(0, np.int64)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2, vocabulary: str = "word_bpe_49k.json", group: int = GROUP, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids their ids.

    sequence_id is unique over the result and gapless offsets start from 0 in each. A sequence is padded to the capacity.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path(vocabulary))
        serial = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[bytes] = []
        ready: tuple | None = None
        held = 0

        def placed(names: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal serial
            size = np.array([len(x) // 4 for x in ids], np.int64)
            count = (size - 1) // capacity + 1  # pieces; all but the last fill a window
            rest = size - (count - 1) * capacity
            large = np.argsort(-rest, kind="stable")
            fine = np.zeros(len(ids), np.int64)  # the largest rests are cut into fine parts, which level the windows
            fine[large[np.cumsum(rest[large]) - rest[large] < FINE * (rest.sum() // capacity)]] = FINE
            parts = np.where(fine > 0, -(-rest // np.maximum(fine, 1)), 1)
            doc = np.repeat(np.arange(len(ids)), count - 1 + parts)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count - 1 + parts) - (count - 1 + parts), count - 1 + parts)
            start = np.minimum(nth, count[doc] - 1) * capacity + np.maximum(0, nth - count[doc] + 1) * fine[doc]
            length = np.where(nth < count[doc] - 1, capacity, np.where(fine[doc] > 0, np.minimum(fine[doc], size[doc] - start), rest[doc]))
            seq = np.empty(len(doc), np.int64)
            alone = length == capacity
            rest = windows(length[~alone], capacity)
            used = int(rest.max()) + 1 if len(rest) else 0
            seq[~alone], seq[alone] = rest, used + np.arange(int(alone.sum()))
            order = np.argsort(seq, kind="stable")
            before = np.cumsum(length[order]) - length[order]
            offset = np.empty(len(doc), np.int64)
            offset[order] = before - before[np.searchsorted(seq[order], seq[order])]
            raw = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            cols = [pa.array(names, key_type).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(size[doc]), pa.array(seq + serial), pa.array(offset)]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in raw], pa.list_(pa.int32())))
            serial += len(doc) + 1
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

        for batch in batches:
            key_type, keys = batch.schema.field(0).type, batch.column(0).to_pylist()
            data, off = text_bytes(batch.column(1))
            for i, j in by_bytes(off):
                got, bound = bpe.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                raw, bound = got.astype("<u4").tobytes(), (4 * bound).tolist()
                for k in range(i, j):
                    names.append(keys[k])
                    ids.append(raw[bound[k - i] : bound[k - i + 1]] + end)
                    held += len(ids[-1]) // 4
                    if held >= group:  # one full group waits, so that a small last one can join it
                        if ready:
                            yield placed(*ready)
                        ready, names, ids, held = (names, ids), [], [], 0
        if ready and held < group // 2:
            names, ids, ready = ready[0] + names, ready[1] + ids, None
        if ready:
            yield placed(*ready)
        if ids:
            yield placed(names, ids)

    more = ", ids array<int>" if keep_ids else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {PIECES}{more}")
