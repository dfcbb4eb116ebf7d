"""Binary sketch states: encoders and decoders, byte-level hashing, and the order-dependent conservative update.

These need Python; they run on Arrow batches, one call for a group or a batch, and stay off the default path.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: The layouts of stored states.
HLL_HEADER, CMS_HEADER, TOP_HEADER = struct.Struct("<3sBB"), struct.Struct("<3sBIIBQ"), struct.Struct("<3sBII")
VERSION = 1


def encode_hll(p: int, registers: np.ndarray) -> bytes:
    return HLL_HEADER.pack(b"HLL", VERSION, p) + registers.astype(np.uint8).tobytes()


def decode_hll(data: bytes) -> tuple[int, np.ndarray]:
    magic, version, p = HLL_HEADER.unpack_from(data)
    body = data[HLL_HEADER.size :]
    if magic != b"HLL" or version != VERSION or len(body) != 1 << p:
        raise ValueError("not a HyperLogLog state of this version")
    return p, np.frombuffer(body, np.uint8)


def encode_cms(width: int, depth: int, total: int, cells: np.ndarray, conservative: bool = False) -> bytes:
    return CMS_HEADER.pack(b"CMS", VERSION, width, depth, conservative, total) + cells.astype("<u8").tobytes()


def decode_cms(data: bytes) -> tuple[int, int, int, bool, np.ndarray]:
    magic, version, width, depth, conservative, total = CMS_HEADER.unpack_from(data)
    body = data[CMS_HEADER.size :]
    if magic != b"CMS" or version != VERSION or len(body) != 8 * width * depth:
        raise ValueError("not a Count-Min state of this version")
    return width, depth, total, bool(conservative), np.frombuffer(body, "<u8")


def encode_top(k: int, cms: bytes, names: list[str]) -> bytes:
    import json

    return TOP_HEADER.pack(b"TOP", VERSION, k, len(cms)) + cms + json.dumps(sorted(names), ensure_ascii=False).encode()


def decode_top(data: bytes) -> tuple[int, bytes, list[str]]:
    import json

    magic, version, k, size = TOP_HEADER.unpack_from(data)
    if magic != b"TOP" or version != VERSION:
        raise ValueError("not a top-k state of this version")
    at = TOP_HEADER.size
    return k, data[at : at + size], json.loads(data[at + size :].decode())


def blake64(item: str) -> int:
    return int.from_bytes(hashlib.blake2b(item.encode(), digest_size=8).digest(), "little")


def blake_pair(item: str) -> tuple[int, int]:
    d = hashlib.blake2b(item.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1


def hashed(df: DataFrame, item: str) -> DataFrame:
    """item with its 64-bit hash as 16 hex digits, by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item": pdf[item], "h": [f"{blake64(x):016x}" for x in pdf[item]]})

    return df.select(item).mapInPandas(run, "item string, h string")


def merge_hll(one: bytes, two: bytes) -> bytes:
    """The state of the union; the precisions must agree."""
    (p, a), (q, b) = decode_hll(one), decode_hll(two)
    if p != q:
        raise ValueError(f"precisions {p} and {q} differ")
    return encode_hll(p, np.maximum(a, b))


def merge_cms(one: bytes, two: bytes) -> bytes:
    """The state of both streams, with the first one's flag; widths and depths must agree."""
    (w, d, n, flag, a), (w2, d2, n2, _, b) = decode_cms(one), decode_cms(two)
    if (w, d) != (w2, d2):
        raise ValueError(f"sizes {w} x {d} and {w2} x {d2} differ")
    return encode_cms(w, d, n + n2, a + b, flag)


def cms_read(cells: np.ndarray, width: int, depth: int, item: str) -> int:
    """An item's count in decoded cells."""
    a, b = blake_pair(item)
    return int(min(cells[r * width + (a + r * b) % width] for r in range(depth)))


def merge_top(one: bytes, two: bytes) -> bytes:
    """The sketches merged, and of both states' names the k of the largest counts in them; of equal counts the larger name stays."""
    (k, a, x), (_, b, y) = decode_top(one), decode_top(two)
    cms = merge_cms(a, b)
    width, depth, _, _, cells = decode_cms(cms)
    best = sorted(((cms_read(cells, width, depth, i), i) for i in {*x, *y}), reverse=True)[:k]
    return encode_top(k, cms, [i for _, i in best])


def top_of(state: bytes, n: int | None = None) -> list[tuple[str, int]]:
    """A state's names with their counts, read from its sketch, the largest first, of equal ones the smaller name; n or all."""
    k, cms, names = decode_top(state)
    width, depth, _, _, cells = decode_cms(cms)
    return sorted(((i, cms_read(cells, width, depth, i)) for i in names), key=lambda t: (-t[1], t[0]))[: n or k]


def hll_states(items: DataFrame, keys: list[str], item: str, p: int) -> DataFrame:
    """keys and `data`, the encoded registers of each group. Registers meet as rows, of which a group has 2^p at most."""
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.array([blake64(x) for x in pdf[item]], np.uint64)
            rest = (h << np.uint64(p)) >> np.uint64(p)
            rank = (64 - p) - np.array([x.bit_length() for x in rest.tolist()], np.int64) + 1
            yield pdf[keys].assign(idx=(h >> np.uint64(64 - p)).astype(np.int32), rank=rank.astype(np.int32))

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        reg = np.zeros(1 << p, np.uint8)
        reg[pdf["idx"]] = pdf["rank"]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "data": [encode_hll(p, reg)]})

    rows = items.where(f"{item} is not null").select(*keys, item).mapInPandas(ranks, f"{kinds}, idx int, rank int")
    return rows.groupBy(*keys, "idx").agg({"rank": "max"}).withColumnRenamed("max(rank)", "rank").groupBy(*keys).applyInPandas(encoded, f"{kinds}, data binary")


def conservative_cells(items: DataFrame, keys: list[str], item: str, n: str, width: int, depth: int) -> DataFrame:
    """keys, item, estimate of a Count-Min sketch with conservative update.

    The result depends on the order of the adds. A group's items are summed and then added the largest first, of equal ones
    the smaller first, in which order the large ones are over-counted least. An update in order needs a group in one task.
    """
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([n, item], ascending=[False, True])
        table = np.zeros((depth, width), np.int64)
        rows = np.arange(depth)
        cols = [np.array([(a + r * b) % width for r in range(depth)]) for a, b in map(blake_pair, pdf[item])]
        for c, x in zip(cols, pdf[n].tolist()):
            table[rows, c] = np.maximum(table[rows, c], table[rows, c].min() + x)
        return pdf[[*keys, item]].assign(estimate=[int(table[rows, c].min()) for c in cols])

    return items.groupBy(*keys, item).agg({n: "sum"}).withColumnRenamed(f"sum({n})", n).groupBy(*keys).applyInPandas(run, f"{kinds}, {item} string, estimate long")


def counted_states(items: DataFrame, keys: list[str], item: str, n: str, width: int, depth: int, k: int) -> DataFrame:
    """keys, `cms` and `top`: of each group an encoded Count-Min sketch, and a top-k state over one with conservative update.

    A group's items, summed before, are added the largest first; of equal estimates the smaller item is in the top.
    """
    kinds = ", ".join(f"{x} {items.schema[x].dataType.simpleString()}" for x in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([n, item], ascending=[False, True])
        names, counts, rows = pdf[item].tolist(), pdf[n].tolist(), np.arange(depth)
        plain, least = np.zeros((2, depth, width), np.uint64)
        cols = [np.array([(a + r * b) % width for r in range(depth)]) for a, b in map(blake_pair, names)]
        for c, x in zip(cols, counts):
            plain[rows, c] += np.uint64(x)
            least[rows, c] = np.maximum(least[rows, c], least[rows, c].min() + np.uint64(x))
        best = sorted(zip((-int(least[rows, c].min()) for c in cols), names))[:k]
        states = encode_cms(width, depth, sum(counts), plain), encode_top(k, encode_cms(width, depth, sum(counts), least, True), [x for _, x in best])
        return pd.DataFrame({**{x: [pdf[x].iloc[0]] for x in keys}, "cms": [states[0]], "top": [states[1]]})

    items = items.where(f"{item} is not null").groupBy(*keys, item).agg({n: "sum"}).withColumnRenamed(f"sum({n})", n)
    return items.groupBy(*keys).applyInPandas(run, f"{kinds}, cms binary, top binary")


DECODED = "kind string, bytes long, header string, p int, width int, depth int, conservative boolean, total long, k int, names array<string>, used long, largest long"


def decoded(states: DataFrame, keys: list[str], data: str) -> DataFrame:
    """keys and what each encoded state says when read again: used and largest are of its registers or cells."""
    kinds = ", ".join(f"{x} {states.schema[x].dataType.simpleString()}" for x in keys)

    head = {"HLL": HLL_HEADER.size, "CMS": CMS_HEADER.size, "TOP": TOP_HEADER.size}

    def read(raw: bytes) -> dict:
        kind = raw[:3].decode()
        out = {"kind": kind, "bytes": len(raw), "header": raw[: head[kind]].hex().upper()}
        if kind == "HLL":
            out["p"], cells = decode_hll(raw)
        else:
            cms = raw
            if kind == "TOP":
                out["k"], cms, out["names"] = decode_top(raw)
            out["width"], out["depth"], out["total"], out["conservative"], cells = decode_cms(cms)
        return out | {"used": int((cells > 0).sum()), "largest": int(cells.max())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [read(x) for x in batch.column(len(keys)).to_pylist()]
            cols = [pa.array([x.get(c) for x in out], t) for c, t in _TYPES.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in range(len(keys))), *cols], [*keys, *_TYPES])

    return states.select(*keys, data).mapInArrow(run, f"{kinds}, {DECODED}")


_TYPES = {"kind": pa.string(), "bytes": pa.int64(), "header": pa.string(), "p": pa.int32(), "width": pa.int32(), "depth": pa.int32(), "conservative": pa.bool_(), "total": pa.int64(), "k": pa.int32(), "names": pa.list_(pa.string()), "used": pa.int64(), "largest": pa.int64()}
