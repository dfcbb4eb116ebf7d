"""What the operators share: text bytes as numpy arrays, word and shingle hashes, checkpoints, settings.

Texts reach Python as Arrow batches; their UTF-8 bytes are read in place, without a Python string for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import importable, shared_folder

U8 = np.uint64
#: Bytes of text that one vectorised step handles at most, unless one word is longer.
STEP = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, bounds the batches they get by bytes, and sees to a checkpoint folder."""
    sc = importable(spark).sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return spark


def saved(df: DataFrame) -> DataFrame:
    """df from files in the session's checkpoint folder: its lineage ends there, and a lost executor loses nothing."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_by_hash(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows whose keys have the least hashes; keys are distinct.

    Only rows whose hashes lie below a bound that about 2 k rows pass are sorted, so that tasks don't each send k rows.
    """
    h, n = F.xxhash64(key), df.count()
    if n > 2 * k + 1000:
        df = df.where(h < int((2 * k + 1000) / n * 2.0**64 - 2.0**63))
    return df.orderBy(h, key).limit(k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    n, (_, offsets, data) = len(col), col.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def by_bytes(off: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows of at most so many bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[0x00:0x30] = SYMBOL[0x3A:0x61] = SYMBOL[0x7B:0x80] = True


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside gap, within a row), and the n + 1 bounds of each row's words."""
    inside = ~gap[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    first[off[full]] = inside[off[full]]
    last[off[full + 1] - 1] = inside[off[full + 1] - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U8(30))
    x *= U8(0xBF58476D1CE4E5B9)
    x ^= x >> U8(27)
    x *= U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=U8) * U8(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, U8), np.ones(1, U8)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(STEP + 2, 1 << (n - 1).bit_length() if n > STEP + 2 else 0)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, U8)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times the inverse power of the start, are hashes of byte strings."""
    out = np.zeros(len(data) + 1, U8)
    np.cumsum(_BYTES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def string_hashes(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e] from c = sums(data)."""
    return mix((c[e] - c[s]) * powers(len(c))[1][s] + (e - s).astype(U8) * U8(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    out, i, n = np.empty(len(s), U8), 0, len(s)
    while i < n:
        j = max(i + 1, int(np.searchsorted(e, s[i] + STEP, "right")))
        a = s[i]
        out[i:j] = string_hashes(sums(data[a : e[j - 1]]), s[i:j] - a, e[i:j] - a)
        i = j
    return out


_PLACE = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the ascending 64-bit hashes of its distinct shingles of so many words, A-Z in lower case.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    if width > len(_PLACE):
        raise ValueError(f"shingles of at most {len(_PLACE)} words")
    out: list[np.ndarray] = []
    for i, j in by_bytes(off):
        low = LOWER[data[off[i] : off[j]]]
        s, e, bound = words(low, off[i : j + 1] - off[i])
        w = word_hashes(low, s, e)
        n = max(0, len(w) - width + 1)
        g = np.zeros(n, U8)
        for k in range(width):
            g += w[k : k + n] * U8(_PLACE[k])
        g = mix(g)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if b - a >= width:
                out.append(distinct(np.sort(g[a : b - width + 1])))
            elif b > a:
                out.append(mix(np.array([sum(int(w[a + k]) * _PLACE[k] for k in range(b - a)) + (b - a) & (1 << 64) - 1], U8)))
            else:
                out.append(np.zeros(0, U8))
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of an ascending array."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a vocabulary file on this machine: a path as it is given, or the name of a public one."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
