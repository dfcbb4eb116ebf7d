"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's leaves hold the rank of the pair that starts there, or infinity. The root is the lowest rank, at its leftmost
place, so each merge reads the root and updates the leaves of the pair and of its neighbours, in logarithmic time, until
no pair can merge. Words that a batch sees for the first time are merged together: their trees are the rows of one array,
and a merge step is done in all of them at once; where only a few words of a length are new, each has a tree of its own in
plain integers. Known words come from a cache of a fixed number of places.

Texts are cut at ASCII white space, over which neither the normal form nor a word reaches. A run of plain bytes is cut into
words by byte classes. A run with any other byte (an apostrophe, another script, a control character) is normalised and
cut by the vocabulary's pattern, and its words go through the same cache; short runs are cached whole.

Handled cases: null and empty texts give no ids; special strings of the vocabulary in a text give their ids, as in the
library; a word of any length costs n log n; equal words are merged once while they stay in the cache; an empty table
gives no rows; repeated and null keys are carried through; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import U8, by_bytes, distinct, prepare, string_hashes, sums, text_bytes, tokenizer_path

#: Places of the cache of words, a power of two, and ids that it holds, at most.
PLACES, HELD = 1 << 19, 1 << 22
#: Cells of the trees of words merged together, at most; so few words have trees of their own.
TOGETHER, FEW = 1 << 19, 24
#: Bytes of a run that the cache holds whole, at most.
RUN = 64

# Plain bytes are of ASCII (no control characters but white space, no apostrophe) and U+00C0 to U+00FF, but no sign of multiplication or division. They are in normal form C, and each byte tells its class and its lower case.
_GAP, _LETTER, _DIGIT, _MARK, _ODD = range(5)
KIND = np.full(256, _ODD, np.uint8)
KIND[32:127] = _MARK
KIND[[9, 10, 13, 32]] = _GAP
KIND[48:58] = _DIGIT
KIND[65:91] = KIND[97:123] = KIND[0x80:0xC0] = KIND[0xC3] = _LETTER
KIND[[39, 0x97, 0xB7]] = _ODD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[0x80:0x9F] += 32


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def byte_letters() -> list[str]:
    """The printable letter of each byte, as byte-level vocabularies write it: visible Latin-1 stands for itself, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(more))
        more += b not in keep
    return out


class SegmentTreeBPE:
    """Encoder and decoder of a vocabulary file with BPE merges, byte letters and a word-end suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = vocab | self.special
        tokens = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            tokens[i] = t.encode()
        self.size = len(tokens)
        self.token_count = np.array([len(x) + 1 for x in tokens])
        self.token_start = np.cumsum(self.token_count) - self.token_count
        self.token_bytes = np.frombuffer(b"".join([x + b" " for x in tokens]), np.uint8)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.n_merges = np.append(keys[order], -1), order.astype(np.int64), len(keys)
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], np.int64)
        self.special_bytes = [x.encode() for x in sorted(self.special, key=len, reverse=True)]
        self.any_special = re.compile(b"|".join(map(re.escape, self.special_bytes)) or rb"(?!)")
        self.cut = None
        self.pairs: dict[int, tuple[int, int]] = {}  # of trees in plain integers
        self._clear()

    def _clear(self) -> None:
        self.known, self.at, self.count = np.zeros(PLACES, U8), np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int32)
        self.pool, self.used = np.zeros(HELD + (HELD >> 2), np.int32), 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; n_merges where they don't merge."""
        key = a * self.size + b
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[np.minimum(at, self.n_merges - 1)], self.n_merges)

    def _merge(self, flat: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most width (a power of two) bytes, one after another, and how many each has."""
        count, rows = len(size), np.arange(len(size))
        inf = self.n_merges * width + width
        row = np.repeat(rows, size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        sym = np.full((count, width + 1), -1, np.int64)
        sym[row, col] = self.inner[flat]
        sym[rows, size - 1] = self.final[flat[np.cumsum(size) - 1]]
        nxt = np.tile(np.arange(1, width + 2), (count, 1))
        prv = np.tile(np.arange(-1, width), (count, 1))
        nxt[rows, size - 1] = width  # the place after the last
        tree = np.full((count, 2 * width), inf, np.int64)
        if width > 1:
            r = self.rank(sym[:, : width - 1], sym[:, 1:width])
            ok = (r < self.n_merges) & (np.arange(1, width)[None, :] < size[:, None])
            tree[:, width : 2 * width - 1] = np.where(ok, r * width + np.arange(width - 1), inf)
            half = width
            while half > 1:
                tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
                half //= 2
        w = np.flatnonzero(tree[:, 1] < inf) if width > 1 else rows[:0]
        while len(w):
            pos, got = tree[w, 1] % width, self.made[tree[w, 1] // width]
            right = nxt[w, pos]
            after, before = nxt[w, right], prv[w, pos]
            sym[w, pos], sym[w, right], nxt[w, pos] = got, -1, after
            has = after < width
            prv[w[has], after[has]] = pos[has]
            new = np.where(has, self.rank(got, sym[w, after]), self.n_merges)
            tree[w, width + right] = inf
            tree[w, width + pos] = np.where(new < self.n_merges, new * width + pos, inf)
            left = before >= 0
            r = self.rank(sym[w[left], before[left]], got[left])
            tree[w[left], width + before[left]] = np.where(r < self.n_merges, r * width + before[left], inf)
            for place, at in ((right, w), (pos, w), (before[left], w[left])):
                node = (place + width) >> 1
                while len(node) and node[0]:  # all nodes are on one level
                    tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
                    node = node >> 1
            w = w[tree[w, 1] < inf]
        kept = sym >= 0
        return sym[kept], kept.sum(axis=1)

    def _merge_one(self, word: bytes) -> list[int]:
        """Ids of one word: the same tree in plain integers, of which a merge reads and mends a few paths."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys[:-1].tolist(), zip(self.ranks.tolist(), self.made[self.ranks].tolist())))
        n, size, pairs = len(word), self.size, self.pairs
        sym = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        width = 1 << max(1, (n - 1).bit_length())
        inf = self.n_merges * width + width
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [inf] * (2 * width)
        for i in range(n - 1):
            if got := pairs.get(sym[i] * size + sym[i + 1]):
                tree[width + i] = got[0] * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                a = a if a < b else b
                if tree[at] == a:
                    return
                tree[at] = a
                at >>= 1

        while tree[1] < inf:
            pos = tree[1] % width
            right, before = nxt[pos], prv[pos]
            after = nxt[right]
            got = sym[pos] = pairs[sym[pos] * size + sym[right]][1]
            sym[right], nxt[pos] = -1, after
            put(right, inf)
            new = None
            if after < n:
                prv[after] = pos
                new = pairs.get(got * size + sym[after])
            put(pos, new[0] * width + pos if new else inf)
            if before >= 0:
                new = pairs.get(sym[before] * size + got)
                put(before, new[0] * width + before if new else inf)
        return [x for x in sym if x >= 0]

    def merged(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[s:e], one after another, and how many each has."""
        size = e - s
        width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        ids, at, count = [], np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        used = 0
        for k in np.unique(width).tolist():
            all_of, step = np.flatnonzero(width == k), max(1, TOGETHER // (2 * k))
            for i in range(0, len(all_of), step):
                part = all_of[i : i + step]
                if len(part) < FEW:
                    each = [self._merge_one(data[a:b].tobytes()) for a, b in zip(s[part].tolist(), e[part].tolist())]
                    got, n = np.array([x for w in each for x in w], np.int64), np.array([len(w) for w in each], np.int64)
                else:
                    got, n = self._merge(data[ragged(s[part], size[part])], size[part], k)
                ids.append(got)
                count[part] = n
                at[part] = used + np.cumsum(n) - n
                used += len(got)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return flat[ragged(at, count)], count

    def _cached(self, h: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], short: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings of these hashes, one after another, and how many each has.

        make gives them for places of strings that the cache doesn't hold; of these, the short ones are kept.
        """
        place = (h & U8(PLACES - 1)).astype(np.int64)
        hit = self.known[place] == h
        count, at = np.where(hit, self.count[place], 0).astype(np.int64), np.cumsum(hit)
        out = self.pool[ragged(self.at[place[hit]], count[hit])]
        if hit.all():
            return out, count
        at[hit] = np.cumsum(count[hit]) - count[hit]
        miss = np.flatnonzero(~hit)
        fresh, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
        ids, n = make(miss[first])
        begin = np.cumsum(n) - n
        at[miss], count[miss] = len(out) + begin[back], n[back]
        out = np.concatenate([out, ids])[ragged(at, count)]
        keep = np.flatnonzero(short[miss[first]]) if short is not None else np.arange(len(fresh))
        if len(keep) < len(fresh):
            ids, fresh, n = ids[ragged(begin[keep], n[keep])], fresh[keep], n[keep]
            begin = np.cumsum(n) - n
        if self.used + len(ids) > len(self.pool):
            self._clear()
        if len(ids) <= len(self.pool):  # else a batch of very long words, which are not kept
            self.pool[self.used : self.used + len(ids)] = ids
            to = (fresh & U8(PLACES - 1)).astype(np.int64)
            self.known[to], self.at[to], self.count[to] = fresh, self.used + begin, n
            self.used += len(ids)
        return out, count

    def _odd(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs without ASCII white space, one after another, and how many each has."""
        if self.cut is None:
            import regex

            self.cut = regex.compile(r"\r|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        text = b"\r".join(runs).decode()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("\u03a3", "\u03c3").lower()  # letter by letter: no final sigma
        found = "\n".join(self.cut.findall(text)).encode()
        data = np.frombuffer(found, np.uint8)
        e = np.append(np.flatnonzero(data == 10), len(data)) if len(data) else np.zeros(0, np.int64)
        s = np.concatenate([[0], e[:-1] + 1]).astype(np.int64)[: len(e)]
        ends = (e - s == 1) & (data[s] == 13) if len(s) else np.zeros(0, bool)
        run = np.cumsum(ends)[~ends]
        s, e = s[~ends], e[~ends]
        ids, n = self._cached(string_hashes(sums(data), s, e), lambda at: self.merged(data, s[at], e[at]))
        return ids, np.bincount(run, n, len(runs)).astype(np.int64)

    def _words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings, and the n + 1 bounds of each text's ids."""
        kind, low = KIND[data], LOWER[data]
        change = np.empty(len(data) + 1, bool)
        change[0] = change[-1] = True
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        change[off] = True
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):  # runs with such a byte stay whole
            edge = np.flatnonzero(np.diff(np.concatenate([[True], kind == _GAP, [True]])) != 0)
            edge = distinct(np.sort(np.concatenate([edge, off])))
            run = distinct(np.searchsorted(edge, odd, "right") - 1)
            a, b = edge[run], edge[run + 1]
            change[ragged(a + 1, b - a - 1)] = False
        cuts = np.flatnonzero(change)
        s, e = cuts[:-1], cuts[1:]
        word = kind[s] != _GAP
        s, e = s[word], e[word]
        bound = np.searchsorted(s, off)
        if not len(odd):
            ids, n = self._cached(string_hashes(sums(low), s, e), lambda at: self.merged(low, s[at], e[at]))
            return ids, np.concatenate([[0], np.cumsum(n)])[bound]
        whole = np.zeros(len(s), bool)
        whole[np.searchsorted(s, a)] = True
        n = np.zeros(len(s), np.int64)
        ps, pe = s[~whole], e[~whole]
        plain, n[~whole] = self._cached(string_hashes(sums(low), ps, pe), lambda at: self.merged(low, ps[at], pe[at]))
        flat, size = data[ragged(a, b - a)], b - a
        h = string_hashes(sums(flat), np.cumsum(size) - size, np.cumsum(size)) ^ U8(0xA24BAED4963EE407)  # apart from the words'
        others, n[whole] = self._cached(h, lambda at: self._odd([data[x:y].tobytes() for x, y in zip(a[at].tolist(), b[at].tolist())]), size <= RUN)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = np.empty(total[-1], plain.dtype)
        ids[ragged(total[:-1][~whole], n[~whole])] = plain
        ids[ragged(total[:-1][whole], n[whole])] = others
        return ids, total[bound]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, given as bytes and the n + 1 offsets of each, and the n + 1 bounds of each text's ids."""
        raw, marks = data.tobytes(), []
        if any(x in raw for x in self.special_bytes):
            for i in range(len(off) - 1):
                marks += [(off[i] + m.start(), off[i] + m.end(), self.special[m[0].decode()]) for m in self.any_special.finditer(raw[off[i] : off[i + 1]])]
        if not marks:
            return self._words(data, off)
        # texts are cut at special strings; the pieces go on without them
        s, e, name = (np.array(x, np.int64) for x in zip(*marks))
        keep = np.ones(len(data), bool)
        keep[ragged(s, e - s)] = False
        at = np.concatenate([[0], np.cumsum(keep)])
        cuts = np.sort(np.concatenate([off, s]), kind="stable")
        ids, bound = self._words(data[keep], at[cuts])
        nth = np.searchsorted(off, s, "right") + np.arange(len(s))  # the cut of each special string
        before = np.searchsorted(s, off)
        return np.insert(ids, bound[nth], name), bound[np.arange(len(off)) + before] + before

    def decode(self, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False) of each row of ids, with its start and end.

        The vocabulary has no decoder, so the library joins the tokens by spaces.
        """
        n = self.token_count[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        s, e = total[bound[:-1]], total[bound[1:]]
        return self.token_bytes[ragged(self.token_start[ids], n)], s, np.maximum(s, e - 1)


_loaded: dict[str, SegmentTreeBPE] = {}


def loaded(path: str) -> SegmentTreeBPE:
    if path not in _loaded:
        _loaded[path] = SegmentTreeBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", keep_ids: bool = True) -> DataFrame:
    """Per row of docs: key, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (array of int) and decoded.

    One map over the input, no shuffle. Null text: no ids. Repeated rows: a result for each.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path(vocabulary))
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in by_bytes(off):
                ids, bound = bpe.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                out, s, e = bpe.decode(ids, bound)
                ids = ids.astype("<u4")
                cols = [batch.column(0).slice(i, j - i), pa.array(np.diff(bound)), pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]), pa.array([hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(s.tolist(), e.tolist())])]
                if keep_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array([out[a:b].tobytes().decode() for a, b in zip(s.tolist(), e.tolist())])]
                yield pa.RecordBatch.from_arrays(cols, [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    more = ", ids array<int>, decoded string" if keep_ids else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
