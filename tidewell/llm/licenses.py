"""License notices: exact phrases, and short notices within a bounded number of edits.

Base labels come from places where a phrase's words stand one after another. The fuzzy search is a pigeonhole search: a
notice that may be found with at most k edits is split into k + 1 seeds, of which an occurrence must hold at least one
unchanged, so plain substring search for the seeds finds every candidate. The regex library then matches the notice with
its bounded-error syntax around each seed and reports the span and the edits.

Texts are read whole. The search is on a normal form: A-Z in lower case, words (runs of ASCII letters, digits and non-ASCII
characters) joined by one space; spans are given in words and in characters of that form. Handled cases: null and empty
texts have no words and score 0; a notice that occurs often gives all its places; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import LOWER, SYMBOL, by_bytes, prepare, text_bytes, words

#: Phrases of the base search and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Notice:
    """A text to find with at most so many edits; at least one of the words in need must be there unchanged, so that a near miss is not another license."""

    text: str
    label: str
    edits: int
    need: tuple[str, ...] = ()

    def seeds(self) -> list[tuple[int, str]]:
        """edits + 1 parts of about the same length, and where each starts."""
        n, k = len(self.text), self.edits + 1
        at = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(at, at[1:])]


#: Short notices in normal form. A notice's edits are about an eighth of its length.
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    Notice("under the apache license version 2 0", "apache-2", 3, ("apache",)),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 2, ("nc",)),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
    Notice("gnu general public license version 3", "gpl-3", 3, ("3",)),
    Notice("gnu general public license version 2", "gpl-2", 3, ("2",)),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 8),
    Notice("mozilla public license version 2 0", "mpl-2", 3, ("mozilla",)),
)


def _matcher(notices: tuple[Notice, ...], phrases: dict[str, str]):
    import regex

    fuzzy = [(x, regex.compile(rf"(?b)(?<= )(?:{regex.escape(x.text, special_only=True, literal_spaces=True)}){{e<={x.edits}}}(?= )"), [(a, s.encode()) for a, s in x.seeds()]) for x in notices]
    exact = [(p.encode(), label, len(p.split())) for p, label in phrases.items()]

    def base(low: bytes) -> list[tuple[int, int, str]]:
        """Character start and end of each place of a phrase in the normal form with a space at either end, and its label."""
        out = []
        for p, label, _ in exact:
            at = low.find(b" " + p + b" ")
            while at >= 0:
                out.append((at + 1, at + 1 + len(p), label))
                at = low.find(b" " + p + b" ", at + 1)
        return out

    def near(low: bytes) -> list[tuple[int, int, str, int, int]]:
        """Start, end, label and edits of each place of a notice in the normal form, and the notice's length."""
        out = []
        for notice, pattern, seeds in fuzzy:
            n, k, spots = len(notice.text), notice.edits, set()
            for a, seed in seeds:
                at = low.find(seed)
                while at >= 0:
                    spots.add(at - a)
                    at = low.find(seed, at + 1)
            done = -1
            for spot in sorted(spots):
                lo, hi = max(0, spot - k - 1), spot + n + k + 1
                if hi <= done:
                    continue
                window = low[lo:hi].decode("latin-1")  # a byte is a character, so an edit is of a byte
                for m in pattern.finditer(window):
                    got = m[0]
                    if lo + m.start() >= done and (not notice.need or set(notice.need) & set(got.split())):
                        out.append((lo + m.start(), lo + m.end(), notice.label, sum(m.fuzzy_counts), n))
                        done = lo + m.end()
        return out

    return base, near


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (first word, number of words, label, edits) of each place that either search found. score is the best
    share of a found notice that stands unchanged: 1 less its edits over its length, 1 for a phrase, 0 without any. One map, no shuffle.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, near = _matcher(notices, phrases)
        gap = np.uint8(32)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in by_bytes(off):
                low = LOWER[data[off[i] : off[j]]]
                at = off[i : j + 1] - off[i]
                s, e, bound = words(low, at, SYMBOL)
                # the normal form of all rows, each with a space at either end: a word's bytes and one space for each gap
                size = e - s
                total = np.cumsum(size + 1) - size - 1  # place of each word in the words joined by spaces
                flat = np.full(int(size.sum() + len(size)), gap, np.uint8)
                inside = ~SYMBOL[low]
                flat[np.repeat(total - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = low[inside]
                total = np.append(total, len(flat))
                begin = total[bound]
                raw = flat.tobytes()
                n_words = np.diff(bound)
                rows = []
                for k in range(j - i):
                    if not n_words[k]:
                        rows.append((0, 0, None, None, "", "", 0.0, []))
                        continue
                    doc = b" " + raw[begin[k] : begin[k + 1]]
                    exact, fuzzy = base(doc), near(doc)
                    if not exact and not fuzzy:
                        rows.append((int(n_words[k]), 0, None, None, "", "", 0.0, []))
                        continue
                    starts = total[bound[k] : bound[k + 1]] - begin[k] + 1
                    word = lambda p: int(np.searchsorted(starts, p, "right")) - 1  # noqa: E731, B023
                    where = [word(a) for a, _, _ in exact]
                    spans = [(word(a), word(b - 1) - word(a) + 1, label, 0) for a, b, label in exact] + [(word(a), word(b - 1) - word(a) + 1, label, edits) for a, b, label, edits, _ in fuzzy]
                    score = max([1.0] * bool(exact) + [1 - edits / size for _, _, _, edits, size in fuzzy])
                    rows.append((int(n_words[k]), len(exact), min(where, default=None), max(where, default=None), ",".join(sorted({x[2] for x in exact})), ",".join(sorted({x[2] for x in spans})), score, sorted(set(spans))))
                cols = [batch.column(0).slice(i, j - i)] + [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))]
                cols.append(pa.array([[{"word": a, "words": b, "label": c, "edits": d} for a, b, c, d in r[7]] for r in rows], pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(cols, [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word: long, words: long, label: string, edits: long>>")
