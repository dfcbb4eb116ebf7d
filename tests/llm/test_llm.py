"""The training-data operators against brute force, and their edge cases."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ann, bpe, chat, components, licenses, lm_score, near_embed, ngram_join, packing, quality, repeats
from tidewell.llm.common import shingle_sets, text_bytes, tokenizer_path
from tidewell.llm.packing import windows
from tidewell.llm.suffixes import ranks, repeated

SF = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use themselves.
EXTRA = "score string, id string, cls string, h string, rep string, component string, bucket string, spans string, v string, n int"


def documents(spark, rows):
    """Documents of (doc_id, text), with clashing columns of nulls."""
    base = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    return spark.createDataFrame([(k, t, None, None, None, *[None] * 10) for k, t in rows], base)


RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(1, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


_base = prose(120)
_words = _base.split()
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One two three four"), (7, "one two three four"),
    (8, _base), (9, _base), (9, _base), (10, " ".join(_words[:60] + ["X"] + _words[61:])), (11, " ".join(_words[:40])), (None, _base), (None, None),
    (12, prose(4000)), (13, "x" * 5000), (14, "ab" * 3000), (15, "ab" * 3000 + "c"), (16, "日本語 テキスト 👩‍👩‍👧 " * 40), (17, "It's the <|endoftext|> end' don't ÀÉ İ ΑΣ ½ x²"),
    (18, prose(30) + " " + " ".join(_words[20:90])), (19, " ".join(_words[20:90]) + " " + prose(30)), (20, "!!! ??? ...\x00\x01"), (21, "́é ﬁ ẛ̣"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# Tokens


def le(ids):
    return b"".join(struct.pack("<I", i) for i in ids)


def check_encoding(rows, library):
    for r, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        out = library.decode(ids, skip_special_tokens=False)
        assert r.decoded == out
        assert r.ids_sha256 == hashlib.sha256(le(ids)).hexdigest() and r.decoded_sha256 == hashlib.sha256(out.encode()).hexdigest()


def test_bpe_equals_the_library(spark, edge, docs, texts, library):
    got = bpe.encode(edge.withColumn("doc_id", F.monotonically_increasing_id())).orderBy("doc_id").collect()
    check_encoding(zip(got, [t for _, t in EDGE]), library)
    check_encoding(((r, texts[r.doc_id]) for r in bpe.encode(docs).collect()), library)
    assert bpe.encode(edge.limit(0)).count() == 0


def test_bpe_random_words(library):
    rng = random.Random(9)
    tree = bpe.SegmentTreeBPE(tokenizer_path())
    xs = ["".join(rng.choice("abcdefghiéüÀ'!?.1 ") for _ in range(rng.randint(0, 40))) for _ in range(2_000)]
    ids, bound = tree.encode(*text_bytes(pa.array(xs)))
    for k, x in enumerate(xs):
        assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(x, add_special_tokens=False).ids, x


def test_bpe_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "PLACES", 16)
    monkeypatch.setattr(bpe, "HELD", 64)
    tree = bpe.SegmentTreeBPE(tokenizer_path())
    for _ in range(5):
        xs = [prose(50) for _ in range(3)]
        ids, bound = tree.encode(*text_bytes(pa.array(xs)))
        assert all(ids[bound[k] : bound[k + 1]].tolist() == library.encode(x, add_special_tokens=False).ids for k, x in enumerate(xs))


def test_bpe_any_script(library):
    # runs of other scripts, marks that combine, odd white space, special strings, and long words, with a warm and a cold cache
    rng = random.Random(10)
    letters = "abcdefgÀÉé\u0301'’ 1½٣ΑΣςİß\n\t\x0b\x0c\x85\xa0\u3000日本語😀👩\u200d👩\u0338<>|"
    xs = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    xs += ["a<|endoftext|>b'<|startoftext|><|endoftext|>", "<|endoftext|>", "", "x<|endoftext|>", "İ'S <|endoftext|"] * 2
    xs += ["".join(rng.choice("abcdefghij") for _ in range(6_000)), "ab" * 5_000, "日本" * 2_000, "don't " * 500, "x" + "\u0301" * 300]
    tree = bpe.SegmentTreeBPE(tokenizer_path())
    for _ in range(2):
        ids, bound = tree.encode(*text_bytes(pa.array(xs)))
        for k, x in enumerate(xs):
            assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(x, add_special_tokens=False).ids, x


def test_bpe_trees_agree():
    rng = random.Random(11)
    tree = bpe.SegmentTreeBPE(tokenizer_path())
    for _ in range(300):
        w = bytes(rng.choice(b"abcdeinorst\xc3\xa9") for _ in range(rng.randint(1, 70)))
        one, n = tree._merge(np.frombuffer(w, np.uint8), np.array([len(w)]), 128)
        assert tree._merge_one(w) == one.tolist() and n.tolist() == [len(one)]


def check_packing(pieces, want, capacity):
    """want: a Counter of (doc_id, ids with the end token)."""
    by_seq = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == p.length > 0 and p.ids_crc32 == zlib.crc32(le(p.ids))
        by_seq[p.sequence_id].append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for k, ps in by_doc.items():
        ids = [x for (d, i), n in want.items() if d == k for x in [i] * n]
        assert sum(p.length for p in ps) == sum(map(len, ids))
        if len(ids) == 1:
            ps.sort(key=lambda p: p.start)
            assert sum([list(p.ids) for p in ps], []) == list(ids[0]) and all(p.doc_tokens == len(ids[0]) for p in ps)
    assert set(by_doc) == {d for d, _ in want}
    total = sum(p.length for p in pieces)
    return 1 - total / (capacity * len(by_seq))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(edge, docs, texts, library, capacity):
    full = lambda t: tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)
    check_packing(packing.pack(edge, capacity=capacity).collect(), Counter((k, full(t)) for k, t in EDGE), capacity)
    waste = check_packing(packing.pack(docs, capacity=capacity, group=50_000).collect(), Counter((k, full(t)) for k, t in texts.items()), capacity)
    assert waste < 0.08
    assert packing.pack(edge.limit(0)).count() == 0


def test_windows_hold_their_capacity():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 100, int(rng.integers(1, 80)))
        w = windows(sizes, 100)
        assert np.bincount(w, sizes).max() <= 100
    assert sorted(np.bincount(windows(np.array([4, 5, 6, 7, 8]), 16), [4, 5, 6, 7, 8]).tolist()) == [14, 16]
    with pytest.raises(ValueError):
        windows(np.array([5]), 4)


# Similarity


def word_sets(rows):
    out = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def linked(rows):
    """Smallest id that links reach, for each row; rows without an id have none."""
    sets, comp = word_sets(rows), [k for k, _ in rows]
    again = True
    while again:
        again = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and comp[i] is not None and comp[j] is not None and 100 * len(a & b) >= 75 * len(a | b) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    again = True
        least = {}
        for (k, _), c in zip(rows, comp):  # rows of one id are one node
            if k is not None:
                least[k] = min(least.get(k, c), c)
        for i, (k, _) in enumerate(rows):
            if k is not None and comp[i] != least[k]:
                comp[i], again = least[k], True
    return comp, [len(s) for s in sets]


def chain(rng, n):
    """Texts in long chains of neighbours, all of which share most of their words."""
    base, out = [f"w{i}" for i in range(80)], []
    for i in range(n):
        if rng.random() < 0.9:
            base[rng.randrange(80)] = f"v{rng.randrange(10_000)}"
        out.append((100 + i, " ".join(base)))
    return out


@pytest.mark.parametrize("block", [2000, 7])
def test_ngram_join(spark, edge, texts, block):
    rows = [(k, t) for k, t in EDGE if k != 9] + chain(random.Random(4), 60)
    comp, n = linked(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows), block=block).collect())
    assert got == Counter((k, m, c) for (k, _), m, c in zip(rows, n, comp))


def test_ngram_join_edges(spark, edge):
    got = ngram_join.join(edge).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id in (8, 9, 10)} == {8} and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3, 11))
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.join(edge.limit(0)).count() == 0


@pytest.mark.parametrize("block", [800, 2])
def test_different_texts_under_one_id(spark, block):
    from corpus_pipeline import near_copies

    # of each three texts the second resembles the others, which don't resemble each other; two of them share an id
    rng, rows = random.Random(12), []
    for k in range(8):
        b = [f"g{k}n{i}" for i in range(100)]
        a, c = [f"a{k}n{i}" for i in range(9)] + b[9:], b[:91] + [f"c{k}n{i}" for i in range(9)]
        both = [(10 * k + 5, " ".join(a)), (10 * k + 5, " ".join(b))]
        rows += [*(both if k % 2 else both[::-1]), (10 * k + 7, " ".join(c)), (10 * k + 7, f"clean {prose(40, rng)}")]
    got = Counter(map(tuple, ngram_join.join(documents(spark, rows), block=block).select("doc_id", "component_id").collect()))
    assert got == {(10 * k + i, 10 * k + c): n for k in range(8) for i, c, n in ((5, 5, 2), (7, 5, 1), (7, 7, 1))}
    kept = near_copies(spark, documents(spark, rows), SF).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter(r for i, r in enumerate(rows) if i % 4 != 2)


def test_trie_against_all_pairs():
    rng = random.Random(8)
    for _ in range(60):
        pool = [rng.randrange(1, 60) for _ in range(40)]
        sets = [np.array(sorted({rng.choice(pool) for _ in range(rng.randint(1, 30))}), np.uint64) for _ in range(rng.randint(2, 40))]
        got = ngram_join.trie_components(sets, 75, 100)
        comp = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 75 * len(a | b):
                    x, y = comp[i], comp[j]
                    comp = [x if c == y else c for c in comp]
        assert len(set(zip(got.tolist(), comp))) == len(set(comp)) == len(set(got.tolist()))


def test_least_by_hash(spark):
    from tidewell.llm.common import least_by_hash

    for n, k in ((10, 20), (5_000, 300), (50_000, 40)):
        df = spark.range(n)
        assert {r.id for r in least_by_hash(df, "id", k).collect()} == {r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(k).collect()}


def test_census(spark):
    import pandas as pd

    from tidewell.llm.census import Plan, census, plan

    def cut(batches):
        for b in batches:
            k = b.column(0).to_numpy().astype(np.uint64)
            for i in range(0, len(k), 7):
                yield k[i : i + 7], k[i : i + 7].tobytes()

    def finish(kept, totals, keys):
        return pd.DataFrame({"k": np.frombuffer(kept, np.int64), "n": totals, "key": keys.astype(np.int64)})

    values = [RNG.randrange(1, 40) for _ in range(300)] + [5] * 200 + list(range(100, 130))
    got = Counter(map(tuple, census(spark.createDataFrame([(v,) for v in values], "v long").repartition(6), cut, finish, "k long, n long, key long", Plan(5, 3, 7)).collect()))
    n = Counter(values)
    assert got == Counter((v, n[v], v if n[v] > 1 else 0) for v in values)
    assert plan(0, 16) == (16, 16, 1 << 19)
    for keys in (10**7, 10**9, 10**11, 10**13):  # buckets and flushes stay of a bounded size, blocks of a useful one
        p = plan(keys, 16)
        assert keys / p.buckets <= 1 << 23 and p.held <= 1 << 22 and (p.held >= 64 * p.buckets or p.held == 1 << 22)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)] + [(7, 7), (9, None)]
    want = {x: x for e in edges for x in e if x is not None}
    again = True
    while again:
        again = False
        for a, b in edges:
            if b is not None and want[a] != want[b]:
                m, again = min(want[a], want[b]), True
                want[a] = want[b] = m
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[x] == want[x] for x in got) and {x for a, b in edges if b is not None and a != b for x in (a, b)} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, " + EXTRA


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, *[None] * 10) for k, v in rows], VECTORS)


def cloud(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * rng.choice([0.1, 0.2, 1.0], (n, 1))).astype(np.float32)
    x[50:60] = x[49]
    return [(i, [float(y) for y in v]) for i, v in enumerate(x)]


BAD_VECTORS = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] + [1.0] * 23), (1004, [float("inf")] + [1.0] * 23), (1005, [None] + [1.0] * 23), (None, [1.0] * 24), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]


@pytest.mark.parametrize("block", [2000, 5])
def test_near_embeddings(spark, block):
    rows = cloud(1)
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: r for r in near_embed.near(vectors(spark, rows + BAD_VECTORS), block=block).collect() if r.vec_id is not None}
    # verified pairs only, and nearly all of them; equal vectors always
    degree = link.sum(axis=1)
    assert all(got[i].n_links <= degree[i] for i in range(len(x)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.98 * degree.sum()
    assert sum(got[i].component_id == comp[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (1000, 1001, 1002, 1003, 1004, 1005))
    assert (got[1006].n_links, got[1007].component_id) == (1, 1006)
    assert near_embed.near(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2000, 5])
def test_near_embeddings_star(spark, block):
    # four groups on a circle, each of a centre with the largest id and two that link to it and not to each other
    at = [(3 * k + i, math.radians(90 * k + 10 + turn)) for k in range(4) for i, turn in ((1, -17), (2, 17), (3, 0))]
    got = {r.vec_id: r for r in near_embed.near(vectors(spark, [(i, [math.cos(a), math.sin(a)]) for i, a in at]), block=block).collect()}
    assert [got[i].n_links for i in range(1, 13)] == [1, 1, 2] * 4
    assert all(got[i].component_id == i - (i - 1) % 3 and got[i].kept == (i % 3 == 1) for i in range(1, 13))


@pytest.mark.parametrize("dim", [64, 256])
def test_near_embeddings_at_the_bound(spark, dim):
    # pairs just above the asked cosine, with the parameters of the query
    rng, n = np.random.default_rng(4), 1000
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, n, dim)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9505 * x + math.sqrt(1 - 0.9505**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    got = {r.vec_id: r.n_links for r in near_embed.near(vectors(spark, rows)).collect()}
    found = sum(got[i] > 0 for i in range(n)) / n
    print(f"{dim} dimensions: {found:.4f} of the pairs found")
    assert found >= 0.998


def test_near_embeddings_by_brute_force_of_classes(spark):
    # one key with several vectors, repeated rows, norms beyond the range of doubles
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [2.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.02]), (3, [0.0, 1.0, 0.02]), (4, [0.0, 0.0, 1e200]), (5, [0.0, 1e185, 1e200]), (6, [0.0, 0.0, 1e-200]), (2, [0.0, 0.0, 3.0]), (7, [1.0, 1.0, 1.0]), (8, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([np.array(v) / max(v) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    ids, vs = [k for k, _ in rows], [tuple(v) for _, v in rows]
    comp = list(ids)
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
    want = Counter((k, int(link[i].sum()), comp[i], k == comp[i]) for i, k in enumerate(ids))
    assert len(set(vs)) < len(vs) and Counter(map(tuple, near_embed.near(df).collect())) == want


def test_reach():
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 60):
        link = np.triu(rng.random((n, n)) < 1.2 / n, 1)
        link |= link.T
        first = np.arange(n)
        for _ in range(n):
            first = np.minimum(first, np.where(link, first[None, :], n).min(axis=1))
        assert near_embed.reach(link).tolist() == first.tolist()


def test_neighbours(spark):
    rows = cloud(2, 1500)
    rows += [(2000 + i, rows[49][1]) for i in range(40)]
    base = vectors(spark, rows + BAD_VECTORS[:7])
    got = defaultdict(list)
    for r in ann.search(base, base.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], np.float64)
    hit = 0
    queries = [k for k in ids.tolist() if k % 20 == 0]
    assert set(got) == set(queries)
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        mine = got[q]
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in {k for _, k, _ in mine}
        at = dict(zip(ids.tolist(), s.tolist()))
        assert all(math.isclose(at[k], v, rel_tol=1e-12) for _, k, v in mine)
        assert all((-a[2], a[1]) <= (-b[2] + 1e-9, b[1]) or a[2] > b[2] for a, b in zip(mine, mine[1:]))
        hit += len({int(ids[k]) for k in order} & {k for _, k, _ in mine})
    assert hit / (20 * len(queries)) >= 0.9
    few = vectors(spark, rows[:7])
    assert ann.search(few, few.where("vec_id = 0")).count() == 6
    assert ann.search(vectors(spark, []), vectors(spark, [])).count() == 0


def test_neighbours_of_repeated_keys_and_lengths(spark):
    # one key under two vectors, repeated rows, and three lengths, searched exactly
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.standard_normal(d)]) for d, n in ((3, 60), (5, 30), (2, 3)) for k in rng.integers(0, 45, n)]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (40, rows[0][1])]
    base = vectors(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = [(r.vec_id, r.embedding) for r in base.collect()]
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            got = sorted((-float(np.dot(v, w)), k) for j, (k, w) in enumerate(rows) if i != j and len(v) == len(w))[:20]
            want.update((q, r + 1, k, round(-s, 9)) for r, (s, k) in enumerate(got))
    got = ann.search(base, base.where("vec_id % 20 = 0")).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == want


# Repeats


def cut_by_hand(texts, length):
    raw, out = [(t or "").encode() for t in texts], []
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,hot", [(200, 40, 2_000), (200, 40, 2), (200, 40, 1), (20, 8, 2_000), (20, 8, 1), (12, 12, 3)])
def test_repeats(spark, edge, length, gram, hot):
    rows = EDGE + [(200 + i, prose(60) + "\n" + _base[40:300] + "\n" + prose(20)) for i in range(12)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(documents(spark, rows), length=length, gram=gram, hot=hot).collect())
    assert got == Counter((k, *x) for (k, _), x in zip(rows, cut_by_hand([t for _, t in rows], length)))


def test_repeats_keep_whole_characters(spark):
    a, b = "é" * 120 + "x" + prose(50), "é" * 120 + "y" + prose(50)
    got = repeats.dedup(documents(spark, [(1, a), (2, b)]), length=30, gram=10, whole_characters=True, keep_text=True).collect()
    assert all(r.kept in (a, b) or r.kept in a or r.kept in b for r in got)
    assert repeats.dedup(documents(spark, [])).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 60)))
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert ranks(s)[order].tolist() == list(range(1, len(s) + 1))
    for _ in range(100):
        length = int(rng.integers(1, 14))
        rows = [rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 60))).astype(np.uint8) for _ in range(4)]
        text, ends = np.concatenate(rows), np.cumsum([len(x) for x in rows])
        at = {int(e - len(x)) + i: x[i : i + length].tobytes() for x, e in zip(rows, ends) for i in range(len(x) - length + 1)}
        n = Counter(at.values())
        assert repeated(text, ends, length).tolist() == sorted(i for i in at if n[at[i]] > 1)


# Text


def test_licenses(spark, edge):
    lines = {
        1: ("Released under the MIT License.", 1, "mit", "mit", 1), 2: ("Apache License, Version 2.0 and CC BY-NC 4.0", 2, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1), 3: ("Licensed under the Apcahe Licence, Version 2.0", 0, "", "", 0),
        4: ("relased undr the MIT licence", 0, "", "mit", 0.8), 5: ("the GNU General Public Licence, version 3", 0, "", "gpl-3", 0.9), 6: ("under the mitt license", 0, "", "", 0), 7: ("under the MIT license " * 2000, 2000, "mit", "mit", 1), 8: (None, 0, "", "", 0), 9: ("under the mit license", 0, "", None, None),
    }
    got = {r.doc_id: r for r in licenses.scan(documents(spark, [(k, v[0]) for k, v in lines.items()])).collect()}
    for k, (text, n, base, labels, least) in lines.items():
        r = got[k]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), n, base), k
        assert labels is None or (r.labels == labels and r.score >= least), (k, r)
    assert (got[7].first_word, got[7].last_word) == (0, 4 * 1999)
    assert (got[2].first_word, got[2].last_word) == (0, 6)
    assert licenses.scan(edge).count() == len(EDGE) and licenses.scan(edge.limit(0)).count() == 0


def test_licenses_base_against_words(docs, texts):
    for r in licenses.scan(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id]))
        at = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_licenses_by_brute_force(spark):
    # notices with random edits among random words: labels, spans, edits and score over all windows of whole words
    rng, rows = random.Random(21), []
    for i in range(240):
        notice = rng.choice(licenses.NOTICES)
        t = list(notice.text)
        for _ in range(rng.randint(0, notice.edits + 2)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
        rows.append((i, f"{prose(rng.randint(0, 6), rng)} {''.join(t)} {prose(rng.randint(0, 6), rng)}"))
    hits = 0
    for r in licenses.scan(documents(spark, rows)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[r.doc_id][1].lower())
        best = {x: 1.0 for p, x in licenses.PHRASES.items() if f" {p} " in f" {' '.join(w)} "}  # by label how much of a notice stands
        for n in licenses.NOTICES:
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + len(n.text.split()) + 4) + 1):
                    span = " ".join(w[a:b]).encode()
                    if abs(len(span) - len(n.text)) <= n.edits and (not n.need or set(n.need) & set(w[a:b])):
                        d = edit_distance(n.text.encode(), span)
                        if d <= n.edits:
                            best[n.label] = max(best.get(n.label, 0), 1 - d / len(n.text))
        assert r.labels == ",".join(sorted(best)), rows[r.doc_id]
        assert math.isclose(r.score, max(best.values(), default=0.0)), (rows[r.doc_id], r)
        for x in r.spans:
            span = " ".join(w[x.word : x.word + x.words]).encode()
            assert x.edits == min(edit_distance(n.text.encode(), span) for n in licenses.NOTICES if n.label == x.label) or x.edits == 0
        hits += bool(best)
    assert 60 < hits < 240


def test_quality_by_hand(spark):
    # grams, learner and scores against a plain version over dictionaries
    def plain_grams(t):
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|([!-/:-@\[-`{-~])\1*", t)
        words = [m[0] for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+|([!-/:-@\[-`{-~])\1*", t)]
        return words

    texts = ["one two one", "a b", "", "no no, no", "x . x", "Zwölf Äpfel -- 12"]
    assert [plain_grams(t) for t in texts] == [["one", "two", "one"], ["a", "b"], [], ["no", "no", ",", "no"], ["x", ".", "x"], ["Zwölf", "Äpfel", "--", "12"]]
    places, bound = quality.grams(*text_bytes(pa.array(texts)), 40)
    seen, back = {}, {}
    for k, t in enumerate(texts):
        words = plain_grams(t)
        keys = []
        for i, w in enumerate(words):
            again = i > 0 and words[i - 1] == w or i > 1 and words[i - 2] == w and re.fullmatch(r"[!-/:-@\[-`{-~]+", words[i - 1])
            keys += [w, "again" if again else (words[i - 1] if i else None, w)]
        got = places[bound[k] : bound[k + 1]].tolist()
        assert len(got) == len(keys)
        for key, g in zip(keys, got):
            assert seen.setdefault(key, g) == g and back.setdefault(g, key) == key
    rng = random.Random(2)
    rows = [([rng.randrange(16) for _ in range(rng.randint(0, 12))], rng.randint(0, 1)) for _ in range(60)]
    learner, z, n = quality.Learner(4, 0.7, 1.3, 0.05, 0.1), defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((1.3 + math.sqrt(n[i])) / 0.7 + 0.1)
    for got, y in rows:
        learner.update(np.array(got, np.uint32), y)
        x = {i: c / math.sqrt(max(1, len(got))) for i, c in Counter(got).items()} | {"bias": 1.0}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            w = weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * w
            n[i] += g * g
    w, b = learner.model()
    assert np.allclose(np.frombuffer(w, "<f4"), [weight(i) for i in range(16)], atol=1e-6) and math.isclose(b, weight("bias"), rel_tol=1e-9)
    texts = [t for t, _ in zip(["one two", "three one two two", None, ""], range(4))]
    model = quality.fit(documents(spark, [(i, f"one two w{i}" if i % 2 else f"three four w{i}") for i in range(50)]), spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"), bits=12)
    got = {r.doc_id: r.score for r in quality.score(documents(spark, list(enumerate(texts))), model).collect()}
    v = np.frombuffer(model[0], "<f4").astype(float)
    for k, t in enumerate(texts):
        at, _ = quality.grams(*text_bytes(pa.array([t or ""])), 12)
        assert math.isclose(got[k], 1 / (1 + math.exp(-(v[at].sum() / math.sqrt(max(1, len(at))) + model[1]))), rel_tol=1e-9)


def test_quality_held_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(d, quality.fit(d, y)).where(quality.fold(F.col("doc_id")) == 0).join(y, "doc_id").select("quality", "score", "predicted").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.7


def test_quality_edges(spark, edge):
    labels = spark.createDataFrame([(8, 1, 0), (8, 0, 0), (12, 0, 1), (13, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(edge, quality.fit(edge, labels)).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = quality.fit(edge, labels.limit(0))
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}
    assert quality.score(edge.limit(0), none).count() == 0
    assert quality.fit(edge, labels) == quality.fit(edge.orderBy(F.desc("doc_id")), labels)


def bigram_losses(rows, corpora, mu=10.0):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    corpora = [[split(t) for t in c] for c in corpora]
    size = len({w for c in corpora for v in c for w in v}) + 1
    out = []
    for c in corpora:
        one, two = Counter(), Counter()
        for v in c:
            one.update(["<s>", *v])
            two.update(zip(["<s>", *v], v))
        n = sum(one.values()) - one["<s>"]
        p = lambda w: (one[w] + 1) / (n + size)  # noqa: E731, B023
        out.append([sum(-math.log((two[u, w] + mu * p(w)) / (one[u] + mu)) for u, w in zip(["<s>", *v], v)) / len(v) if v else None for v in map(split, rows)])
    return out


def test_lm_score(spark, edge):
    target = [_base, "one two one two", None]
    got = lm_score.score(edge.withColumn("doc_id", F.monotonically_increasing_id()), spark.createDataFrame([(t,) for t in target], "text string")).orderBy("doc_id").collect()
    texts = [t for _, t in EDGE]
    for r, t, b in zip(got, *bigram_losses(texts, [target, texts])):
        if b is None:
            assert r[1:] == (0, None, None, None)
        else:
            assert math.isclose(r.target_loss, t, rel_tol=1e-5) and math.isclose(r.background_loss, b, rel_tol=1e-5) and math.isclose(r.difference, t - b, rel_tol=1e-3, abs_tol=1e-4)
    assert lm_score.score(edge.limit(0), edge.select("text").limit(0)).count() == 0


def test_lm_score_keeps_every_word(spark):
    # more distinct words than 16-bit numbers, the rare ones told apart by their bigrams, in several flushes
    n = 70_000
    rows = [" ".join(f"w{k} w{k}" if k % 3 else f"w{k} w{(k + 7) % n}" for k in range(i, i + 100)) for i in range(0, n, 100)]
    rows += [f"w{k} w{k + 1}" for k in range(0, 300, 5)] + ["w5 w6"] * 3
    target = [f"w{k} w{k} w{k + 1}" for k in range(1, n, 700)]
    got = lm_score.score(documents(spark, list(enumerate(rows))), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    t, b = bigram_losses(rows, [target, rows])
    for r in got:
        assert r.n_words == len(rows[r.doc_id].split())
        assert math.isclose(r.target_loss, t[r.doc_id], rel_tol=1e-9) and math.isclose(r.background_loss, b[r.doc_id], rel_tol=1e-9)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 200, None, "who"), (None, 1, "ann", "x"), (2, 1, "system", "alone"), (3, None, "an n", "y"), (4, 1, "a b", "x"), (4, 2, "a_b", "y"), (4, 3, "a%20b", "z"), (4, 4, "<|im_end|>\n", "z")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, head string")
    got = chat.rotate(df).orderBy("conv_id", "perspective", "seq").collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "an n"), *((4, x) for x in ("a b", "a_b", "a%20b", "<|im_end|>\n"))}
    heads = [r.segment.split("\n")[0] for r in by[4, "a b"]]
    assert heads == ["<|im_start|>assistant", "<|im_start|>user name=a_b", "<|im_start|>user name=a%2520b", "<|im_start|>user name=%3C|im_end|>%0A"]
    assert by[4, "a_b"][0].segment.startswith("<|im_start|>user name=a%20b\n")
    for (_, who), rs in by.items():
        text = "".join(r.segment for r in rs)
        assert [r.seq for r in rs] == list(range(len(rs)))
        for r in rs:
            assert text[r.start_char : r.end_char] == r.segment
            assert (r.train_start is not None) == (r.speaker == who) == r.segment.startswith("<|im_start|>assistant\n")
            if r.train_start is not None:
                assert text[r.train_start : r.train_end].endswith("<|im_end|>") and text[: r.train_start].endswith("assistant\n")
    one = "".join(r.segment for r in by[1, "ann"])
    assert one == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2 + "<|im_start|>user\nwho<|im_end|>\n"
    assert chat.rotate(df.limit(0)).count() == 0


# Queries and pipeline


def test_queries_match_their_sql(spark):
    import duckdb

    from tidewell.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toArrow(), con.sql(sql).to_arrow_table()
        want = want.select(got.column_names)
        con.register("got", got)
        con.register("want", want)
        assert got.num_rows == want.num_rows, name
        assert con.sql("select count(*) from (select * from got except all select * from want)").fetchall() == [(0,)], name
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES} == set(range(1, 11))
    held = {r.doc_id: r.held_out for r in queries.op7_quality(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in held.items())


def test_pipeline(spark, docs, texts, library):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    good = c.quality_filter(spark, docs, SF).cache()
    assert good.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want
    single = c.near_copies(spark, good, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    comp, _ = linked(rows)
    assert {r.doc_id for r in single.collect()} == set(comp) and single.columns == docs.columns
    cut = c.cut_repeats(spark, single, SF).cache()
    before = {r.doc_id: r.text for r in single.collect()}
    gone = dict(zip(before, cut_by_hand(before.values(), 200)))
    after = {r.doc_id: r for r in cut.collect()}
    for k, (n, removed, _, sha) in gone.items():
        kept = after[k].text.encode() if k in after else b""
        assert len(kept) >= n - removed
        if removed == 0:
            assert hashlib.sha256(kept).hexdigest() == sha
    assert sum(len(r.text.encode()) for r in after.values()) <= sum(n - r + 2 * s for n, r, s, _ in gone.values())
    full = lambda t: tuple(library.encode(t, add_special_tokens=False).ids) + (2,)
    check_packing(c.pack(spark, cut, SF).collect(), Counter((k, full(r.text)) for k, r in after.items()), 4096)
    whole = c.run(spark, SF).groupBy("doc_id").agg(F.sum("length")).collect()
    assert dict(map(tuple, whole)) == {k: len(full(r.text)) for k, r in after.items()}


def test_pipeline_edges(spark, edge):
    import corpus_pipeline as c

    for f in (c.near_copies, c.cut_repeats, c.pack):
        assert f(spark, edge, SF).count() > 0
        assert f(spark, edge.limit(0), SF).count() == 0
    assert c.quality_filter(spark, edge, SF).columns == list(c.COLUMNS)
    rows = [(1, _base), (1, _base), (1, "another text of the same id"), (2, _base), (3, None), (None, _base), (None, _base)]
    kept = Counter((r.doc_id, r.text) for r in c.near_copies(spark, documents(spark, rows), SF).collect())
    assert kept == Counter([(1, _base), (1, rows[2][1]), (3, None), (None, _base), (None, _base)])


def test_json_of_vocabulary():
    assert json.load(open(tokenizer_path()))["model"]["end_of_word_suffix"] == "</w>"
    assert [len(x) for x in shingle_sets(*text_bytes(pa.array(["a b c d e f", "A B", None])))] == [2, 1, 0]
