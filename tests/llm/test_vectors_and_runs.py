"""Clustering, inner-product search and run detection against brute force, over ties, repeats, nulls and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from crossfactor.llm import clustering, inner_products, runs
from crossfactor.llm.common import small

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, `row` int, digest string, block int"


def rows(width, count, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        # A third of all rows share a vector; a few values make many ties.
        v = [0.25] * width if i % 3 == 0 else [rng.choice((-0.5, -0.01, 0.0, 0.3, 1.0)) * (1 + i % 5) for _ in range(width)]
        out.append((i, v))
    out += [(20, [0.1] * width), (20, [0.1] * width), (None, [0.3] * width), (7, None), (40, [None] * width), (60, [float("nan")] * width), (80, [float("inf")] + [0.0] * (width - 1)), (100, [1.0] * (width - 1)), (120, [])]
    return out


def frame(spark, given):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y", 3) for i, v in given], SCHEMA).repartition(3)


def whole(given, length=None):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and (length is None or len(v) == length)
    return [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in given if ok(v)]


def lloyd(given, clusters, rounds, components):
    kept = whole(given, components)
    draw = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in draw[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        found = [place(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), f in zip(kept, found, strict=True) if f == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, *place(v)[::-1]) for i, v in kept], centroids


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("components", [64, 5])
def test_clustering(spark, components):
    given = rows(components, 150, 1)
    wanted, centroids = lloyd(given, 16, 3, components)
    found = clustering.cluster(frame(spark, given), components=components)
    assert sorted(map(tuple, found.assigned.collect()), key=key) == sorted(wanted, key=key) and found.centroids == centroids
    if components == 64:
        got = clustering.label(frame(spark, given)).collect()
        inertia = [sum(d for _, k, d in wanted if k == c) for c in range(16)]
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
        assert all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (inertia[r.cluster], sum(inertia), digests[r.cluster]) for r in got) and len(got) == len(wanted)


def test_clustering_of_few_and_none(spark):
    assert clustering.label(frame(spark, [])).count() == 0
    few = clustering.label(frame(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, None)])).collect()
    assert {(r.vec_id, r.cluster, r.distance, r.inertia) for r in few} == {(1, 0, 0, 0), (2, 0, 0, 0)}
    with pytest.raises(Exception, match="beyond"):
        clustering.label(frame(spark, [(1, [1e8] * 64)])).collect()


def test_weighted_sums_are_exact():
    rng = random.Random(2)
    values = [[rng.choice((-1, 1)) * rng.randrange(1 << 27) for _ in range(3)] for _ in range(50)]
    weights = [rng.randrange(1 << 36) for _ in values]
    assert clustering.sums(np.array(values), np.array(weights)) == [sum(w * v[k] for v, w in zip(values, weights, strict=True)) for k in range(3)]


def searched(given, k):
    kept = whole(given)
    out = []
    for a, (i, v) in enumerate(kept):
        if i is None or i % 20:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(kept) if a != b)  # noqa: B905
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(scores[:k])]
    return sorted(out, key=key)


@pytest.mark.parametrize(("block", "group", "cut", "k"), [(4096, 4096, 256, 20), (16, 4, 5, 3), (7, 2, 3, 20), (1, 1, 1, 2)])
def test_search(spark, monkeypatch, block, group, cut, k):
    for name, value in (("BLOCK", block), ("QUERIES", group), ("SLICE", cut), ("PAIRS", 50)):
        monkeypatch.setattr(inner_products, name, value)
    given = rows(6, 60 if block == 1 else 130, 3)
    got = inner_products.search(frame(spark, given), k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == searched(given, k)


def test_search_of_few_and_none(spark):
    assert inner_products.search(frame(spark, [])).count() == 0
    assert inner_products.search(frame(spark, [(1, [1.0])])).count() == 0
    assert [tuple(r) for r in inner_products.search(frame(spark, [(0, [1.0]), (1, [2.0, 5.0])])).collect()] == [(0, 1, 1, 64 * 128)]


def test_bounds_leave_the_best(monkeypatch):
    """Lengths of many sizes and a steep spectrum: few pairs are scored, and none is missed."""
    rng = np.random.default_rng(4)
    whole = (rng.normal(size=(3000, 16)) * np.geomspace(2000, 1, 16) * rng.lognormal(size=(3000, 1))).astype(np.int64)
    whole = whole[np.argsort(-(whole**2).sum(axis=1), kind="stable")]
    turn = np.linalg.eigh((whole.T @ whole).astype(float))[1][:, ::-1]
    sides = inner_products.Side.of(whole, turn, [4, 8]), inner_products.Side.of(whole[::50], turn, [4, 8])
    scored = []
    beating = inner_products.beating
    monkeypatch.setattr(inner_products, "beating", lambda *a: scored.append(len((out := beating(*a))[0])) or out)
    ids = np.arange(3000)
    q, c, score = inner_products.best(sides[1], sides[0], np.full(60, inner_products.NONE), ids[::50], ids, ids, 10, [4, 8])
    exact = whole[::50] @ whole.T
    for i in range(60):
        wanted = sorted((-s, j) for j, s in enumerate(exact[i].tolist()) if j != 50 * i)[:10]
        assert [(-s, j) for s, j in zip(score[q == i].tolist(), c[q == i].tolist(), strict=True)] == wanted
    assert sum(scored) < 60 * 3000 / 4


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = [a == b for a, b in zip(w, w[q:], strict=False)]
        at = 0
        for equal, part in itertools.groupby(same):
            size = len(list(part))
            length = size + q
            seg = w[at : at + length]
            if equal and length >= max(6, 4 * q) and not any(all(seg[x] == seg[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((at, length, q))
            at += size
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 12)):
            n, letters = rng.randint(0, 70), rng.choice((1, 2, 3, 6))
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                begin, period = rng.randrange(n), rng.randint(1, 9)
                w = [w[i] if i < begin else w[begin + (i - begin) % period] for i in range(n)]
            texts.append(w)
        found = runs.runs_of([np.array(w, np.int64) for w in texts])
        assert [list(map(tuple, f.tolist())) for f in found] == [brute_runs(w) for w in texts]


def test_runs_of_fibonacci_and_long_words():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert list(map(tuple, runs.runs_of([np.array(b)])[0].tolist())) == brute_runs(b)
    long = np.concatenate((np.arange(5000), np.tile(np.arange(700), 9), np.arange(5000)))
    assert runs.runs_of([long])[0].tolist() == [[5000, 9 * 700 + 700, 700]]


def brute_digest(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in found), default=None)
    four = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_run_digests(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "a " * 50, "a b c a b c " * 9 + "  x", "x\x1cy " * 8, "hé lł " * 7, "a b " * 4 + "c d " * 4, "same " * 5]
    texts += [" ".join(rng.choices(["the", "cat", "sat", "on", "mats"], k=rng.randint(0, 300))) for _ in range(80)]
    given = [*enumerate(texts), (3, "one"), (None, "a " * 40), (None, None)]
    schema = "doc_id long, text string, runs string, collapsed int, n_words int, __longest int"
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in given], schema).repartition(3)
    for together in (runs.TOGETHER, 100):
        monkeypatch.setattr(runs, "TOGETHER", together)
        got = sorted(map(tuple, runs.digest(docs).collect()), key=key)
        assert got == sorted((brute_digest(i, t) for i, t in given), key=key)
    plain = {r.doc_id: (bytes(r.collapsed), [tuple(x) for x in r.runs]) for r in runs.detect(docs.where("doc_id = 8")).collect()}
    assert plain == {8: (b"a b c d", [(0, 8, 2), (8, 8, 2)])}
    assert runs.digest(spark.createDataFrame([], schema)).count() == 0


def test_small_tables_only_are_broadcast(spark):
    assert small(spark.range(10), 16) and not small(spark.range(500_000), 16)
