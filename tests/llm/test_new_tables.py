"""Merkle manifest, ball k-means and the metric range join against brute force and SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import same

from nearfield.llm import ballkmeans, merkle, metricjoin, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_ball_kmeans", "op13_embedding_near_dedup"])
def test_same_as_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


# --- manifest ------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([digest(*rows[-1][i : i + fanout]) for i in range(0, len(rows[-1]), fanout)])
    return rows


def plain_proof(rows, i, fanout):
    out = []
    for r in rows[:-1]:
        b = i // fanout * fanout
        out.append((r[b:i], r[i + 1 : b + fanout]))
        i //= fanout
    return out


def plain_manifest(rows, fanout):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)

    def leaf(d, text, lang, source, n):
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])

    by = defaultdict(list)
    for r in rows:
        crc = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        offered = leaf(r[0], r[1].translate(lower) if r[1] is not None and crc is not None and crc % 3 == 0 else r[1], *r[2:])
        by[r[2]].append((r[0], leaf(*r), offered))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {x: plain_tree([r[1] for r in by[x]], fanout) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs], fanout) if langs else [[]]
    out = []
    for k, x in enumerate(langs):
        for i, (d, node, h) in enumerate(by[x]):
            proof = plain_proof(trees[x], i, fanout) + plain_proof(top, k, fanout)
            for a, b in proof:
                h = digest(*a, h, *b)
            out.append((d, node, trees[x][-1][0], top[-1][0], digest(*[y for a, b in proof for y in a + b]), h, h == top[-1][0]))
    return out


def manifest_is_plain(spark, rows, fanout, k, partitions=3):
    df = spark.createDataFrame(rows, DOCS).withColumnsRenamed({}).repartition(partitions)
    for c in ("g", "key", "node", "at"):  # columns of names that the operator uses itself
        df = df.withColumn(c, df.n_chars)
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, merkle.document_manifest(df, fanout, k).collect()), key=order) == sorted(plain_manifest(rows, fanout), key=order)


@pytest.mark.parametrize(("fanout", "k"), [(8, 4), (2, 1), (3, 2)])
def test_manifest_is_the_plain_one(spark, fanout, k):
    """Runs of one, superblocks of many levels, languages by bytes and null, repeated and null keys, long and empty texts."""
    rnd = np.random.default_rng(1)
    rows = [(int(i), f"Text {i} ÀB" * int(rnd.integers(0, 4)), str(rnd.choice(["en", "de", "z", "é", ""])), None if i % 7 == 0 else "s:1", None if i % 5 == 0 else i) for i in range(70)]
    rows += [(None, "X", "en", None, 1), (None, "X", "en", None, 1), (3, None, None, None, None), (3, None, None, None, None), (3, "", None, None, 0), (500, "A" * 300_000, "long", "s", 300_000)]
    manifest_is_plain(spark, rows, fanout, k)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_few_rows(spark, n):
    manifest_is_plain(spark, [(i, "Ab", "en", "s", 2) for i in range(n)], 8, 1)


def test_manifest_finds_each_tampered_leaf(spark):
    rows = queries.QUERIES["op11_merkle_manifest"](spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text[r["doc_id"]] or "")
        assert r["verified"] is (not changed)


# --- clusters ------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    """Every vector against every centroid, in Python's integers."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "", rows[i][1]))
    centroids = [list(rows[i][1]) for i in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        of = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in rows]
        for j in range(len(centroids)) if r < rounds else ():
            mine = [v for (_, v), (_, x) in zip(rows, of, strict=True) if x == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return of, centroids


@pytest.mark.parametrize(("dim", "k", "rounds", "scale"), [(64, 16, 3, 64), (64, 5, 6, 8), (2, 9, 8, 40), (3, 4, 3, 1 << 30)])
def test_clusters_are_the_plain_ones(spark, dim, k, rounds, scale):
    """Groups, ties on a coarse grid, repeated rows and ids, and components held at the most."""
    rnd = np.random.default_rng(dim + k)
    x = np.concatenate([rnd.normal(size=(12, dim)) / 4 + rnd.normal(size=dim) for _ in range(12)] + [np.zeros((3, dim)), np.ones((3, dim))]).astype(np.float32)
    rows = [(i if i % 50 else 7, v.tolist()) for i, v in enumerate(x)] + [(None, [0.5] * dim), (None, [0.25] * dim)]
    odd = [(900, None), (901, [1.0] * (dim - 1)), (902, [float("nan")] * dim), (903, [None] * dim), (904, [float("inf")] * dim)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster int").repartition(4)
    held = [(i, [max(-ballkmeans.MOST, min(ballkmeans.MOST, int(np.floor(np.float64(np.float32(c)) * scale)))) for c in v]) for i, v in rows]
    of, centroids = plain_clusters(held, k, rounds)
    own, every = defaultdict(int), sum(d for d, _ in of)
    for d, j in of:
        own[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, j, d, own[j], every, name[j]) for (i, _), (d, j) in zip(held, of, strict=True)]
    order = lambda r: tuple((v is not None, v) for v in r)
    got = ballkmeans.clusters(ballkmeans.integer_vectors(df, scale, dim), k, rounds).collect()
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_clusters_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["distance"]) for r in ballkmeans.clusters(ballkmeans.integer_vectors(df)).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert ballkmeans.clusters(ballkmeans.integer_vectors(df.limit(0))).count() == 0


def test_balls_leave_out_most_comparisons():
    """Of well-separated groups hardly any member is compared with another centroid, and none that could move is left out."""
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-4000, 4000, (40, 8))
    v = np.concatenate([c + rnd.integers(-300, 300, (100, 8)) for c in centres])
    before = centres + rnd.integers(-100, 100, (40, 8))
    d = ballkmeans.squared(v, before)
    cluster, widest = d.argmin(1), np.full(40, -1, np.int64)
    np.maximum.at(widest, cluster, d.min(1))
    balls, seen, real = ballkmeans.Balls.of(centres, before, widest), [], ballkmeans.squared
    try:
        ballkmeans.squared = lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
        to, best = balls.assign(v, cluster, d.min(1))
    finally:
        ballkmeans.squared = real
    d = ballkmeans.squared(v, centres)
    assert (to == d.argmin(1)).all() and (best == d.min(1)).all() and sum(seen) < 0.1 * d.size


# --- near-duplicates of vectors ------------------------------------------------------------------


def plain_links(rows, t=0.98):
    fit = [i for i, (k, label, v) in enumerate(rows) if k is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, by, root = defaultdict(set), defaultdict(list), {}
    for i in fit:
        by[rows[i][1], len(rows[i][2])].append(i)
    for own in by.values():
        x = np.array([rows[i][2] for i in own], float)
        x /= np.abs(x).max(1, keepdims=True)
        for a, i in enumerate(own):
            s = (x * x[a]).sum(1) / np.sqrt((x * x).sum(1) * (x[a] * x[a]).sum())
            links[i] = {own[b] for b in np.flatnonzero(s >= t) if b != a}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, own in links.items():
        for j in own:
            x, y = sorted((find(rows[i][0]), find(rows[j][0])))
            root[y] = x
    return [(k, len(links[i]), None if k is None else find(k), k is None or find(k) == k) for i, (k, _, _) in enumerate(rows)]


@pytest.mark.parametrize(("dim", "n", "spread", "cell"), [(64, 600, 0.1, 4 << 20), (64, 600, 0.14, 20 << 10), (3, 400, 0.1, 4 << 10), (2, 300, 0.1, 1 << 10)])
def test_links_of_vectors_are_all_found(spark, monkeypatch, dim, n, spread, cell):
    """Near copies, a large group of them, many exact copies, other lengths of one direction, ids that come twice, and rows
    that link with nothing; with small cells the balls are split and visited in turns."""
    monkeypatch.setattr(metricjoin, "CELL_BYTES", cell)
    monkeypatch.setattr(metricjoin, "VISITORS", 2)
    rnd, rows = np.random.default_rng(5), []
    add = lambda label, v: rows.append((len(rows), label, [float(x) for x in v]))
    for _ in range(n):
        add(int(rnd.integers(3)), rnd.normal(size=dim))
    for _ in range(n // 20):
        base, label = rnd.normal(size=dim), int(rnd.integers(3))
        for _ in range(int(rnd.integers(2, 6))):
            add(label, (base / np.linalg.norm(base) + rnd.normal(size=dim) * rnd.choice([0.05, 0.1, 0.14]) / np.sqrt(dim)) * rnd.uniform(0.1, 9))
    base = rnd.normal(size=dim)
    for _ in range(n // 2):
        add(1, base / np.linalg.norm(base) + rnd.normal(size=dim) * spread / np.sqrt(dim))
    for _ in range(n // 4):
        add(2, base)
    one = [1.0] * dim
    rows += [(None, 1, one), (9000, None, one), (9001, 1, None), (9002, 1, [float("nan")] * dim), (9003, 1, [0.0] * dim), (9004, 1, [None] * dim), (9005, 1, [1e200] * dim), (9006, 1, [1e-200] * dim)]
    rows += [(9007, 1, [1.0] * 5), (9008, 1, []), (3, 1, one), (3, 1, one), (5, 0, rows[4][2]), (9009, 1, [float("-inf")] * dim)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, n_links int").repartition(5)
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, metricjoin.near_duplicates(df).collect()), key=order) == sorted(plain_links(rows), key=order)


def test_no_vectors_and_labels_without_pivots(spark, monkeypatch):
    monkeypatch.setattr(metricjoin, "PIVOT_BYTES", 0)
    monkeypatch.setattr(metricjoin, "CELL_BYTES", 2000)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(30, 8))
    rows = [(i, f"l{i % 2}", [float(x) for x in base[i % 30] + rnd.normal(size=8) / 50]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, metricjoin.near_duplicates(df).collect())) == sorted(plain_links(rows))
    assert metricjoin.near_duplicates(df.limit(0)).count() == 0


def test_pivots_keep_pairs_apart():
    """A large part of all pairs of random vectors is never compared, and a group of near copies is settled by its core."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(2000, 8))
    x[:700] = x[0] / np.linalg.norm(x[0]) + rnd.normal(size=(700, 8)) * 0.06 / np.sqrt(8)
    eps, u = np.sqrt(0.04), metricjoin.unit(x)
    balls = metricjoin.Balls({0: metricjoin.pivots_of(x[rnd.permutation(2000)[:160]], 40, eps)})
    ball, d = balls.home(0, u, eps)
    for b in range(balls.n):
        if (own := d[ball == b]).size:
            balls.count[b], balls.outer[b], balls.inner[b] = len(own), own.max(), own.min()
    visit, within = balls.meets(0, u, ball, d, eps)
    compared = (visit @ balls.count).sum() + sum(n * (n - 1) // 2 for n in balls.count[1::2])
    assert balls.count[::2].max() >= 690 and compared < 0.3 * 2000 * 1999 / 2
    s = u @ u.T >= 0.98
    for i in range(0, 2000, 7):  # every link is a core's, within, or visited
        for j in np.flatnonzero(s[i]):
            a, b = sorted((i, int(j)), key=lambda k: ball[k])
            assert ball[a] == ball[b] or visit[a, ball[b]] or within[a, ball[b]]
