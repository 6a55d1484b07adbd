import random

import numpy as np
import pytest

from packetloom.llm import graph, ngram_join as nj


def brute(rows, k, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").translate(fold).encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None) if rows[i][0] is not None or len(seen) > 1 else None, len(near[i])))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice((1, 2, 3, 4, 8, 20, 21, 40, 90, 200)))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = r.choice(vocab)
        t = r.choice((" ", "  ", "\n")).join(w)
        rows.append((i, t.upper() if r.random() < 0.2 else t))
    return rows


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, 512), (5, 8, 10, 7)])
def test_join(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(nj, "BLOCK_SETS", block)
    monkeypatch.setattr(nj, "FRAGMENT_GRAMS", 60)  # many fragments
    rows = corpus(3, 240) + [(500, None), (501, ""), (502, " \t\n"), (503, "a\xa0b É é"), (503, "a\xa0b É é"), (None, "one two three four five six"), (None, "one two three four five six")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keys int").repartition(3)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in nj.join(df, k, num, den).collect()), key=key)
    want = sorted(((a, b, None if a is None else c, d) for a, b, c, d in brute(rows, k, num, den)), key=key)
    assert got == want


def test_large_block(spark):
    r = random.Random(5)
    w = ["v%d" % r.randrange(500) for _ in range(150)]
    rows = []
    for i in range(700):
        x = list(w)
        for _ in range(r.randrange(7)):
            x[r.randrange(150)] = "z%d" % r.randrange(9999)
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.join(df, 3, 90, 100).collect())) == sorted(brute(rows, 3, 90, 100))


def test_cuts_guarantee():
    rng = np.random.default_rng(0)
    for num, den in ((90, 100), (8, 10)):
        cuts = nj.Cuts(num, den)
        for _ in range(400):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a[rng.random(len(a)) > 0.04]
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and den * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(nj.segment_keys(a, cuts), nj.segment_keys(b, cuts)))


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "x"), (None, "x")], "doc_id long, text string")
    assert sorted((r[0] or 0) for r in nj.keep_one(df).collect()) == [1, 3]
    none = df.where("doc_id is null")
    assert nj.keep_one(none.union(none)).count() == 2
    more = spark.createDataFrame([(-4, "x y", 1, 2), (-4, "x y", 1, 2), (-4, "z", 1, 2), (5, "Z", 1, 2)], "doc_id long, text string, _doc int, `_th` int")
    assert sorted(map(tuple, nj.keep_one(more).collect())) == [(-4, "x y", 1, 2), (-4, "x y", 1, 2), (-4, "z", 1, 2)]


def test_negative_ids(spark):
    rows = [(-5, "a b c d e"), (-3, "a b c d e"), (7, "A b c d e"), (-9, "f g"), (None, "f g"), (None, "h i j"), (-1, "h i j k")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in nj.join(df, 3, 90, 100).collect()), key=str)
    assert got == sorted([(-5, -5, 2), (-3, -5, 2), (7, -5, 2), (-9, -9, 1), (None, -9, 1), (None, None, 0), (-1, -1, 0)], key=str)


def test_very_long_sets(spark, monkeypatch):
    # sets of more n-grams than a fragment has, in clusters of several blocks
    monkeypatch.setattr(nj, "FRAGMENT_GRAMS", 500)
    monkeypatch.setattr(nj, "BLOCK_SETS", 3)
    r = random.Random(8)
    w = ["v%d" % r.randrange(10**5) for _ in range(6000)]
    rows = []
    for i in range(8):
        x = list(w)
        for _ in range(r.choice((10, 60, 120))):
            x[r.randrange(6000)] = "z%d" % r.randrange(10**5)
        rows.append((i - 4, " ".join(x)))
    assert sorted(map(tuple, nj.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())) == sorted(brute(rows, 3, 90, 100))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (60, 50), (60, 70), (7, 7), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 50, 50: 50, 60: 50, 70: 50}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert nj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_histograms_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(150):
        pool = np.unique(rng.integers(0, 1 << 64, int(rng.integers(2, 3000)), dtype=np.uint64))
        if rng.random() < 0.5:  # crowded ranges, whose counts are cut off
            pool = np.unique(pool >> np.uint64(int(rng.integers(0, 12))))
        sets = [np.sort(rng.choice(pool, int(rng.integers(1, len(pool) + 1)), replace=False)) for _ in range(5)]
        least = nj.differences([nj.histogram(s) for s in sets])
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert least[i, j] <= len(np.setxor1d(a, b))


def test_shared_passage_does_not_tie(spark, monkeypatch):
    r = random.Random(11)
    passage = ["p%d" % i for i in range(60)]
    rows = []
    for i in range(300):
        w = ["u%d" % r.randrange(10**6) for _ in range(r.randrange(60, 200))]
        rows.append((2 * i, " ".join(w[:30] + passage + w[30:])))
        if i % 5 == 0:
            rows.append((2 * i + 1, rows[-1][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (nj.GROUP, 4):
        monkeypatch.setattr(nj, "GROUP", group)
        assert sorted(map(tuple, nj.join(df, 5, 8, 10).collect())) == sorted(brute(rows, 5, 8, 10))
