import random

import numpy as np

from packetloom.llm import fuzzy_passages as fp


def brute_chain(x, y, k=fp.K, gap=fp.GAP):
    order = np.lexsort((y, x))
    score = {}
    for i in order:
        score[i] = k + max([0, *(score[j] - gap * (x[i] - x[j] + y[i] - y[j]) for j in score if x[j] < x[i] and y[j] < y[i])])
    return max(score.values())


def test_chains_are_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        x, y = rng.integers(0, 80, n), rng.integers(0, 80, n)
        if len(set((x - y).tolist())) == 1:
            continue
        got = fp.chains(x, y)
        assert sorted(i for c in got for i in c.tolist()) == list(range(n))
        c = got[0]
        assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()
        value = fp.K * len(c) - fp.GAP * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
        assert abs(value - brute_chain(x, y)) < 1e-9


def test_align():
    rng = np.random.default_rng(1)

    def brute(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    for _ in range(30):
        a, b = rng.integers(0, 4, 30), rng.integers(0, 4, 25)
        i, j, k, m, same, length = fp.align(a, b)
        assert same - (length - same) == brute(a, b)
        assert length >= max(j - i, m - k)


def test_passages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    shared, fuzzy, short = text(80), text(120), text(30)
    docs, want = [], set()
    for i in range(40):
        w = text(r.randrange(50, 200))
        p = r.randrange(len(w))
        if i % 4 == 1:
            w[p:p] = shared
            want.add((i, 1))
        elif i % 4 == 2:
            x = list(fuzzy)
            if i > 2:
                for at in (20, 45, 90):
                    x[at] = word()
                del x[60]
                x.insert(75, word())
            w[p:p] = x
            want.add((i, 2))
        elif i % 4 == 3:
            w[p:p] = short
        docs.append((i, " ".join(w).upper() if i % 8 == 1 else ", ".join(w)))
    want -= {(1, 1), (2, 2)}
    docs += [(100, docs[0][1]), (101, None), (102, ""), (103, "x y"), (103, "x y")]
    want.add((100, 0))
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, ref int").repartition(3)
    rows = fp.passages(df).collect()
    got = {(x.doc_id, x.ref_doc_id) for x in rows}
    # the edited copies also share what 6, the first of them, has around the deleted word
    assert got >= want and {p for p in got - want if not (p[1] == 6 and p[0] % 4 == 2)} == set()
    for x in rows:
        low = 80 if x.ref_doc_id == 1 else 110 if x.ref_doc_id == 2 else 50
        assert x.last_word - x.first_word >= low and x.identity >= 0.9
    assert fp.passages(df.limit(0)).count() == 0


def test_null_ids(spark):
    text = " ".join("word%d" % i for i in range(90))
    df = spark.createDataFrame([(None, text), (5, text + " more"), (5, text + " other")], "doc_id long, text string")
    assert sorted((x.doc_id, x.ref_doc_id, x.last_word) for x in fp.passages(df).collect()) == [(5, None, 90), (5, None, 90)]


def test_patience():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a = rng.integers(0, 1 << 40, 150)
        b = a.copy()
        b[rng.integers(0, 150, 6)] = 7
        b = np.insert(np.delete(b, rng.integers(10, 140, 3)), rng.integers(10, 140, 3), 9)
        x = np.concatenate([rng.integers(0, 99, 20), a, rng.integers(0, 99, 10)])
        y = np.concatenate([rng.integers(100, 199, 5), b, rng.integers(100, 199, 30)])
        got, best = fp.patience(x, y), fp.align(x, y)
        assert got[4] >= best[4] - 9 and abs(got[0] - best[0]) <= 9 and abs(got[1] - best[1]) <= 9
    assert fp.ascending(np.array([3, 1, 2, 9, 4, 5, 0])).tolist() == [1, 2, 4, 5]
    assert fp.patience(x[:5], y[:5]) is None


def test_split_references(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    docs, want = [], set()
    for i in range(0, 400, 10):
        p = text(95)
        # the first half, the second half, and the whole in two documents
        docs += [(i + 1, text(40) + p[:47] + text(40)), (i + 2, text(40) + p[47:] + text(40)), (i + 3, text(30) + p + text(30)), (i + 4, text(50) + p + text(20))]
        want.add((i + 4, i + 3))
    line = text(70)
    docs += [(900, text(30) + line), (901, text(20) + line + text(30) + line + text(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    rows = fp.passages(df).collect()
    assert {(x.doc_id, x.ref_doc_id) for x in rows} >= want
    assert {x.first_word for x in rows if x.doc_id == 901} == {20, 120}  # both copies
    assert all(x.last_word - x.first_word >= 50 for x in rows)


def test_many_copies_of_a_line_are_chained_at_once():
    x = np.arange(20000)
    got = fp.chains(x, x % 10)
    assert len(got) == 2000 and sorted(i for c in got for i in c.tolist()) == x.tolist()


def test_all_passages_of_a_chain():
    rng = np.random.default_rng(3)
    word = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    for gap in (25, 40, 80):
        p, q = word(60), word(60)
        a, b = np.concatenate([p, word(gap), q]), np.concatenate([p, word(gap), q])
        for shift in (0, None):
            assert sorted(x[:4] for x in fp.all_passages(a, b, shift, 50, 0.8)) == [(0, 60, 0, 60), (60 + gap, 120 + gap, 60 + gap, 120 + gap)]
        c = np.concatenate([p, word(gap + 7), q])
        assert sorted(x[:2] for x in fp.all_passages(a, c, None, 50, 0.8)) == [(0, 60), (60 + gap, 120 + gap)]
    for _ in range(300):  # no run of the identity is left where none is found
        m = rng.random(90) < rng.uniform(0.6, 0.95)
        total = np.concatenate([[0], np.cumsum(m)])
        able = any(total[j] - total[i] >= 0.8 * (j - i) for i in range(91) for j in range(i + 50, 91))
        got = fp.good_runs(m, 50, 0.8)
        assert bool(got) == able and all(j - i >= 50 and m[i:j].sum() >= 0.8 * (j - i) - 1e-9 for i, j in got)


def test_chains_of_any_size_are_verified():
    rng = np.random.default_rng(4)
    few = lambda n: rng.integers(0, 40, n).astype(np.uint64)
    a, b = few(1400), few(1900)
    b[900:1200] = a[700:1000]
    assert len(a) * len(b) > fp.CELLS
    for shift in (None, -200):
        got = list(fp.all_passages(np.delete(a, 850) if shift is None else a, b, shift, 50, 0.8))
        assert any(x[0] <= 705 and x[1] >= 990 and abs(x[2] - x[0] - 200) < 3 for x in got)
    # what lies far apart in the earlier document alone is cut as well
    x = np.arange(0, 900, 10)
    y = np.where(x < 450, x, x + 700)
    parts = fp._parts(np.arange(len(x)), x, y)
    assert sum(map(len, parts)) == len(x) and all(np.ptp(y[p]) <= fp.PART and np.ptp(x[p]) <= fp.PART for p in parts)


def test_halves_that_occurred_before(spark):
    r = random.Random(31)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs, want = [], set()
    for i in range(-100, 100, 10):  # ids may be negative
        p = text(60)
        docs += [(i + 1, text(40) + p[:30] + text(40)), (i + 2, text(40) + p[30:] + text(40)), (i + 3, text(30) + p + text(30)), (i + 4, text(50) + p + text(20))]
        want.add((i + 4, i + 3))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    assert {(x.doc_id, x.ref_doc_id) for x in fp.passages(df).collect()} == want


def test_words_covered_against_brute_force(spark):
    """All words within 50 that an earlier document has too, from a pool of passages cut anywhere."""
    r = random.Random(101)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    pool = [text(r.randrange(50, 140)) for _ in range(25)]
    docs = []
    for i in range(300):
        w = text(r.randrange(60))
        for _ in range(r.randrange(1, 4)):
            p = r.choice(pool)
            a = r.randrange(0, max(1, len(p) - 50))
            w += p[a : r.choice((len(p), r.randrange(min(a + 20, len(p)), len(p) + 1)))] + text(r.randrange(40))
        docs.append((i, w))
    seen, want = {}, {}
    for d, w in docs:
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        want[d] = {j for i, g in enumerate(runs) if seen.get(g, d) != d for j in range(i, i + 50)}
        for g in runs:
            seen.setdefault(g, d)
    got = {d: set() for d, _ in docs}
    for x in fp.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)).collect():
        got[x.doc_id].update(range(x.first_word, x.last_word))
    total = sum(map(len, want.values()))
    assert sum(len(want[d] & got[d]) for d in want) > 0.95 * total > 0
    # what else is covered stands beside it, in a passage of the identity
    assert sum(len(got[d] - want[d]) for d in want) < 0.05 * total


def test_fuzzy_share(spark):
    r = random.Random(7)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    for i in range(100):
        p = text(80)
        q = list(p)
        for at in r.sample(range(1, 79), 8):
            q[at] = text(1)[0]
        docs += [(2 * i, text(30) + p + text(30)), (2 * i + 1, text(30) + q + text(30))]
    rows = fp.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert len({x.doc_id for x in rows}) >= 95 and all(x.ref_doc_id == x.doc_id - 1 for x in rows)


def test_hot_keys_are_streamed():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted((int(rng.choice([1, 1, 1, 1, 2, 3, 4, 5])), int(rng.integers(0, 30)) if rng.random() < 0.9 else 0, 0, int(rng.integers(0, 4))) for _ in range(600))
    rows += [(9, 4, 0, p) for p in range(20)]  # of one document only
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = sorted({(*r, *by[r[0]][0][1:]) for r in rows if len({x[1] for x in by[r[0]]}) > 1})
    names = ["seed", *fp.AT]
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names) for i in range(0, len(rows), size)]
        got = [r for g in fp._earliest(batches, "seed", names) for r in zip(*(g[n].tolist() for n in [*names, *fp.REF]))]
        assert got == want
