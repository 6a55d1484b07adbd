import collections
import re
import zlib

import numpy as np

from packetloom.llm import quality_rank as qr, quality_rules as rules

TEXTS = ["", None, " \n \t", "a b c a b c\na b c a b c\n\n x|y <z> #é É", "one two three " * 40, "\n".join(["line one here"] * 5), "ABC DEF! " * 60, "a\x1cb\x85c\xa0d e", "aaa " * 60, "w1 w2 w3 w4\r\nw1 w2 w3\x0bq"]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(lines), len(re.findall("[A-Z]", t))


def test_measure(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "x y z", 0)], "doc_id long, text string, n_words int").coalesce(1)
    got = {r.doc_id: tuple(r[m] for m in rules.MEASURES) for r in rules.ledger(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)} | {None: brute("x y z")}
    assert rules.ledger(df.limit(0)).count() == 0


def test_policies(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    led = rules.ledger(df).persist()
    bits = [r.fail_bits for r in led.collect()]
    for policy in rules.POLICIES:
        m = rules.mask(policy)
        assert led.where(rules.passes(policy)).count() == sum(not b & m for b in bits)
        for r in rules.ablation(led, policy).collect():
            bit = next(1 << b for b, name, _ in rules.RULES if name == r.rule)
            assert (r.failed, r.alone, r.kept_without) == (sum(bool(b & bit) for b in bits), sum(b & m == bit for b in bits), sum(not b & m & ~bit for b in bits))


def test_rank(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows, marks = [], []
    for i in range(400):
        good = bool(i % 5)
        n = int(rng.integers(20, 150))
        rows.append((i, " ".join(word() + ("" if good else "$$%") for _ in range(n)) + "."))
        if i % 4:
            marks.append((i, int(good), 0))
    rows += [(1000, ""), (1001, None), (None, "abc")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = qr.train(docs, labels)
    got = {r.doc_id: r.score for r in qr.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == bool(i % 5) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    none = qr.train(docs, labels.limit(0))
    assert {r.score for r in qr.score(docs, none).collect()} == {0.5}
    assert qr.score(docs.limit(0), model).count() == 0


def test_fit_against_plain_python():
    """The same preferences and steps, one pair at a time."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 3)).astype(np.float32)
    good = x[:, 0] + 0.3 * rng.normal(size=40) > 0
    pairs, steps, ridge = 300, 40, 1e-3
    got = qr.fit(x, good, pairs, steps, ridge, seed=5)
    mean, sd = x.mean(0), x.std(0)
    z = [[float(np.clip((v - m) / s, -8, 8)) for v, m, s in zip(row, mean, sd)] for row in x]
    draw = np.random.default_rng(5)
    i, j = draw.choice(np.flatnonzero(good), pairs).tolist(), draw.choice(np.flatnonzero(~good), pairs).tolist()
    rate = 4.0 / max(1.0, sum(v * v for row in z for v in row) / len(z))
    w, v = [0.0] * 3, [0.0] * 3
    for step in range(steps):
        pull = [0.0] * 3
        for a, b in zip(i, j):
            gap = sum(c * (p - q) for c, p, q in zip(v, z[a], z[b]))
            miss = 1 / (1 + np.exp(gap))
            pull = [u + miss * (p - q) for u, p, q in zip(pull, z[a], z[b])]
        new = [c + rate * (u / pairs - ridge * c) for c, u in zip(v, pull)]
        v, w = [n + step / (step + 3) * (n - o) for n, o in zip(new, w)], new
    assert np.allclose(got["w"], w, rtol=2e-3, atol=2e-3)
    s = [sum(c * p for c, p in zip(got["w"], row)) for row in z]
    errors = lambda cut: sum(y < cut for y, g in zip(s, good) if g) / good.sum() + sum(y >= cut for y, g in zip(s, good) if not g) / (~good).sum()
    assert errors(got["cut"]) <= min(errors(c) for c in s) + 1e-9
    assert np.allclose([qr.predict(got, x[k : k + 1])[0] >= 0.5 for k in range(40)], [y >= got["cut"] for y in s])


def test_repeated_rows_long_texts_and_clashing_names(spark):
    long = "A word, and another. " * 60_000
    docs = spark.createDataFrame([(-1, long, 1, 2), (-1, long, 1, 2), (3, "x", 3, 4)], "doc_id long, text string, _text int, _score int")
    model = qr.train(docs, spark.createDataFrame([(-1, 1), (3, 0)], "doc_id long, quality int"))
    kept = qr.score(docs, model, keep="mark")
    assert kept.columns == [*docs.columns, "mark"] and sorted(tuple(r)[2:4] for r in kept.collect()) == [(1, 2), (1, 2), (3, 4)]
    led = rules.ledger(docs).collect()
    assert sorted(r.n_words for r in led) == [1, 240_000, 240_000]
