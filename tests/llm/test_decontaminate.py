import collections
import math
import random
import re

import numpy as np

from packetloom.llm import decontaminate as dc


def brute(docs, items, threshold=0.8):
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    words = {i: cut(t) for i, t in items}
    n = collections.Counter(g for w in words.values() if w for g in set(grams(w, min(5, len(w)))))
    wt = lambda g: math.log(1 + len(items) / n.get(g, 1))
    out = {}
    for d, t in docs:
        w = cut(t)
        for i, x in words.items():
            if not x or not w:
                continue
            k, size = min(5, len(x)), min(len(x), len(w))
            b, best = collections.Counter(grams(x, k)), 0
            for s in range(len(w) - size + 1):
                a = collections.Counter(grams(w[s : s + size], k))
                both = sum(wt(g) * c for g, c in (a & b).items())
                if both:
                    best = max(best, both / (sum(wt(g) * c for g, c in a.items()) + sum(wt(g) * c for g, c in b.items()) - both))
            if best >= threshold:
                out[d, i] = round(best, 6)
    return out


def test_leaks(spark, monkeypatch):
    r = random.Random(2)
    vocab = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice((12, 20, 20, 40, 70))))) for i in range(12)]
    items += [(20, "Tiny item here"), (21, None), (22, ""), (23, items[0][1])]
    docs = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 200))]
        for _ in range(r.randrange(3)):
            x = r.choice(items[:12])[1].split()
            for _ in range(r.choice((0, 0, 1, 2))):
                x[r.randrange(len(x))] = r.choice(vocab)
            p = r.randrange(len(w) + 1)
            w[p:p] = x
        t = " ".join(w)
        docs.append((i, t.upper().replace(" ", ", ") if i % 7 == 0 else t))
    docs += [(200, None), (201, ""), (202, "a tiny, item HERE"), (203, items[3][1]), (None, items[4][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(2)
    b = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): x.similarity for x in dc.leaks(d, b).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 40
    left = {x.doc_id for x in dc.clean(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}
    assert dc.leaks(d.limit(0), b).count() == 0 and dc.leaks(d, b.limit(0)).count() == 0
    monkeypatch.setattr(dc, "STRIP", 3)
    assert {(x.doc_id, x.item_id): x.similarity for x in dc.leaks(d, b).collect()} == want


def test_multi_index_guarantee():
    import numpy as np

    words = dc.item_words(["a b c d e f g h i j k l %d" % i for i in range(50)])
    weight = collections.defaultdict(lambda: 1.0)
    index = dc.Index(list(range(50)), words, weight, 1.0)
    rng = np.random.default_rng(0)
    for i in range(50):
        bits = np.unpackbits(index.prints[i])
        flip = rng.choice(dc.BITS, dc.RADIUS, replace=False)
        bits[flip] ^= 1
        found = index.candidates(np.packbits(bits)[None], int(index.size[i]))[1]
        assert i in found.tolist()


def test_weights_are_of_the_whole_benchmark(spark, monkeypatch):
    r = random.Random(4)
    vocab = ["w%d" % i for i in range(200)]
    often = [r.choice(vocab) for _ in range(12)]
    items = [(i, " ".join([*often, *(r.choice(vocab) for _ in range(24))]) if i % 2 else " ".join(r.choice(vocab) for _ in range(30))) for i in range(12)]
    docs = []
    for i in range(60):
        x = r.choice(items)[1].split()
        x[r.choice((0, 11, len(x) - 1))] = "changed"
        docs.append((i, " ".join([*(r.choice(vocab) for _ in range(20)), *x])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    want = brute(docs, items)
    assert {(x.doc_id, x.item_id): x.similarity for x in dc.leaks(d, b).collect()} == want and len(want) > 20


def test_rows_without_ids_are_told_apart(spark):
    item = " ".join("w%d" % i for i in range(30))
    docs = spark.createDataFrame([(None, "before " + item, 1), (None, "a clean text of some words", 2), (-3, item.upper(), 3), (-3, "another clean text", 4), (8, None, 5), (9, "", 6)], "doc_id long, text string, _gone int")
    bench = spark.createDataFrame([(None, item), (-1, item), (2, None)], "item_id long, text string")
    assert sorted(r._gone for r in dc.clean(docs, bench).collect()) == [2, 4, 5, 6]
    assert sorted((str(r.doc_id), str(r.item_id), r.first_word) for r in dc.leaks(docs, bench).collect()) == [("-3", "-1", 0), ("-3", "None", 0), ("None", "-1", 1), ("None", "None", 1)]


def test_very_long_texts_and_items(spark):
    r = np.random.default_rng(5)
    item = " ".join("w%d" % i for i in r.integers(0, 10**6, 9000))
    text = " ".join("x%d" % i for i in r.integers(0, 10**6, 150_000))
    docs = spark.createDataFrame([(1, text + " " + item + " " + text), (2, text)], "doc_id long, text string")
    got = dc.leaks(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.first_word, x.similarity) for x in got] == [(1, 4, 150_000, 1.0)]
