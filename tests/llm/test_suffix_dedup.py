import collections
import hashlib
import random

import numpy as np

from packetloom.llm import suffix_dedup as sd


def brute(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone[:-1].sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    parts = [make(n) for n in (100, 150, 199, 200, 201, 230, 260, 300, 400, 700)]
    texts = []
    for i in range(60):
        t = "".join(r.choice(parts) if r.random() < 0.5 else make(r.randrange(150)) for _ in range(r.randrange(1, 6)))
        if r.random() < 0.3:
            p = r.randrange(len(t))
            t = t[:p] + r.choice("xyz") + t[p + 1 :]
        texts.append(t)
    for n in (199, 200, 201, 250):  # one passage at every kind of border
        for _ in range(4):
            cut = r.randrange(0, 400 - n)
            texts.append(make(5) + parts[8][cut : cut + n] + make(7))
    return texts + [None, "", "a" * 199, "ab" * 300, "a" * 1000, texts[3], texts[3], "short", "short", "z" * 450, "yy" + "z" * 250]


def test_dedup(spark):
    texts = corpus(1)
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, first int").repartition(3)
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(df).collect())
    want = sorted(((r[0] or 0), *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    assert got == want
    assert sd.dedup(df.limit(0)).count() == 0


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    s = sd.Suffixes(data, 40)
    at = rng.permutation(2900)
    group = np.sort(rng.integers(0, 9, 2900))
    got = s.merge_sort(at, group)
    for g in range(9):
        own = at[group == g].tolist()
        want = sorted(own, key=lambda i: data[i : i + 40].tobytes())
        assert [data[i : i + 40].tobytes() for i in got[group == g]] == [data[i : i + 40].tobytes() for i in want]
        assert sorted(got[group == g].tolist()) == sorted(own)


def test_collisions_are_verified(monkeypatch):
    # with a constant hash, everything seems equal; only the bytes decide
    monkeypatch.setattr(sd.tb, "prefix_hash", lambda codes: np.zeros(len(codes) + 1, np.uint64))
    first, last = sd.repeats([b"a" * 8 + bytes(range(192)), b"a" * 8 + bytes(range(1, 193))], np.array([0, 0]))
    assert (first > last).all()


def test_many_contexts_of_an_anchor(monkeypatch):
    r = random.Random(7)
    make = lambda n: bytes(r.choice(b"abcd") for _ in range(n))
    anchor, near = make(100), [make(60) for _ in range(6)]
    contexts, off = [], []
    for _ in range(400):
        before, behind = r.choice(near)[r.randrange(30) :] + make(r.randrange(3)), make(r.randrange(3)) + r.choice(near)
        while len(before) + len(behind) < 101:
            before, behind = r.choice(near)[:40] + before, behind + r.choice(near)[:30]
        before, behind = before[-100:], behind[:100]
        contexts.append(before + anchor + behind)
        off.append(len(before))
    contexts, off = map(list, zip(*dict.fromkeys(zip(contexts, off))))  # differing ones, as the operator gives
    want = sd.repeats(contexts, np.array(off))
    monkeypatch.setattr(sd, "MANY", 20)
    got = sd.repeats(contexts, np.array(off))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and (want[1] >= want[0]).sum() > 50


def test_boilerplate_with_other_neighbours(spark):
    # a phrase of 150 bytes in texts that share nothing else, or the bytes on one side of it
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    phrase, side = make(150), make(90)
    texts = [make(r.randrange(300)) + r.choice(("", side)) + phrase + r.choice(("", side[:60])) + make(r.randrange(300)) for _ in range(300)]
    df = spark.createDataFrame([(r.choice((None, i)), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(tuple(x)[1:5] for x in sd.dedup(df).collect()) == sorted(brute(texts))
