import random
import re

import numpy as np

from packetloom.llm import license_scan as ls


def brute(docs, templates, share=0.8):
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = cut(t)
        for name, x in templates:
            x = cut(x)
            if not x:
                continue
            k = min(5, len(x))
            own = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            step, best = -(-len(x) // 2), 0
            for s in range(0, len(w), step):
                part = w[s : s + 2 * len(x)]
                best = max(best, len(own & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) / len(own))
            if best >= share:
                out[d, name] = round(best, 6)
    return out


def test_scan(spark):
    r = random.Random(3)
    vocab = ["word%d" % i for i in range(200)] + ["license", "under", "the", "this"]
    docs = []
    for i in range(150):
        w = [r.choice(vocab) for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            x = r.choice(ls.TEMPLATES)[1].split()
            if r.random() < 0.4:
                x[r.randrange(len(x))] = r.choice(vocab)
            p = r.randrange(len(w) + 1)
            w[p:p] = x
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    docs += [(500, None), (501, ""), (None, ls.TEMPLATES[0][1])]
    templates = [*ls.TEMPLATES, ("short", "public domain"), ("none", ""), ("null", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, template int").repartition(2)
    got = {(x.doc_id, x.template): x.containment for x in ls.scan(df, templates).collect()}
    want = brute(docs, templates)
    assert got == want and len(want) > 80
    assert ls.scan(df.limit(0)).count() == 0 and ls.scan(df, []).count() == 0


def test_short_forms_and_later_paragraphs(spark):
    docs = [(1, "Some text.\nLicensed under CC BY-NC 4.0.\nMore text."), (2, "licensed under CC BY 4.0"), (3, "Licensed under CC BY-NC-SA 4.0"), (4, "one two three. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. four")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x.doc_id, x.template) for x in ls.scan(df).collect()} == {(1, "CC-BY-NC-4.0-short"), (2, "CC-BY-4.0-short"), (3, "CC-BY-NC-SA-4.0-short"), (4, "MIT-text-2")}


def test_short_templates_are_never_missed(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    # at the start of a text, where one window holds it
    df = spark.createDataFrame([(i, " ".join(["Released under the MIT License", *(word() for _ in range(30))])) for i in range(300)], "doc_id long, text string")
    assert {x.doc_id for x in ls.scan(df).collect()} == set(range(300))


def test_bands_keep_their_promise():
    # windows at the lowest similarity that counts: share retrieved, over templates of all sizes
    rng = np.random.default_rng(6)
    for size in (3, 5, 6, 8, 12, 30, 90, 250):
        k = min(size, ls.K)
        words = [f"t{size}w{i}" for i in range(size)]
        t = ls.Templates(["x"], [" ".join(words)])
        own = t.grams[0]
        j = ls.lowest_jaccard(size, len(own), k)
        rows = ls.band_rows(j)
        assert (1 - j**rows) ** (ls.HASHES // rows) <= ls.MISS and rows == min(t.buckets[size])
        held, wide = int(np.ceil(0.8 * len(own) - 1e-9)), 2 * size - k + 1
        found = sum(bool(t.retrieve(np.concatenate([rng.choice(own, held, replace=False), rng.integers(0, 1 << 63, wide - held, dtype=np.uint64)]), size)) for _ in range(300))
        assert found == 300


def test_only_retrieved_templates_are_reported(monkeypatch):
    # the bands decide what is verified
    t = ls.Templates(["x"], ["one two three four five six seven"])
    g = t.grams[0]
    assert [x[0] for x in t.scan(g, 5, np.arange(len(g)))] == [0]
    monkeypatch.setattr(t, "retrieve", lambda g, size: set())
    assert list(t.scan(g, 5, np.arange(len(g)))) == []


def test_whole_texts(spark):
    from packetloom.llm import license_texts

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs = []
    for i, (_, text) in enumerate(license_texts.WHOLE):
        w = text.split()
        for _ in range(len(w) // 60):  # a few words differ
            w[r.randrange(len(w))] = word()
        docs.append((i, " ".join([*(word() for _ in range(r.randrange(400))), *w, *(word() for _ in range(100))])))
    docs.append((-1, " ".join(word() for _ in range(300_000))))  # a very long one without any
    docs.append((-2, docs[0][1] + " " + "x " * 1000 + docs[0][1]))  # a tie: the first place holds
    got = {(x.doc_id, x.template): x.first_word for x in ls.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_texts.WHOLE).collect()}
    assert {(i, name) for i, (name, _) in enumerate(license_texts.WHOLE)} <= set(got)
    assert got[-2, "MIT-whole"] == got[0, "MIT-whole"] and all(d != -1 for d, _ in got)
