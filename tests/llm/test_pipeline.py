import random

import corpus_pipeline as cp
from test_decontaminate import brute as leaks
from test_line_dedup import brute as dedup
from test_ngram_join import brute as links

from packetloom.llm import tokens


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    line = lambda n=18: " ".join(word() for _ in range(n))
    items = [(i, line(25)) for i in range(6)]
    boiler = line()
    docs = []
    for i in range(220):
        lines = [line() for _ in range(r.randrange(3, 7))]
        if i % 9 == 2:
            lines = [x for x in docs[-1][1].split("\n")]
            lines = [x + " " + word() for x in lines] if i % 2 else lines
        if i % 10 == 5:
            lines = ["$$$ " + " ### ".join(x.split()) for x in lines]
        if i % 13 == 4:
            lines.insert(1, r.choice(items)[1])
        if i % 6 == 1:
            lines.append(boiler)
        docs.append((i, "\n".join(lines)))
    docs += [(300, None), (301, "")]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(sf + "/documents.parquet")
    spark.createDataFrame([(i, int("$$$" not in t), 0) for i, t in docs[:220] if i % 3], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(sf + "/benchmark.parquet")

    now = spark.read.parquet(sf + "/documents.parquet")
    columns = now.columns
    by = {}
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, sf).persist()
        assert now.columns == columns
        by[name] = sorted((x.doc_id, x.text, x.n_chars) for x in now.collect())
    first = [(i, t) for i, t, _ in by["quality classifier"]]
    kept = {i for i, _ in first}
    assert kept <= {i for i, _ in docs} and all((i in kept) == ("$$$" not in t) for i, t in docs[:220])
    left = dedup(first, 20)
    want = [(i, t, len(t or "")) for (i, before), t in zip(first, left) if t == before or (t or "").strip()]
    assert by["line dedup"] == want
    comp = {a: c for a, _, c, _ in links([x[:2] for x in want], 5, 8, 10)}
    want = [x for x in want if comp[x[0]] == x[0]]
    assert by["n-gram Jaccard join"] == want
    bad = {d for d, _ in leaks([x[:2] for x in want], items)}
    want = [x for x in want if x[0] not in bad]
    assert by["benchmark decontamination"] == want and bad
    lib = tokens.encoder(tokens.vocabulary()).lib
    got = {}
    for x in cp.run(spark, sf).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in want}
