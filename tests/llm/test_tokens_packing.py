import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import packing, shared, token_store, tokens

TEXTS = ["", None, "It's a <|endoftext|> test, isn't it? 10,000", "word " * 9000, "a\x1cb\x85c É! ≠", "same", "same", "\n\n", "0 00 x0y"]


@pytest.fixture
def parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(TEXTS)] + [(6, "same", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)


def expected(text):
    lib = tokens.encoder(tokens.vocabulary()).lib
    return np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 70000, 1 << 32):
            ids = np.minimum(rng.zipf(1.3, n), top - 1).astype(np.uint32)
            raw, index = token_store.encode_blocks(ids)
            assert (token_store.decode_blocks(np.frombuffer(raw, np.uint8), index)[:n] == ids).all()
    image = token_store.write_image(np.array([4, 7]), ids, np.array([0, 300, 5000]))
    assert (token_store.read_document(image, 1) == ids[300:]).all()


def test_store(spark, docs):
    stored = shared.stage(token_store.images(docs, tokens.vocabulary()))
    got = sorted(map(tuple, token_store.digest(stored).collect()), key=lambda r: r[1])
    rows = sorted(((r[0], r[1]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (doc_id, text), g in zip(rows, got, strict=True):
        ids = expected(text)
        assert g == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pack(spark, docs):
    got = packing.best_fit(docs).collect()
    assert len(got) == len(TEXTS) + 1 + len(expected(TEXTS[3])) // 4096
    by = {}
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "same"
        ids = expected(text)[r.start : r.start + r.length]
        assert r.start == r.piece * 4096 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs in by.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 4096


def test_rounds_are_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for capacity in (10, 64, 257):
        lengths = sorted(rng.integers(1, capacity + 1, 400).tolist(), reverse=True)
        counts = {x: lengths.count(x) for x in set(lengths)}
        table = packing.rounds(counts, capacity)
        fill = {}
        for length, _, n, first, per, offset in table.tolist():
            for k in range(n):
                fill.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert sum(len(x) for x in fill.values()) == 400
        for runs in fill.values():
            at = 0
            for offset, length in sorted(runs):
                assert offset == at
                at += length
            assert at <= capacity
        bins = []
        for x in lengths:
            fits = [i for i, g in enumerate(bins) if g >= x]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= x
            else:
                bins.append(capacity - x)
        assert len(bins) == len(fill)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.best_fit(none).count() == 0
    assert token_store.digest(shared.stage(token_store.images(none, tokens.vocabulary()))).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_a_polynomial_cant_tell_apart(spark):
    # equal hashes modulo 2**64 for every base: ids, and lines, must not be mistaken for each other
    from packetloom.llm import ngram_join, quality_rules

    for n in (1024, 2048, 4096):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        df = spark.createDataFrame([(1, x), (2, y), (3, x + "\n" + y + "\n" + x)], "doc_id long, text string").coalesce(1)
        lib = tokens.encoder(tokens.vocabulary()).lib
        want = {i: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ((1, x), (2, y))}
        got = {r.doc_id: r.ids_crc32 for r in token_store.digest(shared.stage(token_store.images(df, tokens.vocabulary()))).collect()}
        assert {i: got[i] for i in want} == want
        packed = {r.doc_id: r.ids_crc32 for r in packing.best_fit(df).collect() if r.doc_id < 3}
        assert packed == want
        assert {r.doc_id: r.n_dup_lines for r in quality_rules.ledger(df).collect()} == {1: 0, 2: 0, 3: 1}
        assert {r.doc_id: r.component_id for r in ngram_join.join(df, 3, 9, 10).collect()} == {1: 1, 2: 2, 3: 3}


def test_ranks_of_a_hot_length(spark, parts):
    # most pieces have one length; their ranks are dealt over several parts and leave no holes
    rows = [(i, "" if i % 3 else "word " * (i % 50)) for i in range(3000)] + [(-i, None) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cut = shared.stage(packing.pieces(df, tokens.vocabulary()))
    placed = shared.stage(packing.ranked(cut))
    hot = placed.where("length = 1").groupBy("part").count().collect()
    assert len(hot) > 1
    got = packing.pack(placed).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == len(rows) and len(by) == -(-sum(r.length for r in got) // 4096)
    for runs in by.values():
        assert [o for o, _ in sorted(runs)] == list(np.cumsum([0, *(n for _, n in sorted(runs))])[:-1])


def test_equal_ids_are_dealt_out(spark, parts):
    rows = [(None, "text %d" % i) for i in range(400)] + [(-7, "x"), (-7, "y"), (5, "z")]
    stored = shared.stage(token_store.images(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokens.vocabulary()))
    assert stored.select("part").distinct().count() > 1
    got = token_store.digest(stored).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 400 + [-7, -7, 5]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_files(spark, docs, tmp_path):
    stored = shared.stage(token_store.images(docs, tokens.vocabulary()))
    assert token_store.export_files(stored, str(tmp_path)) == stored.count()
    ids = [i for f in sorted(tmp_path.iterdir()) for i in token_store.read_image(f.read_bytes())[0].tolist()]
    assert ids == [r.doc_id if r.doc_id is not None else token_store.NO_ID for r in token_store.digest(stored).orderBy("start").collect()]
