"""Every operator and pipeline stage on a table of odd rows: null, negative and repeated ids, null, empty and very
long texts, ties, and columns named like the operators' own; and on empty tables."""

import random

import pytest

import corpus_pipeline as cp
from packetloom.llm import decontaminate, fuzzy_passages, license_scan, line_dedup, ngram_join, packing, quality_rank, quality_rules, shared, suffix_dedup, token_store, tokens

NAMES = "_text _doc _th _drop _n_lines _n_removed _score _gone key keys node th doc part rank n a".split() + ["a.b", "with space"]


def rows():
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))
    long, line = text(150_000), text(30)
    texts = [None, "", " \n\t", long, long + " end", line, line, line + "x", "é " * 400, "\n".join([line] * 50), "word", text(90)]
    out = [(i - 4 if i % 5 else None, t) for i, t in enumerate(texts)]
    return out + [out[3], out[6], (-100, texts[11])]


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *range(len(NAMES))) for i, t in rows()], kind).repartition(3).persist()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(-3, 1, 0), (-3, 1, 0), (None, 1, 0), (7, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(None, rows()[5][1]), (-1, None), (-2, "")], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder


def model(spark, docs, folder):
    return quality_rank.train(docs, spark.read.parquet(folder + "/labels.parquet"))


def test_rows_of_all_documents(spark, docs, tables):
    n = len(rows())
    assert packing.best_fit(docs).where("piece = 0").count() == n
    assert quality_rules.ledger(docs).count() == n
    assert quality_rank.score(docs, model(spark, docs, tables)).count() == n
    assert token_store.digest(shared.stage(token_store.images(docs, tokens.vocabulary()))).count() == n
    assert suffix_dedup.dedup(docs).count() == n
    joined = ngram_join.join(docs, 3, 90, 100)
    assert joined.count() == n and {r.n_shingles for r in joined.where("doc_id is null").collect()} >= {0}
    out = line_dedup.dedup(docs)
    assert out.count() == n and out.columns[: len(docs.columns)] == docs.columns


def test_searches(spark, docs, tables):
    bench = spark.read.parquet(tables + "/benchmark.parquet")
    found = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()}
    own = {i for i, t in rows() if t and rows()[5][1] in t}
    assert {d for d, _ in found} >= own and {i for _, i in found} == {None}
    # the long text of -1 and its longer copy; ties go to the earliest
    passages = fuzzy_passages.passages(docs).collect()
    assert any(x.doc_id == 0 and x.ref_doc_id == -1 and x.last_word - x.first_word >= 150_000 for x in passages)
    assert license_scan.scan(docs).count() == 0


def test_stages(spark, docs, tables):
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tables)
        if name != "best-fit packing":
            assert out.columns == docs.columns and out.count() <= len(rows())
            assert all(r["with space"] == len(NAMES) - 1 and r["a.b"] == len(NAMES) - 2 for r in out.collect())
        else:
            assert out.where("piece = 0").count() == len(rows())


def test_empty(spark, docs, tables):
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, tables).count() == 0
    for f in (suffix_dedup.dedup, fuzzy_passages.passages, license_scan.scan, quality_rules.ledger):
        assert f(none).count() == 0


def test_empty_corpus_runs(spark, docs, tables, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
