"""A quality score learned from preferences: Bradley-Terry by logistic loss on feature differences.

Every pair of a labelled good and a labelled bad document is a preference.  The model is a linear score
s; the probability that document i is preferred to j is 1 / (1 + exp(s_j - s_i)).  A document is
accepted when its score reaches a quantile of the training documents' scores; the quantile is the one
that parts the two labels best.  Scores are given as 1 / (1 + exp(quantile - s)), so 0.5 is the border.

Features are taken from the whole text's bytes alone: how often each pair of neighbouring byte classes
occurs (letters, capitals, digits, single marks, breaks), and shares of repeated words, repeated lines,
symbols and word lengths.  Labels, lang, source and doc_id are no inputs.

At most MAX_LABELLED labelled documents are used to fit (a parameter; those with the smallest hashes of
doc_id); all documents are scored, in one pass without a shuffle.  Nulls: a null text counts as empty
and gets a score like any other; a null doc_id is kept and is not held out; labels that are null count
as none, and of several labels of a doc_id the smallest holds.  Without labels of both kinds all scores
are 0.5.  Repeated rows each get their score; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import quality_rules, shared, textbytes as tb

MAX_LABELLED = 8_000
PAIRS = 60_000
STEPS = 250

CLASS = np.full(256, 2, np.uint8)
CLASS[10], CLASS[32] = 0, 1
CLASS[65:91], CLASS[97:123], CLASS[48:58] = 3, 4, 5
for _number, _marks in enumerate((".", ",", "!", "?", ";:", "'\"`", "-", "()", "[]{}", "<>", "|", "#", "*", "$", "%", "&", "@/\\", "_=+~^"), 6):
    CLASS[list(_marks.encode())] = _number
CLASS[128:192], CLASS[192:] = 24, 25
CLASSES = 26
WIDTH = CLASSES * CLASSES + 7


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """float32 [rows, WIDTH]"""
    rows = len(offs) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    size = np.diff(offs)
    if len(data) > 1:
        c = CLASS[data].astype(np.int64)
        row = np.repeat(np.arange(rows), size)
        inner = row[1:] == row[:-1]
        pair = (row[:-1] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:])[inner]
        out[:, : CLASSES * CLASSES] = np.sqrt(np.bincount(pair, minlength=rows * CLASSES * CLASSES).reshape(rows, -1) / np.maximum(size - 1, 1)[:, None])
    m = {k: v.astype(np.float64) for k, v in quality_rules.measure(data, offs).items()}
    n, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    more = [m["n_repeat_words"] / n, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_symbols"] / chars, m["n_upper"] / chars, np.minimum(chars / n, 40) / 10, np.log1p(m["n_words"]) / 5, np.minimum(n / np.maximum(m["n_lines"], 1), 500) / 100]
    out[:, CLASSES * CLASSES :] = np.stack(more, 1)
    return out


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, ridge: float = 1e-3, seed: int = 7) -> dict:
    """Weights, and the quantile of the scores that parts the labels best."""
    if good.all() or not good.any():
        return {"w": np.zeros(x.shape[1]), "mean": np.zeros(x.shape[1]), "sd": np.ones(x.shape[1]), "cut": 0.0, "quantile": 0.0}
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-4, 1.0, sd)
    z = np.clip((x - mean) / sd, -8, 8).astype(np.float32)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    w, v, look = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 0.0
    rate = 4.0 / max(1.0, float((z**2).sum(1).mean()))
    for step in range(steps):
        s = z @ v
        miss = 1 / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))
        pull = np.bincount(i, miss, len(z)) - np.bincount(j, miss, len(z))
        new = v + rate * ((pull / pairs).astype(np.float32) @ z - ridge * v)
        look = step / (step + 3)
        v, w = new + look * (new - w), new
    s = z @ w
    order = np.sort(s)
    # errors of either kind at every border between two scores, by share of the kind
    bad_below = np.searchsorted(np.sort(s[~good]), order, "left") / (~good).sum()
    good_below = np.searchsorted(np.sort(s[good]), order, "left") / good.sum()
    best = bad_below - good_below
    at = np.flatnonzero(best >= best.max() - 1e-12)
    at = int(at[len(at) // 2])
    cut = float((order[at] + order[max(at - 1, 0)]) / 2)
    return {"w": w.astype(np.float64), "mean": mean.astype(np.float64), "sd": sd.astype(np.float64), "cut": cut, "quantile": at / len(order)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    s = np.clip((x - model["mean"]) / model["sd"], -8, 8) @ model["w"]
    return 1 / (1 + np.exp(np.clip(model["cut"] - s, -30, 30)))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> dict:
    spark = docs.sparkSession
    shared.ship(spark)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).where("doc_id is not null and good is not null").where(~_held_out())
    sample = marked.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # max_labelled rows of 12 bytes at most
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("good", "text")

    def run(batches):
        for batch in batches:
            data, offs = tb.buffers(batch.column(1))
            for i, j in tb.row_slices(offs):
                x = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["good", "x"])

    # repeated doc_ids could give more rows than labels; the limit holds for the rows as well
    rows = chosen.mapInArrow(run, "good int, x binary").limit(max_labelled).collect()
    if not rows:
        return fit(np.zeros((1, WIDTH), np.float32), np.ones(1, bool))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    good = np.array([r["good"] == 1 for r in rows])
    del rows
    order = np.lexsort((*x[:, ::97].T, good))  # the same fit in whatever order the rows come
    return fit(x[order], good[order])


def score(docs: DataFrame, model: dict, keep: str | None = None) -> DataFrame:
    """doc_id and score of every row; with keep, all columns of docs and the score under that name, which
    none of them may have."""
    shared.ship(docs.sparkSession)
    name = keep or "score"
    text = F.col("text").cast("string")
    own = docs.select(text, *shared.columns(docs)) if keep else docs.select(text, F.col("doc_id").cast("long").alias("doc_id"))
    held = own.schema[1:]
    own = own.toDF(*(f"c{i}" for i in range(len(own.columns))))  # whatever their names
    kind = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(held, 1)), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, offs = tb.buffers(batch.column(0))
            got = [predict(model, features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in tb.row_slices(offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(got) if got else np.empty(0))], kind.fieldNames())

    return own.mapInArrow(run, kind).toDF(*(f.name for f in held), name)


def op3_quality_classifier(spark, sf_dir) -> DataFrame:
    docs, labels = shared.documents(spark, sf_dir), shared.documents(spark, sf_dir, "labels")
    got = score(docs, train(docs, labels))
    return got.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
