"""Dictionaries, sampling, splits, normalisation, metrics and sequence operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def dictionary(df: DataFrame, label: str, mode: str = "sorted", order: str | None = None, fixed: tuple[str, ...] = ()) -> DataFrame:
    """(label, id): ids by first appearance (`order`), by sorted label, or by a fixed order among those
    that appear.  One row for each distinct label, so the final numbering is over a small table."""
    if mode == "fixed":
        places = df.sparkSession.createDataFrame(list(zip(fixed, range(len(fixed)))), f"{label} string, _at int")
        seen = places.join(df.select(label).distinct(), label, "left_semi")
    elif mode == "first":
        seen = df.groupBy(label).agg(F.min(order).alias("_at"))
    else:
        seen = df.select(label).distinct().withColumn("_at", F.col(label))
    return seen.withColumn("id", F.row_number().over(Window.orderBy("_at", label)) - 1).drop("_at")


def _hash_order(seed: int, key: str) -> tuple[Column, Column]:
    """(md5 of seed and key, which orders the keys; its first three digits, one of 4096 parts of that order)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return order, F.substring(order, 1, 3)


def hash_rank(df: DataFrame, key: str, seed: int, by: list[str] = ()) -> DataFrame:
    """Adds `rank` (from 1, in the order of a seeded md5 of key, within the groups `by`) and `n` (rows of the
    group).  Ranks are counted in 4096 parts of the order and set off by the parts before, so that a group
    of any size is dealt out."""
    order, part = _hash_order(seed, key)
    rows = df.withColumns({"_o": order, "_part": part})
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*by)
    before = counts.withColumns({"_before": F.sum("_n").over(within.orderBy("_part")) - F.col("_n"), "n": F.sum("_n").over(within)}).drop("_n")
    if by:
        keys = F.lit(True)
        for c in [*by, "_part"]:
            before = before.withColumnRenamed(c, f"_b_{c}")
            keys = keys & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        joined = rows.join(before, keys).drop(*(f"_b_{c}" for c in [*by, "_part"]))
    else:
        joined = rows.join(F.broadcast(before), "_part")  # 4096 rows at most
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_o", key))
    return joined.withColumn("rank", local + F.col("_before")).drop("_o", "_part", "_before")


def sample(df: DataFrame, source: str, key: str, ratio: float, seed: int, cap: int | None = None, least: int = 1) -> DataFrame:
    """Whole keys of each source, max(least, ceil(n * ratio)) and at most `cap`, by rank of a seeded md5."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    ids = hash_rank(df.select(source, key).where(F.col(key).isNotNull()).distinct(), key, seed, [source])
    want = F.greatest(F.lit(least), F.ceil(F.col("n") * ratio))
    want = F.least(want, F.lit(cap), F.col("n")) if cap is not None else F.least(want, F.col("n"))
    return ids.where(F.col("rank") <= want).drop("rank").withColumnRenamed("n", "flows_before")


def draw(ids, ratio: float, seed: int, cap: int | None = None, least: int = 1) -> list[str]:
    """The seeded choice of numpy's default generator over one source's sorted ids."""
    import numpy as np

    own = sorted(set(map(str, ids)))
    if not own:
        return []
    if not 0 < ratio <= 1:
        raise ValueError("the ratio must be in (0, 1]")
    n = min(max(least, math.ceil(len(own) * ratio)), len(own) if cap is None else cap, len(own))
    return [own[i] for i in sorted(np.random.default_rng(seed).choice(len(own), size=n, replace=False).tolist())]


def sample_exact(df: DataFrame, source: str, key: str, ratio: float, seed: int, cap: int | None = None, least: int = 1) -> DataFrame:
    """draw() for each source: (source, key) as text.  A source is one capture, whose ids fit a task; sample() has no
    such limit."""
    ids = df.select(F.col(source).cast("string").alias("source"), F.col(key).cast("string").alias("key")).where("key is not null").distinct()

    def run(key_, rows):
        import pandas as pd

        return pd.DataFrame({"source": key_[0], "key": draw(rows["key"], ratio, seed, cap, least)})

    return ids.groupBy("source").applyInPandas(run, "source string, key string")


def dominant_label(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): the label most rows have, the smallest of those."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), label))).where("_r = 1").select(group, label)


def split_counts(n: int, val: float, test: float) -> tuple[int, int]:
    """Groups for validation and test among n; halves round to even, and train keeps one at least."""
    t, v = (max(1, round(n * x)) if x else 0 for x in (test, val))
    while t + v >= n and t + v:
        if v >= t and v > 0:
            v -= 1
        else:
            t -= 1
    return v, t


def group_split(df: DataFrame, group: str, label: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(group, label, split): groups never straddle splits.  The order is a seeded md5's.  Fewer than three
    groups fail when the result is read."""
    ranked = hash_rank(dominant_label(df, group, label), group, seed)
    n = F.col("n")
    t, v = (F.greatest(F.lit(1), F.bround(n * x).cast("long")) if x else F.lit(0) for x in (test, val))
    # where train would be left without a group, val and test give way in turn, the larger first
    over = F.greatest(F.lit(0), t + v - n + 1)
    lead = F.abs(v - t)
    both = F.greatest(F.lit(0), over - lead)
    lower_v = F.when(v >= t, F.least(over, lead)).otherwise(0) + F.ceil(both / 2)
    lower_t = F.when(v < t, F.least(over, lead)).otherwise(0) + F.floor(both / 2)
    enough = F.when(n < 3, F.raise_error(F.lit("a split needs three groups at least")).cast("long")).otherwise(n)
    out = ranked.withColumns({"_t": t - lower_t, "_v": v - lower_v}).where(enough >= 3)
    return out.select(group, label, F.when(F.col("rank") <= F.col("_t"), "test").when(F.col("rank") <= F.col("_t") + F.col("_v"), "val").otherwise("train").alias("split"))


def group_split_exact(df: DataFrame, group: str, label: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(group, split) by the seeded permutation of numpy's default generator over the groups in the order of
    their dominant labels and names.  Groups are captures, and their names come to the driver; group_split()
    has no such limit."""
    import numpy as np

    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("val and test must not be negative and must leave a share for train")
    names = [str(r[0]) for r in dominant_label(df.withColumn(group, F.col(group).cast("string")), group, label).orderBy(label, group).select(group).collect()]
    if len(names) < 3:
        raise ValueError("a split needs three groups at least")
    mixed = [names[i] for i in np.random.default_rng(seed).permutation(len(names))]
    v, t = split_counts(len(names), val, test)
    split = ["test"] * t + ["val"] * v + ["train"] * (len(names) - t - v)
    return df.sparkSession.createDataFrame(list(zip(mixed, split)), f"`{group}` string, split string")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: of each label's rows, a share of `test` (rounded) by the rank of a seeded md5 of key."""
    ranked = hash_rank(df, key, seed, [label])
    return ranked.withColumn("split", F.when(F.col("rank") <= F.bround(F.col("n") * test), "test").otherwise("train")).drop("rank", "n")


def auc(df: DataFrame, positive: str, score: str, parts: int = 512) -> DataFrame:
    """One row, auc: the share of (positive, negative) pairs in which the positive scores higher, ties counting
    half.  Scores are counted first; their order is cut at approximate quantiles, and the counts of all parts
    below are added to those within."""
    by = df.where(F.col(positive).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(~F.col(positive)).alias("neg"), F.count_if(F.col(positive)).alias("pos"))
    cuts = by.agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    rows = by.withColumn("part", F.size(F.filter(bounds, lambda c: c < F.col("s"))))
    sums = rows.groupBy("part").agg(F.sum("neg").alias("n"))
    below = sums.withColumn("below", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "below")  # one row a part
    w = Window.partitionBy("part").orderBy("s")
    rows = rows.join(F.broadcast(below), "part").withColumn("lower", F.col("below") + F.sum("neg").over(w) - F.col("neg"))
    total = rows.agg(F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select((F.col("won") / F.when(F.col("p") * F.col("n") > 0, F.col("p") * F.col("n"))).alias("auc"))


def fit_normaliser(long: DataFrame, feature: str = "feature", value: str = "value", floor: float = 1e-8) -> DataFrame:
    """(feature, mean, std) over valid entries; a deviation under `floor` is 1."""
    sd = F.stddev_pop(value)
    return long.groupBy(feature).agg(F.avg(value).alias("mean"), F.when(sd < floor, 1.0).otherwise(sd).alias("std"))


def per_class(df: DataFrame, true: str, pred: str, classes: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) for every class, with or without rows."""
    t = df.groupBy(F.col(true).alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(true) == F.col(pred)).alias("tp"))
    p = df.groupBy(F.col(pred).alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    out = classes.join(t, "class", "left").join(p, "class", "left").fillna(0, ["support", "tp", "predicted"])
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    out = out.withColumn("precision", share(F.col("tp"), F.col("predicted"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def class_weights(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """(class, n, weight): n / (classes * rows of the class), 0 for empty classes."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    out = classes.join(counts, "class", "left").fillna(0, ["n"])
    w = Window.partitionBy()
    return out.withColumn("weight", F.when(F.col("n") > 0, F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).otherwise(0.0))


def pad(values: Column, n: int) -> Column:
    """The first n entries, with zeros behind; the mask is 1 for the first size(values) of them."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def mask(values: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= F.size(values)).cast("int"))


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)) - 1


def masked(scores: Column, mask: Column) -> Column:
    """Scores with -10,000 where the mask is 0, and none beyond 10,000 in size."""
    return F.zip_with(scores, mask, lambda s, m: F.when(m == 0, -1e4).otherwise(F.least(F.greatest(s, F.lit(-1e4)), F.lit(1e4))))


def attention_pool(values: Column, scores: Column) -> Column:
    """Sum of values weighted by the softmax of scores."""
    return F.aggregate(F.zip_with(values, softmax(scores), lambda v, a: v * a), F.lit(0.0), lambda s, x: s + x)


def gated_fusion(a: Column, b: Column, mode: str = "gated", fixed: float = 0.5) -> Column:
    """gate * a + (1 - gate) * b, element by element."""
    gate = {"gated": lambda x, y: 1 / (1 + F.exp(-(x + y))), "fixed": lambda x, y: F.lit(fixed), "micro_only": lambda x, y: F.lit(1.0), "burst_only": lambda x, y: F.lit(0.0)}
    if mode == "concat":
        return F.concat(a, b)
    return F.zip_with(a, b, lambda x, y: gate[mode](x, y) * x + (1 - gate[mode](x, y)) * y)


def focal_loss(p_true: Column, weight: Column, gamma: float = 1.5) -> Column:
    p = F.least(F.greatest(p_true, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -weight * F.pow(1 - p, gamma) * F.log(p_true)
