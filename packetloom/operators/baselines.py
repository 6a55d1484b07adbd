"""Baseline classifiers on pooled features, with Spark's own learners: balanced logistic regression and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import learning as ml


def pooled(df: DataFrame, sequence: str = "packet_seq", mask: str = "packet_mask") -> DataFrame:
    """Adds `pooled`, the mean of the unmasked vectors of a sequence (zeros where there are none)."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + F.when(m > 0, 1.0).otherwise(0.0)), F.lit(1.0))
    width = F.size(F.element_at(sequence, 1))
    column = lambda i: F.aggregate(F.zip_with(sequence, mask, lambda v, m: F.when(m > 0, F.get(v, i).cast("double")).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / n
    return df.withColumn("pooled", F.transform(F.sequence(F.lit(0), width - 1), column))


def prepare(df: DataFrame, features: str, label: str, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with standardised `x`, `y` and balanced `weight`, split by label; the scaling is fitted to all
    rows, as these baselines are."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(key).alias("key"), array_to_vector(features).alias("raw"), F.col(label).cast("double").alias("y"))
    rows = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(rows).transform(rows)
    rows = ml.stratified_split(rows.select("key", "x", "y"), "y", "key", test, seed)
    train = rows.where("split = 'train'")
    classes = train.select(F.col("y").alias("class")).distinct()
    w = ml.class_weights(train, "y", classes).select(F.col("class").alias("y"), "weight")
    return train.join(F.broadcast(w), "y"), rows.where("split = 'test'")  # one row a class


def evaluate(train: DataFrame, test: DataFrame, kind: str = "logistic", trees: int = 100, seed: int = 42) -> dict:
    """{accuracy, auc (of two classes), importance (of a forest, largest first, ten)} and the scored rows."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    columns = {"featuresCol": "x", "labelCol": "y", "weightCol": "weight"}
    model = (LogisticRegression(maxIter=100, **columns) if kind == "logistic" else RandomForestClassifier(numTrees=trees, seed=seed, **columns)).fit(train)
    scored = model.transform(test).select("key", "y", vector_to_array("probability").alias("probabilities"), F.col("prediction").alias("p"))
    out = {"accuracy": scored.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0], "rows": scored}
    if model.numClasses == 2:
        out["auc"] = ml.auc(scored.select((F.col("y") == 1).alias("pos"), F.col("probabilities")[1].alias("s")), "pos", "s").first()[0]
    if kind != "logistic":
        found = model.featureImportances.toArray()
        out["importance"] = sorted(((int(i), float(x)) for i, x in enumerate(found)), key=lambda v: (-v[1], v[0]))[:10]
    return out
