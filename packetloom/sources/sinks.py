"""Where results go: tables as CSV or Parquet, small documents as JSON, all by Spark's and Hadoop's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def write_csv(df: DataFrame, folder: str, by: str | None = None) -> None:
    """A folder of CSV parts, or one for each value of `by`; large values are split over parts."""
    if by is None:
        df.write.mode("overwrite").csv(folder, header=True)
    else:
        df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).csv(folder, header=True)


def write_csv_files(df: DataFrame, folder: str, key: str, suffix: str, order: list[str]) -> list[str]:
    """One file <value of key><suffix> below `folder` for each value, such as other tools read; rows in order.
    The layout wants a value's rows in one file, hence in one task; write_csv has no such limit."""
    spark, work = df.sparkSession, f"{folder.rstrip('/')}/_work-{uuid.uuid4().hex}"
    columns = [c for c in df.columns if c != key]
    df.withColumn("_key", F.col(key)).select("_key", *columns).repartition("_key").sortWithinPartitions("_key", *order).write.partitionBy("_key").option("maxRecordsPerFile", 0).csv(work, header=True)
    fs, root = _fs(spark, work)
    out = []
    for status in fs.listStatus(root):
        if not status.isDirectory():
            continue
        value = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(status.getPath().getName()[len("_key=") :])
        for part in fs.listStatus(status.getPath()):
            _, to = _fs(spark, f"{folder.rstrip('/')}/{value}{suffix}")
            fs.mkdirs(to.getParent())
            fs.delete(to, False)
            if not fs.rename(part.getPath(), to):
                raise OSError(f"could not write {to}")
            out.append(value + suffix)
    fs.delete(root, True)
    return sorted(out)


def save_json(spark: SparkSession, path: str, value) -> None:
    fs, at = _fs(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    stream.close()


def load_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_flow_files(flows: DataFrame, packets: DataFrame, folder: str, order: list[str]) -> list[str]:
    """<source>_flows.csv and <source>_packets.csv for each value of `source`."""
    return write_csv_files(flows, folder, "source", "_flows.csv", ["start_time", "flow_id"]) + write_csv_files(packets, folder, "source", "_packets.csv", order)


def save_split(split: DataFrame, rows: DataFrame, path: str, group: str, label: str, seed: int) -> dict:
    """The split's table at `path`, and <path>.json with samples, groups and classes of each part."""
    split.write.mode("overwrite").parquet(path)
    counts = rows.join(split.select(group, "split"), group).groupBy("split", F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()
    groups = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    out: dict = {"seed": seed, "splits": {}}
    for name in ("train", "val", "test"):
        own = {r["label"]: r["n"] for r in counts if r["split"] == name}
        out["splits"][name] = {"samples": sum(own.values()), "groups": groups.get(name, 0), "class_counts": dict(sorted(own.items()))}
    save_json(split.sparkSession, path.rstrip("/") + ".json", out)
    return out


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(path), int(load_json(spark, path.rstrip("/") + ".json")["seed"])


def write_predictions(rows: DataFrame, folder: str, names: list[str], metrics: dict) -> None:
    """predictions (sample_key, true and predicted id and label, a probability for each class) and metrics.json;
    rows: sample_key, true_id, pred_id, probabilities."""
    label = lambda c: F.element_at(F.array(*(F.lit(n) for n in names)), F.col(c) + 1)
    out = rows.select("sample_key", "true_id", label("true_id").alias("true_label"), "pred_id", label("pred_id").alias("pred_label"), *(F.col("probabilities")[i].alias(f"prob_{n}") for i, n in enumerate(names)))
    write_csv(out, f"{folder.rstrip('/')}/predictions")
    save_json(rows.sparkSession, f"{folder.rstrip('/')}/metrics.json", metrics)
