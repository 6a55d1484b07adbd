"""Commands: python -m packetloom.cli <command> --help"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from . import config
from .functions import labels
from .operators import baselines, flows, learning as ml, micro
from .plans import build
from .sources import preserving, sinks, tabular


def convert(spark, a) -> None:
    build.convert(spark, a.input_dir, a.output_dir, a.flow_timeout, a.min_pkts, a.min_bytes)


def preserve(spark, a) -> None:
    work = f"{a.output_dir.rstrip('/')}/_frames"
    preserving.read(spark, a.input_dir, a.keep_l2).write.mode("overwrite").parquet(work)
    frames = spark.read.schema(preserving.SCHEMA).parquet(work)
    f, p = preserving.tables(frames, a.min_pkts, a.min_bytes)
    for name, df in (("flows", f), ("packets", p)):
        sinks.write_csv(df, f"{a.output_dir.rstrip('/')}/{name}", "source")
    preserving.stats(frames).write.mode("overwrite").json(f"{a.output_dir.rstrip('/')}/stats")


def sample(spark, a) -> None:
    f, p = tabular.paired_flows(spark, a.input_dir)
    draw = ml.sample_exact if a.exact else ml.sample
    ids = draw(f, "source", "flow_id", a.ratio, a.seed, a.max_flows_per_file, a.min_flows_per_file).select("source", F.col("key" if a.exact else "flow_id").alias("flow_id"))
    ids.write.mode("overwrite").parquet(f"{a.output_dir.rstrip('/')}/_chosen")
    ids = spark.read.parquet(f"{a.output_dir.rstrip('/')}/_chosen")
    for df, suffix in ((f, "_flows.csv"), (p, "_packets.csv")):
        rows = df.join(ids, ["source", "flow_id"], "left_semi")
        sinks.write_csv_files(rows.drop("source_key", "source_path"), a.output_dir, "source", suffix, ["block", "row"])
    before = f.groupBy("source").agg(F.count(F.lit(1)).alias("flows_before"))
    after = ids.groupBy("source").agg(F.count(F.lit(1)).alias("flows_after"), F.concat_ws("|", F.sort_array(F.collect_list("flow_id"))).alias("selected_flow_ids"))
    many = p.join(ids, ["source", "flow_id"], "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("packets_after"))
    manifest = before.join(after, "source").join(many, "source", "left").fillna(0, ["packets_after"]).withColumns({"ratio": F.lit(a.ratio), "seed": F.lit(a.seed)})
    sinks.write_csv(manifest, f"{a.output_dir.rstrip('/')}/sampling_manifest")


def features(spark, a) -> None:
    print(json.dumps(build.build_features(spark, a.csv_dir, a.output_dir, a.max_packets, a.max_bursts, a.alpha, a.fixed_threshold, a.source_manifest), default=str))


def windows(spark, a) -> None:
    """Windows of 5 s every 2.5 s with their packets' vectors, and the labels of their files."""
    raw = tabular.scan(spark, a.input_dir, "*.csv")
    rows = raw.withColumns({"t": build_number(raw, "timestamp"), "flow": F.concat_ws(":", "source_key", "flow_id")})
    hops = flows.hop_windows(rows, ["flow"], 5.0, 2.5)
    micro.window_packets(hops, ["source_key", "flow", "k"], ["t", "block", "row"]).write.mode("overwrite").parquet(f"{a.output_dir.rstrip('/')}/windows")
    labels.file_labels(raw, "source_key", "source_path", ["block", "row"]).write.mode("overwrite").parquet(f"{a.output_dir.rstrip('/')}/labels")


def build_number(df, name: str):
    from .functions import casts

    return casts.first_number(F.col(name)) if name in df.columns else F.lit(0.0)


def frames20(spark, a) -> None:
    """Segments of flows with the 20 features of trailing frames."""
    f, p = tabular.paired_beside(spark, a.input_dir)
    if p is None:
        raise FileNotFoundError(f"no packet tables below {a.input_dir}")
    key = ["source", "flow_id"]
    rows = p.select(*key, "block", "row", build_number(p, "timestamp").alias("t"), build_number(p, "packet_length").alias("packet_length"), build_number(p, "direction").cast("int").alias("dir01"), (F.col("tcp_flags") if "tcp_flags" in p.columns else F.lit("")).alias("flags"))
    rows = flows.gaps(rows, key, ["t", "block", "row"])
    out = micro.time_split(micro.micro20(rows, key, ["t", "block", "row"]), key, a.variants if a.strategy == "time_split" else 1, a.max_seq_len)
    out.write.mode("overwrite").parquet(f"{a.output_dir.rstrip('/')}/segments")
    micro.variant_ordinal(f, ["flow_id"], ["source", "block", "row"]).write.mode("overwrite").parquet(f"{a.output_dir.rstrip('/')}/flows")


def split(spark, a) -> None:
    rows = build.load_features(spark, a.features_dir).select("capture_group", "combined_id")
    make = ml.group_split_exact if a.exact else ml.group_split
    print(json.dumps(sinks.save_split(make(rows, "capture_group", "combined_id", a.val_ratio, a.test_ratio, a.seed).select("capture_group", "split"), rows, a.split_file, "capture_group", "combined_id", a.seed)))


def _task(spark, features_dir: str, task: str):
    """(samples with label_id, names of the classes) of a task."""
    rows = build.load_features(spark, features_dir)
    names = list(labels.APPLICATIONS) if task == "application8" else ["NONTOR", "TOR"]
    column = F.col("application" if task == "application8" else "primary")
    at = F.array_position(F.array(*(F.lit(n) for n in names)), column) - 1
    return rows.withColumn("label_id", at.cast("int")).where("label_id >= 0"), names


def _evaluate(spark, features_dir: str, split_file: str, task: str, folder: str, kind: str, part: str, seed: int) -> dict:
    rows, names = _task(spark, features_dir, task)
    groups, _ = sinks.load_split(spark, split_file)
    rows = rows.join(groups, "capture_group")
    train = rows.where("split = 'train'")
    stats = build.fit_normaliser(train)
    sinks.save_json(spark, f"{folder}/normaliser.json", stats)
    own = baselines.pooled(build.normalise(rows, stats)).select(F.col("sample_key").alias("key"), "pooled", F.col("label_id").cast("double").alias("y"), "split")
    from pyspark.ml.functions import array_to_vector

    own = own.withColumn("x", array_to_vector("pooled"))
    w = ml.class_weights(own.where("split = 'train'"), "y", own.select(F.col("y").alias("class")).distinct()).select(F.col("class").alias("y"), "weight")
    got = baselines.evaluate(own.where("split = 'train'").join(F.broadcast(w), "y"), own.where(F.col("split") == part), kind, seed=seed)
    scored = got["rows"].select(F.col("key").alias("sample_key"), F.col("y").cast("int").alias("true_id"), F.col("p").cast("int").alias("pred_id"), "probabilities")
    classes = spark.range(len(names)).select(F.col("id").cast("int").alias("class"))
    per = ml.per_class(scored, "true_id", "pred_id", classes).orderBy("class").collect()
    n = sum(r["support"] for r in per)
    metrics = {
        "evaluated_split": part, "sample_count": n, "accuracy": got["accuracy"], "macro_f1": sum(r["f1"] for r in per) / len(per), "weighted_f1": sum(r["f1"] * r["support"] for r in per) / max(n, 1),
        "per_class": {names[r["class"]]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in per},
    }
    width = F.size("probabilities")
    filled = scored.withColumn("probabilities", F.concat("probabilities", F.array_repeat(F.lit(0.0), F.lit(len(names)) - width)))
    sinks.write_predictions(filled, folder, names, metrics)
    return metrics


def evaluate(spark, a) -> None:
    print(json.dumps(_evaluate(spark, a.features_dir, a.split_file, a.task, a.output_dir.rstrip("/"), a.kind, a.split, a.seed)))


def run(spark, a) -> None:
    """An experiment file, with a baseline learner in the network's place."""
    c = config.load(a.config)
    if a.dry_run:
        print(json.dumps(c, default=str))
        return
    folder = f"{a.output_dir.rstrip('/')}/{c['experiment_id']}"
    fs, at = sinks._fs(spark, f"{folder}/metrics.json")
    if a.resume and fs.exists(at):
        print(json.dumps(sinks.load_json(spark, f"{folder}/metrics.json")))
        return
    sinks.save_json(spark, f"{folder}/config.json", c)
    print(json.dumps(_evaluate(spark, c["features_dir"], c["split_file"], c["task"], folder, "logistic", "test", c["seed"])))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="packetloom")
    commands = top.add_subparsers(required=True)

    def add(name, run, *arguments):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for flag, options in arguments:
            c.add_argument(flag, **options)

    need = {"required": True}
    num = lambda kind, default: {"type": kind, "default": default}
    yes = {"action": "store_true"}
    io = [("--input_dir", need), ("--output_dir", need)]
    add("convert", convert, *io, ("--flow_timeout", num(float, 60.0)), ("--min_pkts", num(int, 1)), ("--min_bytes", num(int, 0)))
    add("preserve", preserve, *io, ("--keep_l2", yes), ("--min_pkts", num(int, 1)), ("--min_bytes", num(int, 1)))
    add("sample", sample, *io, ("--ratio", num(float, 0.1)), ("--seed", num(int, 42)), ("--max_flows_per_file", num(int, None)), ("--min_flows_per_file", num(int, 1)), ("--exact", yes))
    add("features", features, ("--csv_dir", need), ("--output_dir", need), ("--max_packets", num(int, 64)), ("--max_bursts", num(int, 32)), ("--alpha", num(float, 1.0)), ("--fixed_threshold", num(float, None)), ("--source_manifest", {}))
    add("windows", windows, *io)
    add("frames20", frames20, *io, ("--strategy", {"choices": ["time_split", "mixed"], "default": "time_split"}), ("--variants", num(int, 3)), ("--max_seq_len", num(int, 32)))
    add("split", split, ("--features_dir", need), ("--split_file", need), ("--val_ratio", num(float, 0.15)), ("--test_ratio", num(float, 0.15)), ("--seed", num(int, 42)), ("--exact", yes))
    add("evaluate", evaluate, ("--features_dir", need), ("--split_file", need), ("--output_dir", need), ("--task", {"choices": config.TASKS, "default": "application8"}), ("--kind", {"choices": ["logistic", "forest"], "default": "logistic"}), ("--split", {"choices": ["train", "val", "test"], "default": "test"}), ("--seed", num(int, 42)))
    add("run", run, ("--config", need), ("--output_dir", {"default": "experiments"}), ("--dry_run", yes), ("--resume", yes))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("packetloom").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
