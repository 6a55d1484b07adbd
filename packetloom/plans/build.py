"""From captures to flows, and from packet tables to feature sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import keys, labels
from ..operators import flows, learning as ml
from ..sources import pcap, sinks, tabular

#: The columns of a packet's and a burst's vector.
PACKET_FEATURES = (
    "packet_length", "payload_length", "direction", "signed_length", "iat", "log_iat", "tcp_flags", "ip_ttl", "protocol", "burst_id", "pos_in_burst", "burst_size", "burst_bytes", "is_burst_start", "is_burst_end", "burst_duration",
)
BURST_FEATURES = ("burst_direction", "packet_count", "byte_sum", "duration", "mean_len", "std_len", "mean_iat", "std_iat", "max_iat", "gap_to_previous_burst", "is_first_burst", "is_last_burst")
KEY = ["source_key", "flow_id"]
TENSORS = {"packet_seq": len(PACKET_FEATURES), "burst_seq": len(BURST_FEATURES)}


def capture_flows(packets: DataFrame, timeout: float = 60.0, min_pkts: int = 1, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(flows, packets with flow_id) of decoded captures.  A flow is one session of a key in one file; the
    packets of flows under the limits go with them."""
    if timeout <= 0:
        raise ValueError("the timeout must be positive")
    p = packets.withColumn("base_id", keys.flow_key(*(F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol"))))
    p = flows.sessionize(p, ["source", "base_id"], "frame_index", "t", "tcp_flags", "protocol", timeout)
    p = p.withColumns({"flow_id": F.concat(F.col("base_id"), F.lit("_S"), F.col("session").cast("string")), "key_type": F.substring_index("base_id", "_", 1)})
    by = ["source", "base_id", "session"]
    f = p.groupBy(*by, "flow_id", "key_type").agg(
        F.min_by("protocol", "frame_index").alias("protocol"), F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("byte_count"),
        F.min("t").alias("start_time"), F.max("t").alias("end_time"), (F.max("t") - F.min("t")).alias("duration"),
    )
    f = f.where((F.col("packet_count") >= min_pkts) & (F.col("byte_count") >= min_bytes)).drop("base_id", "session")
    if min_pkts > 1 or min_bytes > 0:
        p = p.join(f.select("source", "flow_id"), ["source", "flow_id"], "left_semi")
    return f, p.drop("base_id", "session", "key_type", "skipped", "error", "decode_sec", "packet_index")


def capture_summary(frames: DataFrame, kept: DataFrame, all_flows: DataFrame) -> DataFrame:
    """One row for each file: kept packets, sessions in all, kept and left out, TCP and UDP packets, seconds, error."""
    total = all_flows.groupBy("source").agg(F.count(F.lit(1)).alias("total_sessions"))
    own = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept_sessions"), F.sum("packet_count").alias("kept_packets"))
    status = pcap.source_status(frames).select("source", F.col("tcp").alias("tcp_packets"), F.col("udp").alias("udp_packets"), F.round("decode_sec", 2).alias("elapsed_sec"), F.coalesce("error", F.lit("")).alias("error"))
    out = status.join(total, "source", "left").join(own, "source", "left").fillna(0, ["total_sessions", "kept_sessions", "kept_packets"])
    return out.withColumn("filtered_sessions", F.col("total_sessions") - F.col("kept_sessions"))


def convert(spark: SparkSession, input_dir: str, output_dir: str, timeout: float = 60.0, min_pkts: int = 1, min_bytes: int = 0, work: str | None = None) -> DataFrame:
    """Captures below input_dir to X_packets.csv and X_flows.csv below output_dir, and summary.csv; returns the
    summary.  Frames are decoded once, into Parquet in `work` (a folder the cluster shares), by default below
    output_dir."""
    work = work or f"{output_dir.rstrip('/')}/_frames"
    pcap.read(spark, input_dir).write.mode("overwrite").parquet(work)
    root = tabular._uri_path(spark, input_dir)
    inner = F.substring(F.regexp_replace("source", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), len(root) + 2, 1 << 20)
    frames = spark.read.schema(pcap.SCHEMA).parquet(work).withColumn("source", F.when(F.length(inner) > 0, F.regexp_replace(inner, pcap.CAPTURES, "")).otherwise(F.col("source")))
    packets = pcap.packets(frames)
    every, _ = capture_flows(packets, timeout)
    kept, own = capture_flows(packets, timeout, min_pkts, min_bytes)
    columns = ("flow_id", "frame_index", F.col("t").alias("timestamp"), "packet_length", "payload_length", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_version", "ip_ttl", "tcp_flags", "tcp_window", "vlan_id", "ether_type")
    sinks.write_flow_files(kept, own.select("source", *columns), output_dir, ["flow_id", "frame_index"])
    summary = capture_summary(frames, kept, every)
    sinks.write_csv(summary, f"{output_dir.rstrip('/')}/summary")
    return summary


def _vector(*columns: Column | str) -> Column:
    return F.array(*((F.col(c) if isinstance(c, str) else c).cast("float") for c in columns))


def _padded(rows: DataFrame, place: str, vector: Column, n: int, name: str) -> DataFrame:
    """(key, name: n vectors with zeros behind, mask)."""
    width = TENSORS[f"{name}_seq"]
    seq = F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("i"), vector.alias("v")))), lambda x: x["v"])
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    out = rows.groupBy(*KEY).agg(seq.alias("v"))
    ones = lambda c, k: F.array_repeat(F.lit(c).cast("float"), k)
    return out.select(*KEY, F.concat("v", F.array_repeat(zero, n - F.size("v"))).alias(f"{name}_seq"), F.concat(ones(1.0, F.size("v")), ones(0.0, n - F.size("v"))).alias(f"{name}_mask"))


def sequences(packets: DataFrame, max_packets: int = 64, max_bursts: int = 32, alpha: float = 1.0, fixed: float | None = None, order: tuple[str, ...] = ("t", "block", "row")) -> DataFrame:
    """source_key, flow_id, packet_seq, packet_mask, burst_seq, burst_mask.  packets: the columns of
    tabular.typed().  Flows are cut to their first packets before anything else, on the map side too, so a
    flow of any length costs no more than a short one behind the shuffle."""
    head = flows.prefix(packets, KEY, list(order), max_packets)
    head = flows.gaps(tabular.prefix_direction(head, KEY, ["pos"]), KEY, ["pos"])
    rows = flows.packet_rows(flows.bursts(head, KEY, ["pos"], alpha, fixed), KEY)
    packet = _vector("packet_length", "payload_length", "direction", F.col("packet_length") * F.col("direction"), "iat", F.log1p("iat"), "tcp_flags", "ip_ttl", "protocol", "burst", "pos_in_burst", "burst_size", "burst_bytes", "is_burst_start", "is_burst_end", "burst_duration")
    # the time since the burst before ended is the first packet's gap
    burst = _vector("burst_direction", "packet_count", "byte_sum", "duration", "mean_len", "std_len", "mean_iat", "std_iat", "max_iat", "gap", "is_first", "is_last")
    bursts = _padded(flows.burst_rows(rows, KEY, max_bursts), "burst", burst, max_bursts, "burst")
    return _padded(rows, "pos", packet, max_packets, "packet").join(bursts, KEY)


def samples(packets: DataFrame, overrides: DataFrame | None = None, **options) -> DataFrame:
    """sequences() with sample_key, capture_group, primary, application, combined; `overrides` (source_key and
    any of primary, application, capture_group) are found by path below the root, or else by file name."""
    first = packets.groupBy(*KEY).agg(F.min(F.struct("source_path", "block", "row")).alias("first_seen"))
    out = sequences(packets, **options).join(first, KEY)
    path = F.col("first_seen.source_path")
    made = {"primary": labels.primary(path), "application": labels.application(path), "capture_group": F.col("source_key")}
    if overrides is not None:
        if "source_key" not in overrides.columns:
            raise ValueError("overrides need source_key")
        given = [c for c in made if c in overrides.columns]
        table = overrides.select(F.translate("source_key", "\\", "/").alias("at"), F.struct(*given, F.lit(True).alias("found")).alias("own")).dropDuplicates(["at"])
        name = F.element_at(F.split("source_key", "/"), -1)
        out = out.join(table.withColumnsRenamed({"own": "by_key", "at": "k"}), F.col("source_key") == F.col("k"), "left")
        out = out.join(table.withColumnsRenamed({"own": "by_name", "at": "n"}), name == F.col("n"), "left")
        got = F.coalesce("by_key", "by_name")
        made |= {c: F.coalesce(got[c].cast("string"), made[c]) for c in given}
    out = out.withColumns(made).withColumn("combined", F.concat_ws(":", "primary", "application"))
    stem = F.regexp_replace(F.element_at(F.split("source_key", "/"), -1), r"(_packets)?\.[^.]*$", "")
    return out.withColumn("sample_key", F.concat_ws(":", stem, "flow_id")).select("sample_key", *KEY, "capture_group", "primary", "application", "combined", "packet_seq", "packet_mask", "burst_seq", "burst_mask", "first_seen")


def dictionaries(rows: DataFrame) -> DataFrame:
    """(kind, label, id): ids by first appearance, in the order of paths and rows."""
    out = None
    for kind, column in (("primary", "primary"), ("secondary", "application"), ("combined", "combined")):
        own = ml.dictionary(rows.withColumnRenamed(column, "label"), "label", "first", "first_seen").select(F.lit(kind).alias("kind"), "label", F.col("id").cast("long").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


def build_features(spark: SparkSession, csv_dir: str, output_dir: str, max_packets: int = 64, max_bursts: int = 32, alpha: float = 1.0, fixed_threshold: float | None = None, source_manifest: str | None = None) -> dict:
    """Feature sequences of all *_packets.csv below csv_dir: tables `samples`, `dictionaries` and `manifest` and
    feature_summary.json in output_dir; returns the summary."""
    out = output_dir.rstrip("/")
    overrides = spark.read.csv(source_manifest, header=True) if source_manifest else None
    rows = samples(tabular.packet_table(spark, csv_dir), overrides, max_packets=max_packets, max_bursts=max_bursts, alpha=alpha, fixed=fixed_threshold)
    rows.write.mode("overwrite").parquet(f"{out}/_built")
    built = spark.read.parquet(f"{out}/_built")
    n = built.count()
    if not n:
        raise ValueError(f"no samples below {csv_dir}")
    dictionaries(built).coalesce(1).write.mode("overwrite").parquet(f"{out}/dictionaries")
    ids = spark.read.parquet(f"{out}/dictionaries")
    coded = built
    for kind, column in (("primary", "primary"), ("secondary", "application"), ("combined", "combined")):
        coded = coded.join(ids.where(F.col("kind") == kind).select(F.col("label").alias(column), F.col("id").alias(f"{kind}_id")), column)
    coded.drop("first_seen").write.mode("overwrite").parquet(f"{out}/samples")
    sinks.write_csv(built.select("sample_key", "source_key", "capture_group", "primary", "application", "combined"), f"{out}/manifest")
    fs, at = sinks._fs(spark, f"{out}/_built")
    fs.delete(at, True)
    mappings: dict = {}
    for r in ids.orderBy("kind", "id").collect():  # one row for each label
        mappings.setdefault(r["kind"], {})[r["label"]] = r["id"]
    summary = {
        "num_samples": n, "packet_shape": [n, max_packets, len(PACKET_FEATURES)], "burst_shape": [n, max_bursts, len(BURST_FEATURES)], "max_packets": max_packets, "max_bursts": max_bursts, "alpha": alpha,
        "fixed_threshold": fixed_threshold, "packet_features": PACKET_FEATURES, "burst_features": BURST_FEATURES, "label_mappings": mappings,
    }
    sinks.save_json(spark, f"{out}/feature_summary.json", summary)
    return summary


def _other_size(n: int):
    return lambda v: F.size(v) != n


def load_features(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of build_features(), after a look at their columns and at the sizes of all sequences."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/samples")
    missing = [c for c in ("sample_key", "packet_seq", "packet_mask", "burst_seq", "burst_mask", "primary_id", "secondary_id", "combined_id") if c not in df.columns]
    if missing:
        raise ValueError(f"{folder} has no {', '.join(missing)}")
    wrong = F.lit(False)
    for name, width in TENSORS.items():
        mask = name.replace("_seq", "_mask")
        wrong = wrong | (F.size(name) != F.size(mask)) | (F.size(F.filter(name, _other_size(width))) > 0)
    sizes = df.agg(F.count_if(wrong).alias("wrong"), F.count_distinct(F.size("packet_seq")).alias("p"), F.count_distinct(F.size("burst_seq")).alias("b")).first()
    if sizes["wrong"] or sizes["p"] > 1 or sizes["b"] > 1:
        raise ValueError(f"{folder} has sequences of other shapes")
    return df


#: Features that are normalised.
CONTINUOUS = {
    "packet_seq": ("packet_length", "payload_length", "signed_length", "iat", "log_iat", "ip_ttl", "pos_in_burst", "burst_size", "burst_bytes", "burst_duration"),
    "burst_seq": ("packet_count", "byte_sum", "duration", "mean_len", "std_len", "mean_iat", "std_iat", "max_iat", "gap_to_previous_burst"),
}
NAMES = {"packet_seq": PACKET_FEATURES, "burst_seq": BURST_FEATURES}


def fit_normaliser(train: DataFrame) -> dict:
    """{sequence: {mean, std}} over the unmasked vectors of training samples; features that aren't continuous
    keep mean 0 and deviation 1, and so do deviations under 1e-8."""
    out = {}
    for name, features in NAMES.items():
        mask = name.replace("_seq", "_mask")
        valid = train.select(F.explode(F.filter(F.arrays_zip(F.col(name).alias("v"), F.col(mask).alias("m")), lambda z: z["m"] > 0)).alias("z")).select("z.v")
        own = [i for i, f in enumerate(features) if f in CONTINUOUS[name]]
        column = lambda i: F.col("v")[i].cast("double")
        r = valid.agg(F.count(F.lit(1)).alias("n"), *(F.avg(column(i)).alias(f"m{i}") for i in own), *(F.stddev_pop(column(i)).alias(f"s{i}") for i in own)).first()
        if not r["n"]:
            raise ValueError("no valid vectors to fit")
        out[name] = {"features": list(features), "mean": [r[f"m{i}"] if i in own else 0.0 for i in range(len(features))], "std": [(r[f"s{i}"] if r[f"s{i}"] >= 1e-8 else 1.0) if i in own else 1.0 for i in range(len(features))]}
    return out


def _scaled(mean: Column, std: Column):
    return lambda v, m: F.transform(v, lambda x, i: ((x - F.get(mean, i)) / F.get(std, i) * m).cast("float"))


def normalise(df: DataFrame, stats: dict) -> DataFrame:
    """Sequences less their means, over their deviations; padding stays zero."""
    out = df
    for name, s in stats.items():
        mean, std = (F.array(*(F.lit(float(x)) for x in s[k])) for k in ("mean", "std"))
        out = out.withColumn(name, F.zip_with(F.col(name), F.col(name.replace("_seq", "_mask")), _scaled(mean, std)))
    return out
