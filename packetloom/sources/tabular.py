"""Packet and flow tables in CSV files.

Every cell is read as text.  Files of one scan may have different columns: they are grouped by their first
line, one scan for each kind, and united by name.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import casts, keys

#: Where a row is: path below the root, whole path, and place in the file.
PLACE = ("source_key", "source_path", "block", "row")


def _uri_path(spark: SparkSession, path: str) -> str:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")


def files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths below root whose names match a glob pattern, in order; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return sorted(r["path"] for r in found.collect())


def header(spark: SparkSession, path: str) -> list[str]:
    """The cells of a file's first line, which alone is read."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return [c.strip() for c in next(csv.reader([(line or "").lstrip("\ufeff")]), [])]


def _read(spark: SparkSession, root: str, columns: tuple[str, ...], paths: list[str]) -> DataFrame:
    kind = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.csv(paths, schema=kind, header=True)
    whole = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    place = {"source_path": whole, "block": F.col("_metadata.file_block_start"), "row": F.monotonically_increasing_id()}
    return df.withColumns(place).withColumn("source_key", F.substring("source_path", len(_uri_path(spark, root)) + 2, 1 << 20))


def kinds(spark: SparkSession, root: str, pattern: str, required: tuple[str, ...] = ("flow_id",), skip: bool = False) -> list[DataFrame]:
    """One table of text cells for each kind of header.  Files without a required column are an error, or are
    passed over with `skip`; no files at all is an error."""
    by: dict[tuple[str, ...], list[str]] = {}
    found = files(spark, root, pattern)
    if not found:
        raise FileNotFoundError(f"no {pattern} below {root}")
    for path in found:
        columns = tuple(header(spark, path))
        missing = [c for c in required if c not in columns]
        if not missing:
            by.setdefault(columns, []).append(path)
        elif not skip:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
    return [_read(spark, root, columns, paths) for columns, paths in by.items()]


def scan(spark: SparkSession, root: str, pattern: str, required: tuple[str, ...] = ("flow_id",), skip: bool = False) -> DataFrame:
    """All files as one table; columns that a file doesn't have are null in its rows."""
    tables = kinds(spark, root, pattern, required, skip)
    if not tables:
        raise ValueError(f"none of the {pattern} below {root} has {', '.join(required)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


#: Names under which a number may stand, in the order in which they are tried.
NAMES = {
    "t": ("timestamp", "packet_time", "time", "ts"),
    "direction": ("direction", "packet_direction"),
    "packet_length": ("packet_length", "len", "length"),
    "payload_length": ("payload_length", "payload_len"),
    "ip_ttl": ("ip_ttl", "ttl"),
    "protocol": ("protocol", "proto"),
}
ENDS = ("src_ip", "src_port", "dst_ip", "dst_port")


def typed(df: DataFrame) -> DataFrame:
    """Numbers of a packet table of text cells; direction is null where the file has no such column."""
    has = lambda *names: [F.col(c) for c in names if c in df.columns]
    flags = has("tcp_flags", "flags")[:1]
    out = {n: casts.first_number(*has(*names)) for n, names in NAMES.items()}
    if "direction" not in df.columns:
        out["direction"] = F.lit(None).cast("double")
    out["tcp_flags"] = casts.tcp_flags(flags[0]) if flags else F.lit(0.0)
    ends = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ENDS]
    return df.select("flow_id", *ends, *(c.alias(n) for n, c in out.items()), *PLACE)


def packet_table(spark: SparkSession, root: str, pattern: str = "*_packets.csv") -> DataFrame:
    return reduce(DataFrame.unionByName, (typed(t) for t in kinds(spark, root, pattern)))


def prefix_direction(df: DataFrame, flow: list[str], order: list[str]) -> DataFrame:
    """Fills in directions from the flow's first packet.  To be used on prefixes, which have it."""
    return df.withColumn("direction", F.coalesce("direction", keys.direction_pm1(flow, order).cast("double")))


def paired_flows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(flows, packets) of X_flows.csv and X_packets.csv, each with `source`, X below the root; a flow file
    without its packet file is an error."""
    have = set(files(spark, root, "*_packets.csv"))
    for path in files(spark, root, "*_flows.csv"):
        if path[: -len("_flows.csv")] + "_packets.csv" not in have:
            raise FileNotFoundError(f"no packet file beside {path}")
    both = []
    for kind in ("flows", "packets"):
        both.append(scan(spark, root, f"*_{kind}.csv").withColumn("source", F.regexp_replace("source_key", rf"_{kind}\.csv$", "")))
    flows, packets = both
    return flows, packets.join(flows.select("source").distinct(), "source", "left_semi")


def paired_beside(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None]:
    """(flows, packets) of X.csv and X.pkt.csv; files without flow_id, flow files without packet files and
    packets of no flow of their file are passed over.  Flows get class and activity labels from the file
    name where they have none."""
    from ..functions import labels

    stems = {p[: -len(".pkt.csv")] for p in files(spark, root, "*.pkt.csv")}
    tables = kinds(spark, root, "*.csv", skip=True)
    flows = [t.where(~F.col("source_key").endswith(".pkt.csv")) for t in tables]
    if not flows:
        raise ValueError(f"no flow table below {root}")
    flows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flows)
    name = F.element_at(F.split("source_key", "/"), -1)
    fill = {c: F.coalesce(F.col(c), made) if c in flows.columns else made for c, made in (("class_label", labels.activity_class(name)), ("activity_label", labels.activity(name)))}
    flows = flows.withColumns({**fill, "source_file": name, "source": F.regexp_replace("source_key", r"\.csv$", "")})
    if not stems:
        return flows, None
    packets = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.where(F.col("source_key").endswith(".pkt.csv")) for t in tables])
    packets = packets.withColumn("source", F.regexp_replace("source_key", r"\.pkt\.csv$", ""))
    return flows, packets.join(flows.select("source", "flow_id"), ["source", "flow_id"], "left_semi")
