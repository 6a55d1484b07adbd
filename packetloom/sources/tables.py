"""The packet view over the event table: a user's events are a flow's packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    forward = F.col("event_type").isin("click", "purchase", "signup")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    client, server = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")), F.concat(F.lit("10.0.1."), (F.col("user_id") % 7).cast("string"))
    near = F.when(F.col("event_type") == "signup", 0).otherwise(1024 + F.col("user_id") % 1000).cast("int")
    return e.select(
        F.col("user_id").alias("flow_id"), F.col("event_id").alias("frame_index"), (us / 1e6).alias("t"), F.col("value").alias("packet_length"),
        F.get_json_object("props", "$.k").cast("int").alias("payload_length"), F.when(forward, 1).otherwise(-1).alias("direction"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 4).otherwise(16).alias("tcp_flags"),
        F.when(F.col("user_id") % 3 != 0, 6).otherwise(17).alias("protocol"),
        F.when(forward, client).otherwise(server).alias("src_ip"), F.when(forward, server).otherwise(client).alias("dst_ip"),
        F.when(forward, near).otherwise(443).alias("src_port"), F.when(forward, 443).otherwise(near).alias("dst_port"),
    )


def frames(df: DataFrame, protocol: str = "protocol", tags: Column | None = None, header: Column | None = None) -> DataFrame:
    """Adds `frame`: the packet view's rows written out as Ethernet frames of IPv4, with VLAN ids `tags`
    (array<int>) and a transport header in hexadecimal (by default TCP's or UDP's)."""
    hx = lambda c, n: F.lpad(F.hex(c), n, "0")
    address = lambda c: F.array_join(F.transform(F.split(c, r"\."), lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), "")
    ports = F.concat(hx(F.col("src_port"), 4), hx(F.col("dst_port"), 4))
    tcp = F.concat(ports, F.lit("000000010000000250"), hx(F.col("tcp_flags"), 2), F.lit("01F400000000"))
    udp = F.concat(ports, hx(F.col("payload_length") + 8, 4), F.lit("0000"))
    body = F.concat(F.when(F.col(protocol) == 6, tcp).otherwise(udp) if header is None else header, F.repeat(F.lit("78"), F.col("payload_length")))
    ip = F.concat(F.lit("4500"), hx((F.length(body) / 2 + 20).cast("int"), 4), F.lit("0000000040"), hx(F.col(protocol), 2), F.lit("0000"), address("src_ip"), address("dst_ip"))
    vlans = F.array_join(F.transform(tags, lambda v: F.concat(F.lit("8100"), F.lpad(F.hex(v), 4, "0"))), "") if tags is not None else F.lit("")
    return df.withColumn("frame", F.unhex(F.concat(F.lit("010101010101020202020202"), vlans, F.lit("0800"), ip, body)))


def decoded(df: DataFrame, decode, schema: str) -> DataFrame:
    """flow_id, frame_index, t and the decoder's fields of rows with a frame."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = "flow_id long, frame_index long, t double, " + schema
    arrow = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches):
        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in range(4)))
            yield pa.RecordBatch.from_pylist([{"flow_id": f, "frame_index": i, "t": t, **decode(raw)} for f, i, t, raw in own], arrow)

    return df.select("flow_id", "frame_index", "t", "frame").mapInArrow(run, kind)
