"""Flow keys and packet directions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def flow_key(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """One text for both directions: addresses in text order, each port beside its address; without
    ports 3T, without addresses P.  Ports are -1 where there are none."""
    low, high = F.least(src_ip, dst_ip), F.greatest(src_ip, dst_ip)
    turned = src_ip != low
    ports = F.concat_ws("_", F.when(turned, dst_port).otherwise(src_port), F.when(turned, src_port).otherwise(dst_port))
    addressed = (F.coalesce(src_ip, F.lit("")) != "") & (F.coalesce(dst_ip, F.lit("")) != "")
    return (
        F.when(addressed & (src_port != -1) & (dst_port != -1), F.concat_ws("_", F.lit("5T"), low, high, ports, protocol))
        .when(addressed, F.concat_ws("_", F.lit("3T"), low, high, protocol))
        .otherwise(F.concat_ws("_", F.lit("P"), protocol))
    )


def direction_pm1(flow: list[str], order: list[str]) -> Column:
    """+1 for packets like their flow's first in all five fields, -1 for reversed ones; for others the
    source address decides."""
    w = Window.partitionBy(*flow).orderBy(*order)
    first = {c: F.first(c).over(w) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")}
    same = (F.col("src_ip") == first["src_ip"]) & (F.col("src_port") == first["src_port"]) & (F.col("dst_ip") == first["dst_ip"]) & (F.col("dst_port") == first["dst_port"]) & (F.col("protocol") == first["protocol"])
    turned = (F.col("src_ip") == first["dst_ip"]) & (F.col("src_port") == first["dst_port"]) & (F.col("dst_ip") == first["src_ip"]) & (F.col("dst_port") == first["src_port"]) & (F.col("protocol") == first["protocol"])
    return F.when(same, 1).when(turned, -1).when(F.col("src_ip") == first["src_ip"], 1).otherwise(-1)


def direction_01_first(flow: list[str], order: list[str]) -> Column:
    """0 for packets from the source address and port of their flow's first packet, else 1."""
    w = Window.partitionBy(*flow).orderBy(*order)
    return F.when((F.col("src_ip") == F.first("src_ip").over(w)) & (F.col("src_port") == F.first("src_port").over(w)), 0).otherwise(1)


def direction_01_canon() -> Column:
    """0 for packets from the address that comes first in text order, else 1."""
    return F.when(F.col("src_ip") == F.least("src_ip", "dst_ip"), 0).otherwise(1)
