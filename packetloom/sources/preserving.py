"""The preserving decoder: frames with all their VLAN tags, addresses of the link, and the fields of TCP, UDP,
ICMP, ESP, AH and GRE; frames that aren't IP may be kept as flows of the link.

Flow keys, directions, filters and counts are DataFrame work on its rows.
"""

from __future__ import annotations

import functools
import struct

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import pcap

SCHEMA = (
    "source string, frame_index long, packet_index long, ts_us long, t double, packet_length int, ethertype int, vlan_ids string, src_mac string, dst_mac string, ip_version int, src_ip string, dst_ip string, protocol int, "
    "src_port int, dst_port int, tcp_seq long, tcp_ack long, tcp_flags int, tcp_window int, icmp_type int, icmp_code int, esp_spi long, ah_spi long, gre_protocol int, ip_ttl int, header_length int, payload_length int, "
    "l2 boolean, skipped string, error string, decode_sec double"
)
#: What a packet has where its protocol has no such field.
ABSENT = {"src_port": -1, "dst_port": -1, "tcp_seq": 0, "tcp_ack": 0, "tcp_flags": 0, "tcp_window": 0, "icmp_type": -1, "icmp_code": -1, "esp_spi": 0, "ah_spi": 0, "gre_protocol": 0, "ip_ttl": 0}
#: The columns of the packet table, in their order.
PACKET_COLUMNS = (
    "flow_id", "key_type", "packet_index", "timestamp", "packet_length", "direction", "ethertype", "vlan_ids", "src_mac", "dst_mac", "ip_version", "src_ip", "dst_ip", "protocol",
    "src_port", "dst_port", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "icmp_type", "icmp_code", "esp_spi", "ah_spi", "gre_protocol", "ip_ttl", "header_length", "payload_length",
)
FLOW_COLUMNS = ("flow_id", "key_type", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count", "byte_count", "start_time", "end_time", "duration", "ip_version", "traffic_label", "app_label", "pcap_file")


def mac(raw: bytes) -> str:
    return raw.hex(":")


def tags(raw: bytes) -> tuple[int, list[int], int]:
    """(EtherType behind all VLAN tags, their ids, start of what follows)."""
    found, at = [], 12
    while True:
        if len(raw) < at + 2:
            return 0, found, len(raw)
        (kind,) = struct.unpack_from("!H", raw, at)
        if kind not in pcap.VLAN_TAGS:
            return kind, found, at + 2
        if len(raw) < at + 6:
            return kind, found, len(raw)
        found.append(struct.unpack_from("!H", raw, at + 2)[0] & 0xFFF)
        at += 4


def transport(raw: bytes, at: int, protocol: int, version: int) -> tuple[int, dict]:
    """(bytes of the header, its fields)."""
    left = len(raw) - at
    if protocol in (6, 17) and left >= 4:
        ports = dict(zip(("src_port", "dst_port"), struct.unpack_from("!HH", raw, at)))
        if protocol == 17 or left < 20:
            return 8, ports
        seq, ack, size, flags, window = struct.unpack_from("!IIBBH", raw, at + 4)
        return (size >> 4) * 4, ports | {"tcp_seq": seq, "tcp_ack": ack, "tcp_flags": flags, "tcp_window": window}
    if protocol == (1 if version == 4 else 58) and left >= 4:
        return 4, {"icmp_type": raw[at], "icmp_code": raw[at + 1]}
    if version == 4:
        # protocol: (bytes there must be, bytes of the header, field, its format, its place)
        fixed = {50: (8, 8, "esp_spi", "!I", 0), 51: (8, 8, "ah_spi", "!I", 4), 47: (4, 4, "gre_protocol", "!H", 2)}
        if protocol in fixed and left >= fixed[protocol][0]:
            _, size, name, form, place = fixed[protocol]
            return size, {name: struct.unpack_from(form, raw, at + place)[0]}
    return 0, {}


def decode(raw: bytes, keep_l2: bool = False) -> dict:
    if len(raw) < 14:
        return {"skipped": "truncated_eth"}
    ether, vlans, at = tags(raw)
    link = {"packet_length": len(raw), "ethertype": ether, "vlan_ids": "|".join(map(str, vlans)), "src_mac": mac(raw[6:12]), "dst_mac": mac(raw[:6])}
    if ether == pcap.IPV4 and len(raw) >= at + 20:
        l4 = at + (raw[at] & 15) * 4
        if len(raw) < l4:
            return link | {"skipped": "truncated_ipv4"}
        version, protocol = 4, raw[at + 9]
        ends = {"src_ip": ".".join(map(str, raw[at + 12 : at + 16])), "dst_ip": ".".join(map(str, raw[at + 16 : at + 20])), "ip_ttl": raw[at + 8]}
    elif ether == pcap.IPV6 and len(raw) >= at + 40:
        version, protocol, l4 = 6, raw[at + 6], at + 40
        ends = {"src_ip": raw[at + 8 : at + 24].hex(":", 2), "dst_ip": raw[at + 24 : at + 40].hex(":", 2)}
    elif keep_l2:
        header = 14 + 4 * len(vlans)
        return link | ABSENT | {"ip_version": 0, "src_ip": "", "dst_ip": "", "protocol": -1, "header_length": header, "payload_length": max(0, len(raw) - header), "l2": True}
    else:
        return link | {"l2": True, "skipped": "non_ip_ethertype"}
    size, fields = transport(raw, l4, protocol, version)
    return link | ABSENT | ends | {"ip_version": version, "protocol": protocol, "l2": False, "header_length": l4 + size, "payload_length": max(0, len(raw) - l4 - size)} | fields


def read(spark: SparkSession, path: str, keep_l2: bool = False) -> DataFrame:
    return pcap.read(spark, path, pattern=pcap.ANY_CAPTURE, decode=functools.partial(decode, keep_l2=keep_l2), schema=SCHEMA)


def _key() -> tuple[Column, Column]:
    """(kind of key, key without the start): addresses in text order, each port beside its own."""
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    turned = F.col("src_ip") != low
    near, far = F.when(turned, F.col("dst_port")).otherwise(F.col("src_port")), F.when(turned, F.col("src_port")).otherwise(F.col("dst_port"))
    kind = F.when(F.col("l2"), "L2").when(F.col("src_port") >= 0, "5T").otherwise("3T")
    text = F.when(F.col("l2"), F.concat_ws("_", "src_mac", "dst_mac", "ethertype")).when(F.col("src_port") >= 0, F.concat_ws("_", low, high, near, far, "protocol")).otherwise(F.concat_ws("_", low, high, "protocol"))
    return kind, text


def tables(df: DataFrame, min_pkts: int = 1, min_bytes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(flows, packets) of read(), with their source.  A flow is all of a file's packets with one key; its id
    ends with its first microsecond.  Packets of flows below the limits are ORPHAN_<their number>."""
    from ..functions import keys, labels

    kind, key = _key()
    p = df.where("skipped is null").withColumns({"key_type": kind, "key": key, "direction": F.when(F.col("l2"), 0).otherwise(keys.direction_01_canon())})
    by = ["source", "key_type", "key"]
    first = lambda c: F.min_by(c, "frame_index")
    turned = F.col("src_ip") > F.col("dst_ip")
    ends = {"src_ip": F.least("src_ip", "dst_ip"), "dst_ip": F.greatest("src_ip", "dst_ip"), "src_port": F.when(turned, F.col("dst_port")).otherwise(F.col("src_port")), "dst_port": F.when(turned, F.col("src_port")).otherwise(F.col("dst_port"))}
    f = p.groupBy(*by).agg(
        *(first(c).alias(n) for n, c in ends.items()), first("protocol").alias("protocol"), F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("byte_count"),
        F.min("t").alias("start_time"), F.max("t").alias("end_time"), (F.max("t") - F.min("t")).alias("duration"), first("ip_version").alias("ip_version"),
    ).where((F.col("packet_count") >= min_pkts) & (F.col("byte_count") >= min_bytes))
    f = f.withColumn("flow_id", F.concat_ws("_", "key_type", "key", (F.col("start_time") * 1e6).cast("long")))
    named = f.withColumns({"traffic_label": labels.debug_traffic(F.col("source")), "app_label": labels.debug_application(F.col("source")), "pcap_file": F.element_at(F.split("source", "/"), -1)})
    own = p.join(f.select(*by, "flow_id"), by, "left")
    own = own.withColumns({"key_type": F.when(F.col("flow_id").isNull(), "ORPHAN").otherwise(F.col("key_type")), "flow_id": F.coalesce("flow_id", F.concat(F.lit("ORPHAN_"), F.col("packet_index").cast("string")))})
    return named.select("source", *FLOW_COLUMNS), own.withColumn("timestamp", F.col("t")).select("source", *PACKET_COLUMNS)


def stats(df: DataFrame) -> DataFrame:
    """(source, dim, value, n): total, valid, error and l2_only packets, and counts by protocol, EtherType, IP
    version and reason of skipping."""
    valid, frame = F.col("skipped").isNull(), F.coalesce(F.col("skipped"), F.lit("")) != "end"
    dims = {
        "total_packets": F.when(frame, ""), "valid_packets": F.when(valid, ""), "error_packets": F.when(F.col("skipped").like("truncated%"), ""), "l2_only_packets": F.when(F.col("l2"), ""),
        "proto": F.when(valid & ~F.col("l2"), F.col("protocol").cast("string")), "ip_version": F.when(valid & ~F.col("l2"), F.col("ip_version").cast("string")),
        "ethertype": F.concat(F.lit("0x"), F.lower(F.hex("ethertype"))), "reason": F.when(frame & F.col("skipped").isNotNull(), F.col("skipped")).when(F.col("l2"), "non_ip_ethertype"),
    }
    long = df.select("source", F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), c.alias("value")) for n, c in dims.items()))).alias("d")).select("source", "d.*")
    return long.where("value is not null").groupBy("source", "dim", "value").agg(F.count(F.lit(1)).alias("n"))
