"""Captures as packet rows: pcap and pcapng files, decoded on the executors.

Files are read by Spark's binaryFile source, so any store that Spark reads will do; a file is one row (2 GB
at most) and is decoded where it is read, without a shuffle of its bytes.  A file that breaks off gives
the frames before the break and its error.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = (
    "source string, frame_index long, packet_index long, ts_us long, t double, packet_length int, payload_length int, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol int, ip_version int, ip_ttl int, tcp_flags int, tcp_window int, vlan_id int, ether_type int, skipped string, error string, decode_sec double"
)
#: Names of capture files, as a regular expression over the path; and the looser form of the second decoder.
CAPTURES, ANY_CAPTURE = r"(?i)\.pcap(ng)?$", r"\.pcap[^/]*$"
IPV4, IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8)
#: IPv6 extension headers that are walked over: hop-by-hop, routing, fragment, destination, authentication.
EXTENSIONS = (0, 43, 44, 60, 51)


def classic_frames(raw: bytes) -> Iterator[tuple[int, bytes]]:
    order = "<" if raw[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    (magic,) = struct.unpack_from(order + "I", raw)
    if magic not in (0xA1B2C3D4, 0xA1B23C4D):
        raise ValueError("not a capture file")
    unit, at = (1000 if magic == 0xA1B23C4D else 1), 24
    while at < len(raw):
        sec, sub, size, _ = struct.unpack_from(order + "IIII", raw, at)
        if at + 16 + size > len(raw):
            raise ValueError("the last frame breaks off")
        yield sec * 1_000_000 + sub // unit, raw[at + 16 : at + 16 + size]
        at += 16 + size


def _resolution(options: bytes, order: str) -> int:
    """Ticks in a second, from an interface's options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        if code == 0:
            break
        at += 4 + size + -size % 4
    return 1_000_000


def block_frames(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at, order, ticks = 0, "<", []
    while at + 12 <= len(raw):
        if raw[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, ticks = ("<" if raw[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", raw, at)
        if size < 12 or at + size > len(raw):
            raise ValueError("the last block breaks off")
        if kind == 1:
            ticks.append(_resolution(raw[at + 16 : at + size - 4], order))
        elif kind == 6:
            interface, high, low, caught = struct.unpack_from(order + "IIII", raw, at + 8)
            rate = ticks[interface] if interface < len(ticks) else 1_000_000
            yield (high << 32 | low) * 1_000_000 // rate, raw[at + 28 : at + 28 + caught]
        elif kind == 3:
            (length,) = struct.unpack_from(order + "I", raw, at + 8)
            yield 0, raw[at + 12 : at + 12 + min(length, size - 16)]
        at += size


def frames(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(microseconds, frame) of a capture of either kind."""
    return block_frames(raw) if raw[:4] == b"\x0a\x0d\x0d\x0a" else classic_frames(raw)


def link(raw: bytes) -> tuple[int, int, int]:
    """(EtherType or -1, start of the network header, VLAN id or -1): Ethernet with a tag or none, the
    cooked header of 16 bytes, or bare IP."""
    word = lambda i: int.from_bytes(raw[i : i + 2], "big")
    vlan = -1
    if len(raw) >= 18 and word(12) in VLAN_TAGS:
        vlan = word(14) & 0xFFF
    for need, at, start in ((18, 16, 18), (14, 12, 14), (16, 14, 16)):
        if len(raw) >= need and word(at) in (IPV4, IPV6) and (at != 16 or vlan >= 0):
            return word(at), start, vlan
    nibble = raw[0] >> 4 if raw else 0
    return {4: IPV4, 6: IPV6}.get(nibble, -1), 0, vlan


def transport_of_ipv6(raw: bytes, at: int) -> tuple[int, int]:
    """(protocol, start of its header) behind the extension headers."""
    kind, here = raw[at + 6], at + 40
    while kind in EXTENSIONS and here + 2 <= len(raw):
        if kind == 44 and here + 8 <= len(raw):
            size = 8
        else:
            size = (raw[here + 1] + 2) * 4 if kind == 51 else (raw[here + 1] + 1) * 8
        kind, here = raw[here], here + size
    return kind, here


def payload_length(raw: bytes, l4: int, protocol: int, end: int) -> int:
    """Bytes behind the transport header, up to the captured end of the IP packet."""
    end = min(len(raw), max(l4, end))
    header = 0
    if protocol == 17:
        header = 8
    elif protocol == 6:
        header = (raw[l4 + 12] >> 4) * 4 if end >= l4 + 20 else 0
        if header < 20:
            return 0
    return max(0, end - l4 - header)


def decode(raw: bytes) -> dict:
    """The fields of a frame; or only `skipped`, with the reason."""
    ether, at, vlan = link(raw)
    if not raw:
        return {"skipped": "empty"}
    if ether == IPV4 and len(raw) >= at + 20:
        size = (raw[at] & 15) * 4
        if size < 20 or len(raw) < at + size:
            return {"skipped": "truncated_ipv4"}
        protocol, l4, ttl, version = raw[at + 9], at + size, raw[at + 8], 4
        source, target = (".".join(str(b) for b in raw[at + i : at + i + 4]) for i in (12, 16))
        end = at + int.from_bytes(raw[at + 2 : at + 4], "big")
    elif ether == IPV6 and len(raw) >= at + 40:
        (protocol, l4), ttl, version = transport_of_ipv6(raw, at), raw[at + 7], 6
        source, target = (raw[at + i : at + i + 16].hex(":", 2) for i in (8, 24))
        end = at + 40 + int.from_bytes(raw[at + 4 : at + 6], "big")
    else:
        return {"skipped": "non_ip_ethertype" if ether == -1 else "truncated_ip"}
    ports = struct.unpack_from("!HH", raw, l4) if protocol in (6, 17) and len(raw) >= l4 + 4 else (-1, -1)
    tcp = protocol == 6 and len(raw) >= l4 + 20
    return {
        "packet_length": len(raw), "payload_length": payload_length(raw, l4, protocol, end), "src_ip": source, "dst_ip": target, "src_port": ports[0], "dst_port": ports[1],
        "protocol": protocol, "ip_version": version, "ip_ttl": ttl, "tcp_flags": raw[l4 + 13] if tcp else 0, "tcp_window": int.from_bytes(raw[l4 + 14 : l4 + 16], "big") if tcp else 0,
        "vlan_id": vlan, "ether_type": ether,
    }


def rows(source: str, raw: bytes, decode: Callable[[bytes], dict] = decode) -> Iterator[dict]:
    """A row for each frame; a last one, without a frame, with the seconds it took and the error if there was one."""
    kept, began, error = 0, time.monotonic(), None
    try:
        for index, (us, frame) in enumerate(frames(raw), 1):
            row = {"source": source, "frame_index": index, "packet_index": kept, "ts_us": us, "t": us / 1e6, **decode(frame)}
            kept += "skipped" not in row
            yield row
    except (ValueError, struct.error, IndexError) as e:
        error = str(e)
    yield {"source": source, "skipped": "end", "error": error, "decode_sec": time.monotonic() - began}


def read(spark: SparkSession, path: str, batch: int = 10_000, pattern: str = CAPTURES, decode: Callable[[bytes], dict] = decode, schema: str = SCHEMA) -> DataFrame:
    """Packet rows of all files below path whose names match.  Frames that are no packets have only
    `skipped`; each file has a last row, skipped as "end", with `decode_sec` and its `error`, if any."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(pattern))
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts):
        for part in parts:
            for source, raw in zip(part.column(0), part.column(1)):
                held = []
                for row in rows(source.as_py(), raw.as_py(), decode):
                    held.append(row)
                    if len(held) == batch:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kind)

    return files.select("path", "content").mapInArrow(run, schema)


def packets(df: DataFrame) -> DataFrame:
    return df.where("skipped is null")


def source_status(df: DataFrame) -> DataFrame:
    """One row for each file: packets, skipped frames, TCP and UDP packets, decode_sec, error."""
    kept, skipped = F.col("skipped").isNull(), F.coalesce(F.col("skipped"), F.lit("end")) != "end"
    return df.groupBy("source").agg(
        F.count_if(kept).alias("packets"), F.count_if(skipped).alias("skipped"), F.count_if(F.col("protocol") == 6).alias("tcp"), F.count_if(F.col("protocol") == 17).alias("udp"),
        F.max("decode_sec").alias("decode_sec"), F.max("error").alias("error"),
    )
