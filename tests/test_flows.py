import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions import casts, keys, labels
from packetloom.operators import flows, learning as ml
from packetloom.sources import pcap

#: Two flows, as (flow, t, length, payload, direction): gaps of 2, 2, 40, 2, 2, 2 ms in the first; none in the second.
ROWS = [
    ("a", 5.000, 60, 0, 1), ("a", 5.002, 60, 0, 1), ("a", 5.004, 1400, 1340, 1), ("a", 5.044, 900, 840, 1), ("a", 5.046, 52, 0, -1), ("a", 5.048, 52, 0, -1), ("a", 5.050, 700, 640, 1),
    ("b", 9.0, 77, 25, -1),
]


@pytest.fixture(scope="module")
def packets(spark):
    return spark.createDataFrame([(f, i, *p) for i, (f, *p) in enumerate(ROWS)], "flow_id string, frame_index long, t double, packet_length int, payload_length int, direction int")


def plain(rows, alpha=1.0, fixed=None):
    """Burst numbers, one packet after another."""
    gaps = [0.0, *(max(0.0, b[1] - a[1]) for a, b in zip(rows, rows[1:]))]
    above = [g for g in gaps if g > 0]
    limit = fixed if fixed is not None else (np.median(above) + alpha * (np.quantile(above, 0.75) - np.quantile(above, 0.25)) if above else 0.0)
    out = [0]
    for a, b, g in zip(rows, rows[1:], gaps[1:]):
        out.append(out[-1] + (a[4] != b[4] or g > limit))
    return out


@pytest.mark.parametrize("options", [{}, {"fixed": 0.01}, {"fixed": 0.001}, {"alpha": 100.0}])
def test_bursts(packets, options):
    got = flows.observed(packets, ["flow_id"], 64, **options).orderBy("flow_id", "pos").collect()
    for f in "ab":
        assert [r.burst for r in got if r.flow_id == f] == plain([r for r in ROWS if r[0] == f], **options)


def test_burst_and_packet_rows(packets):
    seen = flows.observed(packets, ["flow_id"], 64, fixed=0.01)
    b = {(r.flow_id, r.burst): r for r in flows.burst_rows(seen, ["flow_id"], 3).collect()}
    # three packets, one alone, two back, and a fourth burst beyond the cap
    assert {k: (r.packet_count, r.byte_sum, r.burst_direction, r.is_first, r.is_last) for k, r in b.items()} == {
        ("a", 0): (3, 1520, 1, 1, 0), ("a", 1): (1, 900, 1, 0, 0), ("a", 2): (2, 104, -1, 0, 1), ("b", 0): (1, 77, -1, 1, 1),
    }
    assert b["a", 1].gap == pytest.approx(0.04) and b["a", 0].mean_iat == pytest.approx(0.002) and b["a", 0].std_iat == pytest.approx(0, abs=1e-9)
    p = flows.packet_rows(seen, ["flow_id"]).where("flow_id = 'a'").orderBy("pos").collect()
    assert [(r.pos_in_burst, r.burst_size, r.is_burst_end) for r in p] == [(0, 3, 0), (1, 3, 0), (2, 3, 1), (0, 1, 1), (0, 2, 0), (1, 2, 1), (0, 1, 1)]


def test_prefix_comes_first(packets):
    # behind the cut there is nothing: the third packet of the burst doesn't count
    rows = flows.packet_rows(flows.observed(packets, ["flow_id"], 2), ["flow_id"]).where("flow_id = 'a'").collect()
    assert [r.burst_size for r in rows] == [2, 2]


def test_sessions(spark):
    rows = [("f", 1, 0.0, 0), ("f", 2, 61.0, 0), ("f", 3, 62.0, 1), ("f", 4, 62.1, 0), ("f", 5, 122.1, 4), ("f", 6, 10.0, 0), ("f", 7, 5.0, 0), ("g", 1, 500.0, 0)]
    df = spark.createDataFrame(rows, "flow string, frame long, t double, flags int").withColumn("protocol", F.lit(6))
    got = flows.sessionize(df, ["flow"], "frame", "t", "flags", "protocol", 60.0).orderBy("flow", "frame").collect()
    assert [r.session for r in got] == [0, 1, 1, 2, 2, 3, 3, 0]


def test_one_shuffle(packets):
    plan = flows.burst_rows(flows.observed(packets, ["flow_id"], 64), ["flow_id"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_labels(spark):
    want = {
        "caps/2020/tor/web/run7_packets.csv": ("TOR", "BROWSING"), "tormail.pcap": ("TOR", "EMAIL"), "x/NonTOR_p2p_3.csv": ("NONTOR", "P2P"), "non-vpn/skype call.csv": ("NONVPN", "VOIP"),
        "quic/im.csv": ("QUIC", "CHAT"), "storage/notes.csv": ("OTHER", "UNKNOWN"), "myvpn/transfer-1.csv": ("VPN", "FILE"), "C:\\caps\\tor\\audio.csv": ("TOR", "AUDIO"),
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r.path: (r.p, r.a) for r in df.select("path", labels.primary(F.col("path")).alias("p"), labels.application(F.col("path")).alias("a")).collect()}
    assert got == want


def test_casts(spark):
    df = spark.createDataFrame([("18",), ("0x18",), ("A",), ("1e2",), ("24d",), ("x",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(casts.tcp_flags(F.col("x"))).collect()] == [18.0, 24.0, 10.0, 100.0, 0x24D, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(casts.first_number(F.col("x"), default=7)).collect()] == [18.0, 7.0, 7.0, 100.0, 7.0, 7.0, 7.0, 7.0]


def test_keys(spark):
    df = spark.createDataFrame([("10.0.0.2", "10.0.0.1", 80, 5, 6), ("10.0.0.1", "10.0.0.2", 5, 80, 6), ("a", "b", -1, -1, 1), ("", "b", 1, 2, 17)], "s string, d string, sp int, dp int, p int")
    got = [r[0] for r in df.select(keys.flow_key(*(F.col(c) for c in ("s", "d", "sp", "dp", "p")))).collect()]
    assert got == ["5T_10.0.0.1_10.0.0.2_5_80_6"] * 2 + ["3T_a_b_1", "P_17"]


def test_splits(spark):
    rows = [(f"cap{i % 23:02d}", (i * i) % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, label int")
    got = {r.g: r.split for r in ml.group_split(df, "g", "label", 0.2, 0.1).collect()}
    v, t = ml.split_counts(23, 0.2, 0.1)
    assert [list(got.values()).count(x) for x in ("val", "test", "train")] == [v, t, 23 - v - t]
    order = sorted(got, key=lambda g: hashlib.md5(f"42:{g}".encode()).hexdigest())
    assert [got[g] for g in order] == ["test"] * t + ["val"] * v + ["train"] * (23 - v - t)
    for n, x, y in ((3, 0.5, 0.49), (3, 0.49, 0.5), (4, 0.45, 0.45), (5, 0.0, 0.9), (6, 0.9, 0.0)):
        own = [r.split for r in ml.group_split(df.where(F.col("g") < f"cap{n:02d}"), "g", "label", x, y).collect()]
        assert (own.count("val"), own.count("test")) == ml.split_counts(n, x, y)
    for make in (ml.group_split, ml.group_split_exact):
        with pytest.raises(Exception, match="three groups"):
            make(df.where("g < 'cap02'"), "g", "label").collect()


def test_exact_split_is_the_seeded_permutation(spark):
    rows = [(f"g{i % 11}", (i // 3) % 3) for i in range(200)]
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(x)
    order = sorted(by, key=lambda g: (max(sorted(set(by[g])), key=by[g].count), g))
    mixed = [order[i] for i in np.random.default_rng(5).permutation(len(order))]
    got = {r.g: r.split for r in ml.group_split_exact(spark.createDataFrame(rows, "g string, label int"), "g", "label", 0.3, 0.2, 5).collect()}
    v, t = ml.split_counts(11, 0.3, 0.2)
    assert got == {g: "test" if i < t else "val" if i < t + v else "train" for i, g in enumerate(mixed)}


def test_samples(spark):
    rows = [(s, f"{s}-{i}") for s, n in (("big", 400), ("small", 7), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:9] + [("big", None)], "source string, key string")
    count = lambda got: {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert count(ml.sample(df, "source", "key", 0.1, 7)) == {"big": 40, "small": 1, "one": 1}
    assert count(ml.sample(df, "source", "key", 0.1, 7, 20, 3)) == {"big": 20, "small": 3, "one": 1}
    got = sorted(r.key for r in ml.sample(df, "source", "key", 0.1, 7).where("source = 'big'").collect())
    assert got == sorted(sorted((k for s, k in rows if s == "big"), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())[:40])
    exact = {}
    for r in ml.sample_exact(df, "source", "key", 0.05, 11, 15).collect():
        exact.setdefault(r.source, []).append(r.key)
    own = sorted(k for s, k in rows if s == "big")
    assert sorted(exact["big"]) == sorted(own[i] for i in np.random.default_rng(11).choice(400, size=15, replace=False))
    assert len(exact["small"]) == 1 and ml.draw([], 0.5, 1) == []
    with pytest.raises(ValueError):
        ml.sample(df, "source", "key", 0.0, 7)


def test_auc(spark):
    r = np.random.default_rng(3)
    rows = [(bool(r.random() < 0.3), float(round(r.normal(), 1))) for _ in range(700)] + [(True, float("-inf")), (False, 1e300)]
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    df = spark.createDataFrame([*rows, (None, 1.0), (True, None)], "p boolean, s double")
    for parts in (512, 3):
        assert ml.auc(df, "p", "s", parts).first()[0] == pytest.approx(want)
    assert ml.auc(df.where("p"), "p", "s").first()[0] is None and ml.auc(df.limit(0), "p", "s").first()[0] is None


def ipv4(protocol, body, vlan=None, sip=b"\x0a\0\0\1", dip=b"\x0a\0\0\2"):
    ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0) + sip + dip
    tag = struct.pack("!HH", 0x8100, vlan) if vlan is not None else b""
    return b"\1" * 12 + tag + struct.pack("!H", 0x0800) + ip + body


TCP = struct.pack("!HHIIBBHHH", 1234, 443, 1, 2, 5 << 4, 0x11, 500, 0, 0) + b"x" * 20
UDP = struct.pack("!HHHH", 53, 5353, 0, 0) + b"y" * 32


def classic(frames):
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 7, i, len(f), len(f)) + f for i, f in enumerate(frames))


def blocks(frames):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for i, f in enumerate(frames):
        ticks = 7_000_000_000 + i * 1000
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def test_pcap(spark, tmp_path):
    ipv6 = b"\2" * 12 + struct.pack("!H", 0x86DD) + struct.pack("!IHBB", 6 << 28, 8 + len(UDP), 0, 9) + bytes(range(16)) * 2 + bytes([17, 0, 0, 0, 0, 0, 0, 0]) + UDP
    frames = [ipv4(6, TCP), ipv4(17, UDP, vlan=5), ipv6, b"\3" * 30, ipv4(6, TCP)[14:]]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    (tmp_path / "sub" / "b.PCAPNG").write_bytes(blocks(frames))
    (tmp_path / "c.pcap").write_bytes(classic(frames)[:-3])
    (tmp_path / "notes.pcap.txt").write_text("no")
    df = pcap.read(spark, str(tmp_path)).persist()
    for name in ("a.pcap", "b.PCAPNG"):
        own = df.where(F.col("source").endswith(name)).where("skipped is null or skipped <> 'end'").orderBy("frame_index").collect()
        assert [(r.ts_us, r.protocol, r.payload_length, r.src_port, r.vlan_id, r.ip_version) for r in own[:3]] == [(7_000_000, 6, 20, 1234, -1, 4), (7_000_001, 17, 32, 53, 5, 4), (7_000_002, 17, 32, 53, -1, 6)]
        assert own[0].tcp_flags == 0x11 and own[0].src_ip == "10.0.0.1" and own[2].src_ip == "0001:0203:0405:0607:0809:0a0b:0c0d:0e0f"
        assert own[3].skipped == "non_ip_ethertype" and own[4].src_port == 1234 and own[4].ether_type == 0x0800
    status = {r.source.rsplit("/", 1)[1]: (r.packets, r.skipped, r.error) for r in pcap.source_status(df).collect()}
    assert status["a.pcap"] == (4, 1, None) and status["c.pcap"][0] == 3 and "breaks off" in status["c.pcap"][2] and len(status) == 3
    assert pcap.packets(df).count() == 11


def test_payload_length():
    for protocol, header in ((6, 20), (6, 32), (17, 8), (1, 0)):
        for l4 in (34, 54):
            for size in (0, 1, 13):
                raw = bytearray(l4 + header + size + 6)  # six bytes of padding behind the packet
                if protocol == 6:
                    raw[l4 + 12] = header // 4 << 4
                assert pcap.payload_length(bytes(raw), l4, protocol, l4 + header + size) == size
                cut = bytes(raw[: l4 + max(header - 1, 0)])
                assert pcap.payload_length(cut, l4, protocol, l4 + header + size) == 0
    assert pcap.payload_length(bytes(100), 34, 6, 90) == 0  # a header of no length


def test_stream_equals_batch(spark, tmp_path):
    from packetloom.sources.tables import packets as view
    from packetloom.streaming.sessions import sessionize_stream

    rows = view(spark, "/root/testdata/sf0.001").select("flow_id", "frame_index", "t", F.col("tcp_flags").cast("int").alias("tcp_flags"), F.col("protocol").cast("int").alias("protocol"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sessionize_stream(stream, 86_400.0).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("sessions_out")
    want = flows.sessionize(rows, ["flow_id"], "frame_index", "t", "tcp_flags", "protocol", 86_400.0).select("flow_id", "frame_index", "session")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
