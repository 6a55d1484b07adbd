"""From files to features: captures, packet tables, sinks and commands."""

import csv
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_flows import TCP, UDP, classic, ipv4

from packetloom import cli, config
from packetloom.operators import baselines, networks as net
from packetloom.plans import build
from packetloom.sources import pcap, preserving, sinks, tabular


def rows_of(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def frames_at(times, frames):
    import struct

    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack("<IIII", int(t), round((t % 1) * 1e6), len(f), len(f)) + f for t, f in zip(times, frames))


@pytest.fixture
def captures(tmp_path):
    out = tmp_path / "caps"
    (out / "tor").mkdir(parents=True)
    (out / "vpn").mkdir()
    back = ipv4(6, TCP, sip=b"\x0a\0\0\2", dip=b"\x0a\0\0\1")  # FIN, the other way but the same ports
    tcp = ipv4(6, bytes(TCP[:13]) + b"\x10" + TCP[14:])
    # the third gap is over the timeout; behind the FIN a session begins
    (out / "tor" / "mail run.pcap").write_bytes(frames_at([1, 2, 3, 100, 101, 102], [tcp, tcp, ipv4(17, UDP), tcp, ipv4(6, TCP), tcp]))
    (out / "vpn" / "voip.PCAP").write_bytes(frames_at([5, 5.5, 6], [ipv4(17, UDP), back, ipv4(1, b"\x08\0\0\0ping")]))
    (out / "broken.pcap").write_bytes(b"no capture at all, but long enough")
    return out


def test_convert_and_build(spark, captures, tmp_path):
    out = tmp_path / "csv"
    cli.main(["convert", "--input_dir", str(captures), "--output_dir", str(out)], spark)
    flows = rows_of(out / "tor" / "mail run_flows.csv")
    tcp = [r for r in flows if r["protocol"] == "6"]
    assert sorted(r["flow_id"][-3:] for r in tcp) == ["_S0", "_S1", "_S2"] and sorted(r["packet_count"] for r in tcp) == ["1", "2", "2"]
    assert {r["key_type"] for r in rows_of(out / "vpn" / "voip_flows.csv")} == {"5T", "3T"}
    summary = {r.source: r for r in spark.read.csv(str(out / "summary"), header=True).collect()}
    assert summary["tor/mail run"].total_sessions == "4" and summary["tor/mail run"].udp_packets == "1" and summary["broken"].error == "not a capture file" and float(summary["vpn/voip"].elapsed_sec) >= 0

    feats = tmp_path / "features"
    (tmp_path / "manifest.csv").write_text("source_key,capture_group,application\nvoip_packets.csv,evening,\n")
    got = build.build_features(spark, str(out), str(feats), 4, 3, source_manifest=str(tmp_path / "manifest.csv"))
    assert got["num_samples"] == 7 and got["packet_shape"] == [7, 4, 16] and got["burst_shape"] == [7, 3, 12]
    assert json.loads((feats / "feature_summary.json").read_text())["label_mappings"]["primary"] == {"TOR": 0, "VPN": 1}
    df = build.load_features(spark, str(feats))
    rows = {r.sample_key: r for r in df.collect()}
    r = rows["mail run:5T_10.0.0.1_10.0.0.2_1234_443_6_S0"]
    assert (r.primary, r.application, r.capture_group) == ("TOR", "EMAIL", "tor/mail run_packets.csv") and r.packet_mask == [1, 1, 0, 0] and r.burst_mask == [1, 0, 0]
    assert [x[:5] for x in r.packet_seq[:2]] == [[74, 20, 1, 74, 0], [74, 20, 1, 74, 1]] and r.packet_seq[2] == [0] * 16
    assert r.packet_seq[1][5] == pytest.approx(math.log(2)) and r.burst_seq[0][:4] == [1, 2, 148, 1] and r.burst_seq[0][10:] == [1, 1]
    assert {(x.capture_group, x.application) for k, x in rows.items() if k.startswith("voip")} == {("evening", "VOIP")}
    with pytest.raises(ValueError, match="other shapes"):
        df.withColumn("packet_mask", F.slice("packet_mask", 1, 3)).write.parquet(str(tmp_path / "bad" / "samples"))
        build.load_features(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="has no"):
        df.drop("burst_mask").write.parquet(str(tmp_path / "worse" / "samples"))
        build.load_features(spark, str(tmp_path / "worse"))


def test_scans(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+1_packets.csv").write_text("flow_id,time,len,direction\nf,2.5,10,-1\nf,1.5,oops,1\n")
    (tmp_path / "y_packets.csv").write_text("len,flow_id,timestamp,src_ip,src_port,dst_ip,dst_port,proto,flags\n7,f,1,a,1,b,2,6,0x18\n8,f,2,b,2,a,1,6,A\n9,f,3,c,9,a,1,6,1\n")
    got = {(r.source_key, r.t): r for r in tabular.packet_table(spark, str(tmp_path)).collect()}
    assert got["a b/x+1_packets.csv", 2.5].direction == -1 and got["a b/x+1_packets.csv", 1.5].packet_length == 0
    assert got["y_packets.csv", 1].direction is None and got["y_packets.csv", 1].tcp_flags == 24 and got["y_packets.csv", 2].tcp_flags == 10
    seq = {r.source_key: [v[2] for v in r.packet_seq] for r in build.sequences(tabular.packet_table(spark, str(tmp_path)), 4, 2).collect()}
    assert seq == {"a b/x+1_packets.csv": [1, -1, 0, 0], "y_packets.csv": [1, -1, -1, 0]}
    with pytest.raises(FileNotFoundError):
        tabular.packet_table(spark, str(tmp_path / "a b"), "*_nothing.csv")
    (tmp_path / "z_packets.csv").write_text("id,len\n1,2\n")
    with pytest.raises(ValueError, match="no column flow_id"):
        tabular.packet_table(spark, str(tmp_path))
    assert tabular.scan(spark, str(tmp_path), "*_packets.csv", skip=True).count() == 5


def test_paired_tables(spark, tmp_path):
    (tmp_path / "vpn_music.csv").write_text("flow_id,n\nf,1\nf,2\n")
    (tmp_path / "vpn_music.pkt.csv").write_text("flow_id,timestamp,packet_length\nf,1,100\nf,2,200\nother,3,4\n")
    (tmp_path / "web.csv").write_text("flow_id,n,class_label\ng,1,TOR\n")
    (tmp_path / "notes.csv").write_text("text\nhello\n")
    f, p = tabular.paired_beside(spark, str(tmp_path))
    assert sorted((r.source, r.flow_id, r.class_label, r.activity_label) for r in f.collect()) == [("vpn_music", "f", "VPN", "AUDIO")] * 2 + [("web", "g", "TOR", "BROWSING")]
    assert sorted((r.source, r.flow_id, r.packet_length) for r in p.collect()) == [("vpn_music", "f", "100"), ("vpn_music", "f", "200")]
    cli.main(["frames20", "--input_dir", str(tmp_path), "--output_dir", str(tmp_path / "out"), "--max_seq_len", "5"], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "segments")).count() == 6 and sorted(r.variant_id for r in spark.read.parquet(str(tmp_path / "out" / "flows")).collect()) == [0, 0, 1]


def test_sampling_files(spark, tmp_path):
    src = tmp_path / "in" / "day"
    src.mkdir(parents=True)
    with (src / "c_flows.csv").open("w") as f, (src / "c_packets.csv").open("w") as g:
        f.write("flow_id,start_time\n" + "".join(f"f{i},{i}\n" for i in range(40)))
        g.write("flow_id,timestamp\n" + "".join(f"f{i % 40},{i}\n" for i in range(120)))
    for exact in ([], ["--exact"]):
        out = tmp_path / f"out{len(exact)}"
        cli.main(["sample", "--input_dir", str(tmp_path / "in"), "--output_dir", str(out), "--ratio", "0.2", "--max_flows_per_file", "6", *exact], spark)
        ids = {r["flow_id"] for r in rows_of(out / "day" / "c_flows.csv")}
        packets = rows_of(out / "day" / "c_packets.csv")
        assert len(ids) == 6 and len(packets) == 18 and {r["flow_id"] for r in packets} == ids
        m = spark.read.csv(str(out / "sampling_manifest"), header=True).first()
        assert (m.source, m.flows_before, m.flows_after, m.packets_after) == ("day/c", "40", "6", "18") and set(m.selected_flow_ids.split("|")) == ids
    (src / "d_flows.csv").write_text("flow_id\nx\n")
    with pytest.raises(FileNotFoundError):
        tabular.paired_flows(spark, str(tmp_path / "in"))


def test_preserving(spark, tmp_path):
    gre = ipv4(47, b"\0\0\x08\0" + b"g" * 9)
    double = b"\1" * 12 + b"\x81\0\0\x05\x88\xa8\0\x07" + gre[12:]
    arp = b"\xff" * 6 + b"\2" * 6 + b"\x08\x06" + b"arp" * 10
    v6 = b"\2" * 12 + b"\x86\xdd\x60\0\0\0" + len(UDP).to_bytes(2, "big") + b"\x3a\x40" + bytes(16) + bytes(range(16)) + b"\x80\x03" + UDP
    (tmp_path / "nonvpn_chat.pcap").write_bytes(classic([double, arp, b"short", v6, ipv4(6, TCP), ipv4(6, TCP, sip=b"\x0a\0\0\2", dip=b"\x0a\0\0\1"), ipv4(50, b"\0\0\x01\x01" + b"e" * 8)[:40]]))
    for keep in (False, True):
        frames = preserving.read(spark, str(tmp_path), keep).persist()
        f, p = preserving.tables(frames)
        rows = {r.packet_index: r for r in p.collect()}
        assert sorted(rows) == list(range(len(rows))) and len(rows) == 5 + keep
        assert (rows[0].vlan_ids, rows[0].gre_protocol, rows[0].header_length, rows[0].payload_length, rows[0].src_mac) == ("5|7", 0x800, 46, 9, "01:01:01:01:01:01")
        assert rows[0].flow_id.startswith("3T_10.0.0.1_10.0.0.2_47_7000000")
        v6_row = rows[1 + keep]
        assert (v6_row.icmp_type, v6_row.icmp_code, v6_row.ip_version, v6_row.ip_ttl) == (128, 3, 6, 0)
        assert rows[2 + keep].tcp_flags == 0x11 and rows[2 + keep].direction == 0 and rows[3 + keep].direction == 1
        if keep:
            assert rows[1].key_type == "L2" and rows[1].flow_id.startswith("L2_02:02:02:02:02:02_ff:ff:ff:ff:ff:ff_2054_") and rows[1].header_length == 14
        assert {(r.traffic_label, r.app_label, r.pcap_file) for r in f.collect()} == {("NONVPN", "CHAT", "nonvpn_chat.pcap")}
        s = {(r.dim, r.value): r.n for r in preserving.stats(frames).collect()}
        assert s["total_packets", ""] == 7 and s["valid_packets", ""] == 5 + keep and s["reason", "truncated_eth"] == 1 and s["reason", "non_ip_ethertype"] == 1 and s["l2_only_packets", ""] == 1 and s["ethertype", "0x806"] == 1
        _, few = preserving.tables(frames, min_pkts=2)
        assert {r.flow_id for r in few.where("key_type = 'ORPHAN'").collect()} == {f"ORPHAN_{i}" for i in range(5 + keep)}
    cli.main(["preserve", "--input_dir", str(tmp_path), "--output_dir", str(tmp_path / "out"), "--keep_l2"], spark)
    assert spark.read.csv(str(tmp_path / "out" / "packets"), header=True).count() == 6


def test_splits_and_normaliser_are_kept(spark, tmp_path):
    r = np.random.default_rng(2)
    data = []
    for i in range(60):
        n = int(r.integers(1, 4))
        label = i % 2
        seq = [[float(label * 50 + r.integers(1, 20)), *map(float, r.integers(0, 9, 15))] if k < n else [0.0] * 16 for k in range(4)]
        bursts = [[float(x) for x in r.integers(0, 9, 12)], [0.0] * 12]
        data.append((f"s{i}", f"g{i % 12}", ("NONTOR", "TOR")[label], "CHAT", label, 0, label, seq, [float(k < n) for k in range(4)], bursts, [1.0, 0.0]))
    names = "sample_key string, capture_group string, primary string, application string, primary_id long, secondary_id long, combined_id long, packet_seq array<array<float>>, packet_mask array<float>, burst_seq array<array<float>>, burst_mask array<float>"
    df = spark.createDataFrame(data, names)
    folder = str(tmp_path / "f")
    df.write.parquet(folder + "/samples")
    stats = build.fit_normaliser(df)
    valid = np.array([v for d in data for v, m in zip(d[7], d[8]) if m])
    assert stats["packet_seq"]["mean"][0] == pytest.approx(valid[:, 0].mean(), rel=1e-6) and stats["packet_seq"]["std"][0] == pytest.approx(valid[:, 0].std(), rel=1e-6)
    assert stats["packet_seq"]["mean"][2] == 0 and stats["packet_seq"]["std"][2] == 1
    sinks.save_json(spark, str(tmp_path / "n.json"), stats)
    assert sinks.load_json(spark, str(tmp_path / "n.json")) == stats
    done = build.normalise(df, stats).orderBy("sample_key").first()
    own = next(d for d in data if d[0] == done.sample_key)
    mean, std = (np.array(stats["packet_seq"][k]) for k in ("mean", "std"))
    assert np.allclose(done.packet_seq, (np.array(own[7]) - mean) / std * np.array(own[8])[:, None], atol=1e-5)

    split = str(tmp_path / "split")
    cli.main(["split", "--features_dir", folder, "--split_file", split, "--exact"], spark)
    groups, seed = sinks.load_split(spark, split)
    assert seed == 42 and groups.count() == 12 and json.loads((tmp_path / "split.json").read_text())["splits"]["test"]["groups"] == 2
    (tmp_path / "e.yaml").write_text(f"experiment_id: try-1  # a name\ntask: tor_binary\nfusion: gated\nloss: focal\nfeatures_dir: {folder}\nsplit_file: {split}\n")
    cli.main(["run", "--config", str(tmp_path / "e.yaml"), "--output_dir", str(tmp_path / "runs")], spark)
    m = json.loads((tmp_path / "runs" / "try-1" / "metrics.json").read_text())
    assert m["accuracy"] > 0.9 and set(m["per_class"]) == {"NONTOR", "TOR"} and m["sample_count"] == 10
    p = spark.read.csv(str(tmp_path / "runs" / "try-1" / "predictions"), header=True)
    assert p.columns == ["sample_key", "true_id", "true_label", "pred_id", "pred_label", "prob_NONTOR", "prob_TOR"] and p.count() == 10


def test_configuration():
    good = {"experiment_id": "a.b-1", "task": "application8", "fusion": "concat", "loss": "cross_entropy", "features_dir": "f", "split_file": "/s"}
    got = config.check(good, "/root/x")
    assert got["features_dir"] == "/root/x/f" and got["split_file"] == "/s" and got["seed"] == 42
    for bad in ({"experiment_id": "../x"}, {"task": "x"}, {"fusion": "x"}, {"loss": "x"}):
        with pytest.raises(ValueError):
            config.check(good | bad)
    with pytest.raises(ValueError, match="missing"):
        config.check({"task": "tor_binary"})
    assert [config.scalar(x) for x in ("true", "null", "3", "0.5", "'x'", "plain")] == [True, None, 3, 0.5, "x", "plain"]


def test_network_forward(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(5, 6, 16)), r.normal(size=(5, 3, 12))
    mx, my = (r.random((5, 6)) < 0.7).astype(float), np.ones((5, 3))
    mx[:, 0] = 1
    p = net.weights(16, 12, 4, seed=3)
    got = net.features(p, x, y, mx, my)
    # what lies behind the mask makes no difference to the packets' pool, and each sample is its own
    one = net.features(p, x[2:3], y[2:3], mx[2:3], my[2:3])
    assert np.allclose(got[2:3], one)
    # the recurrence, step by step
    n, s = "packet.0", np.zeros(16)
    e = net.linear(p, "packet.embed", x[:1])
    inner = net.linear(p, f"{n}.in", net.depthwise(net.rms_norm(e, p[f"{n}.norm"]), p[f"{n}.conv"], p[f"{n}.conv_bias"]))[0]
    out = []
    for t in range(6):
        s = p[f"{n}.A"] @ s + p[f"{n}.B"] @ inner[t, :32]
        out.append(p[f"{n}.C"] @ s * mx[0, t] / (1 + np.exp(-inner[t, 32:])))
    assert np.allclose(net.recurrent_block(p, n, e, mx[:1])[0], e[0] + np.array(out) @ p[f"{n}.out.w"].T + p[f"{n}.out.b"])
    # a masked key gets no attention
    z = r.normal(size=(1, 3, 32))
    far = z.copy()
    far[0, 2] += 100
    m = np.array([[1.0, 1.0, 0.0]])
    assert np.allclose(net.self_attention(p, "burst.0", z, m, 4)[0, :2], net.self_attention(p, "burst.0", far, m, 4)[0, :2])
    assert np.allclose(net.positions(3, 4)[1], [math.sin(1), math.cos(1), math.sin(0.01), math.cos(0.01)])
    assert np.allclose(net.features(p, x, y, mx, my[:, :1]), got) and net.features(p, x, y[:, 0]).shape == (5, 32)
    a, b = r.normal(size=(2, 32)), r.normal(size=(2, 32))
    assert np.allclose(net.fuse(p, a, b, "micro_only"), net.linear(p, "fuse.packet", a)) and np.allclose(net.fuse(p, a, b, "fixed", 0.0), net.fuse(p, a, b, "burst_only")) and net.fuse(p, a, b, "concat").shape == (2, 32)
    for bad in (lambda: net.features(p, x, y, mx[:, :4], my), lambda: net.features(p, x[0], y)):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(f"s{i}", x[i].tolist(), mx[i].tolist(), y[i].tolist(), my[i].tolist()) for i in range(5)], "sample_key string, packet_seq array<array<double>>, packet_mask array<double>, burst_seq array<array<double>>, burst_mask array<double>")
    rows = {q.sample_key: q for q in net.score(df, p).collect()}
    assert all(np.allclose(rows[f"s{i}"].scores, net.head(p, got)[i]) and rows[f"s{i}"].pred_id == net.head(p, got)[i].argmax() for i in range(5))


def test_baselines(spark):
    r = np.random.default_rng(4)
    data = [(f"k{i}", int(i % 4 == 0), [float(x) for x in [i % 4 == 0, r.normal(), 0.0] + r.normal(0, 0.3, 3)]) for i in range(300)]
    df = spark.createDataFrame(data, "k string, y int, f array<double>")
    train, test = baselines.prepare(df, "f", "y", "k")
    assert {x.y: x["count"] for x in test.groupBy("y").count().collect()} == {0.0: 45, 1.0: 15}
    logistic, forest = baselines.evaluate(train, test), baselines.evaluate(train, test, "forest", 20)
    assert logistic["accuracy"] >= 0.9 and logistic["auc"] > 0.95 and forest["auc"] > 0.9
    assert forest["importance"][0][0] == 0 and len(forest["importance"]) <= 10
    assert pd.Series([x for _, x in forest["importance"]]).is_monotonic_decreasing
    assert pcap.CAPTURES
