"""The registered queries over the shared tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import casts, keys, labels
from ..operators import flows, learning as ml, micro
from ..sources import pcap, preserving
from ..sources.tables import decoded, frames, packets, table
from . import build

FLOW, ORDER = ["flow_id"], ["t", "frame_index"]
SESSION = ["flow_id", "session"]
#: The event table's gaps are hours, so the customary 60 s, 5 s / 2.5 s and 64 packets are scaled.
TIMEOUT, WIDTH, HOP, PREFIX, BURSTS = 86_400.0, 432_000.0, 216_000.0, 32, 16

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, alias: str | None = None):
    name = alias or (c if isinstance(c, str) else None)
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name) if name else out


P = """p AS (
  SELECT user_id AS flow_id, event_id AS frame_index, epoch_us(ts) / 1e6 AS t, value AS packet_length,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS payload_length,
    CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE -1 END AS direction,
    CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 4 ELSE 16 END AS tcp_flags,
    CASE WHEN user_id % 3 <> 0 THEN 6 ELSE 17 END AS protocol,
    '10.0.0.' || (user_id % 250) AS client, '10.0.1.' || (user_id % 7) AS server,
    CASE WHEN event_type = 'signup' THEN 0 ELSE 1024 + user_id % 1000 END AS near
  FROM events
), e AS (
  SELECT *, CASE WHEN direction = 1 THEN client ELSE server END AS src_ip, CASE WHEN direction = 1 THEN server ELSE client END AS dst_ip,
    CASE WHEN direction = 1 THEN near ELSE 443 END AS src_port, CASE WHEN direction = 1 THEN 443 ELSE near END AS dst_port FROM p
)"""
S = P + """, s0 AS (
  SELECT *, lag(t) OVER w AS lt, lag(tcp_flags) OVER w AS lf FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY frame_index)
), s AS (
  SELECT *, CAST(sum(CASE WHEN lt IS NOT NULL AND ((protocol = 6 AND (lf & 5) <> 0) OR t - lt > 86400.0) THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s0
)"""
B = S + """, x0 AS (
  SELECT *, row_number() OVER (PARTITION BY flow_id, session ORDER BY t, frame_index) - 1 AS pos FROM s
), x1 AS (
  SELECT *, greatest(0.0::DOUBLE, coalesce(t - lag(t) OVER w, 0.0::DOUBLE)) AS iat, lag(direction) OVER w AS ld FROM x0 WHERE pos < 32 WINDOW w AS (PARTITION BY flow_id, session ORDER BY pos)
), x2 AS (
  SELECT *, coalesce(quantile_cont(iat, 0.5) FILTER (iat > 0) OVER w + 1.0::DOUBLE * (quantile_cont(iat, 0.75) FILTER (iat > 0) OVER w - quantile_cont(iat, 0.25) FILTER (iat > 0) OVER w), 0.0::DOUBLE) AS threshold
  FROM x1 WINDOW w AS (PARTITION BY flow_id, session)
), b AS (
  SELECT *, CAST(sum(CASE WHEN ld IS NOT NULL AND (direction <> ld OR iat > threshold) THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id, session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM x2
)"""


def sessions(spark, sf):
    return flows.sessionize(packets(spark, sf), FLOW, "frame_index", "t", "tcp_flags", "protocol", TIMEOUT)


def observed(spark, sf):
    return flows.observed(sessions(spark, sf), SESSION, PREFIX)


@query(f"WITH {P} SELECT flow_id, frame_index, round(t, 6) AS t, packet_length, payload_length, direction, tcp_flags, protocol FROM p")
def q_packets(spark, sf):
    return packets(spark, sf).select("flow_id", "frame_index", r6("t"), "packet_length", "payload_length", "direction", "tcp_flags", "protocol")


FLOWS_SQL = "SELECT flow_id, count(*) AS packet_count, round(sum(packet_length), 4) AS byte_count, round(min(t), 6) AS start_time, round(max(t), 6) AS end_time, round(max(t) - min(t), 6) AS duration, arg_min(protocol, frame_index) AS protocol FROM p WHERE flow_id IS NOT NULL GROUP BY flow_id"


def _flow_rows(spark, sf):
    out = flows.flow_rows(packets(spark, sf), FLOW)
    return out.select("flow_id", "packet_count", F.round("byte_count", 4).alias("byte_count"), r6("start_time"), r6("end_time"), r6("duration"), "protocol")


@query(f"WITH {P} {FLOWS_SQL}")
def q_flow_agg(spark, sf):
    return _flow_rows(spark, sf)


@query(f"WITH {P} SELECT * FROM ({FLOWS_SQL}) WHERE packet_count >= 60 AND byte_count >= 1000")
def q_flow_filter(spark, sf):
    return _flow_rows(spark, sf).where("packet_count >= 60 and byte_count >= 1000")


@query(f"WITH {P} SELECT protocol, count(*) AS packets FROM p GROUP BY protocol")
def q_protocol_count(spark, sf):
    return packets(spark, sf).groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))


@query(f"WITH {P}, g AS (SELECT *, greatest(0.0::DOUBLE, coalesce(t - lag(t) OVER (PARTITION BY flow_id ORDER BY t, frame_index), 0.0::DOUBLE)) AS iat FROM p) SELECT flow_id, frame_index, round(iat, 6) AS iat, round(packet_length * direction, 6) AS signed_length, round(ln(1 + iat), 6) AS log_iat FROM g")
def q_iat(spark, sf):
    return flows.gaps(packets(spark, sf), FLOW, ORDER).select("flow_id", "frame_index", r6("iat"), r6(F.col("packet_length") * F.col("direction"), "signed_length"), r6(F.log1p("iat"), "log_iat"))


@query(f"""WITH {P}, f AS (SELECT *, first_value(src_ip) OVER w AS a, first_value(src_port) OVER w AS ap, first_value(dst_ip) OVER w AS b, first_value(dst_port) OVER w AS bp FROM e WINDOW w AS (PARTITION BY flow_id ORDER BY t, frame_index))
SELECT flow_id, frame_index, CASE WHEN src_ip = a AND src_port = ap AND dst_ip = b AND dst_port = bp THEN 1 WHEN src_ip = b AND src_port = bp AND dst_ip = a AND dst_port = ap THEN -1 WHEN src_ip = a THEN 1 ELSE -1 END AS dir_pm1,
CASE WHEN src_ip = a AND src_port = ap THEN 0 ELSE 1 END AS dir_01_first, CASE WHEN src_ip <= dst_ip THEN 0 ELSE 1 END AS dir_01_canon FROM f""")
def q_direction(spark, sf):
    return packets(spark, sf).select("flow_id", "frame_index", keys.direction_pm1(FLOW, ORDER).alias("dir_pm1"), keys.direction_01_first(FLOW, ORDER).alias("dir_01_first"), keys.direction_01_canon().alias("dir_01_canon"))


KEY_SQL = "CASE WHEN src_port <> -1 THEN '5T_' || least(src_ip, dst_ip) || '_' || greatest(src_ip, dst_ip) || '_' || CASE WHEN src_ip <= dst_ip THEN src_port || '_' || dst_port ELSE dst_port || '_' || src_port END || '_' || protocol ELSE '3T_' || least(src_ip, dst_ip) || '_' || greatest(src_ip, dst_ip) || '_' || protocol END"


def _keyed(spark, sf):
    # signups have no ports
    none = (F.col("src_port") == 0) | (F.col("dst_port") == 0)
    p = packets(spark, sf)
    p = p.withColumns({"src_port": F.when(none, -1).otherwise(F.col("src_port")), "dst_port": F.when(none, -1).otherwise(F.col("dst_port"))})
    return p.withColumn("key", keys.flow_key(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), F.col("protocol")))


NO_PORT = P + ", n AS (SELECT * EXCLUDE (src_port, dst_port), CASE WHEN near = 0 AND direction = 1 THEN -1 ELSE src_port END AS src_port, CASE WHEN near = 0 AND direction = 1 THEN -1 ELSE dst_port END AS dst_port FROM e), k AS (SELECT *, " + KEY_SQL + " AS key FROM n)"


@query(f"WITH {NO_PORT} SELECT frame_index, key, key[1:2] AS key_type FROM k")
def q_flow_key(spark, sf):
    return _keyed(spark, sf).select("frame_index", "key", F.substring("key", 1, 2).alias("key_type"))


@query(f"WITH {NO_PORT} SELECT key || '_' || CAST(floor(min(t) * 1e6) AS BIGINT) AS flow_key, count(*) AS packet_count, round(sum(packet_length), 4) AS byte_count FROM k GROUP BY key")
def q_flow_id_start(spark, sf):
    agg = _keyed(spark, sf).groupBy("key").agg(F.floor(F.min("t") * 1e6).alias("us"), F.count(F.lit(1)).alias("packet_count"), F.round(F.sum("packet_length"), 4).alias("byte_count"))
    return agg.select(F.concat_ws("_", "key", F.col("us").cast("string")).alias("flow_key"), "packet_count", "byte_count")


@query(f"WITH {P} SELECT flow_id, frame_index, pos FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY t, frame_index) - 1 AS pos FROM p) WHERE pos < 32")
def q_prefix(spark, sf):
    return flows.prefix(packets(spark, sf), FLOW, ORDER, PREFIX).select("flow_id", "frame_index", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {S} SELECT flow_id, frame_index, session FROM s")
def q_sessions(spark, sf):
    return sessions(spark, sf).select("flow_id", "frame_index", "session")


@query(f"WITH {B} SELECT DISTINCT flow_id, session, round(threshold, 6) AS threshold FROM b")
def q_adaptive_threshold(spark, sf):
    rows = flows.gaps(flows.prefix(sessions(spark, sf), SESSION, ORDER, PREFIX), SESSION, ["pos"])
    return rows.groupBy(*SESSION).agg(r6(flows.threshold(F.col("iat"), 1.0), "threshold"))


@query(f"WITH {B} SELECT flow_id, session, burst, min(pos) AS first_pos, max(pos) + 1 AS end_pos FROM b GROUP BY ALL")
def q_bursts(spark, sf):
    return observed(spark, sf).groupBy(*SESSION, "burst").agg(F.min("pos").cast("long").alias("first_pos"), (F.max("pos") + 1).cast("long").alias("end_pos"))


BURST_COLUMNS = ("byte_sum", "duration", "mean_len", "std_len", "mean_iat", "std_iat", "max_iat", "gap")


@query(f"""WITH {B}, a AS (SELECT flow_id, session, burst, arg_min(direction, pos) AS burst_direction, count(*) AS packet_count, sum(packet_length) AS byte_sum, max(t) - min(t) AS duration, avg(packet_length) AS mean_len, stddev_pop(packet_length) AS std_len,
  coalesce(avg(iat) FILTER (iat > 0), 0) AS mean_iat, coalesce(stddev_pop(iat) FILTER (iat > 0), 0) AS std_iat, max(iat) AS max_iat, arg_min(iat, pos) AS gap FROM b GROUP BY ALL), m AS (SELECT *, max(burst) OVER (PARTITION BY flow_id, session) AS many FROM a)
SELECT flow_id, session, burst, burst_direction, packet_count, {", ".join(f"round({c}, 6) AS {c}" for c in BURST_COLUMNS)}, CAST(burst = 0 AS INTEGER) AS is_first, CAST(burst = least(many, 15) AS INTEGER) AS is_last FROM m WHERE burst < 16""")
def q_burst_features(spark, sf):
    out = flows.burst_rows(observed(spark, sf), SESSION, BURSTS)
    return out.select(*SESSION, "burst", "burst_direction", "packet_count", *(r6(c) for c in BURST_COLUMNS), "is_first", "is_last")


@query(f"""WITH {B} SELECT flow_id, session, frame_index, pos, burst, row_number() OVER (PARTITION BY flow_id, session, burst ORDER BY pos) - 1 AS pos_in_burst, count(*) OVER w AS burst_size, round(sum(packet_length) OVER w, 6) AS burst_bytes,
CAST(pos = min(pos) OVER w AS INTEGER) AS is_burst_start, CAST(pos = max(pos) OVER w AS INTEGER) AS is_burst_end, round(max(t) OVER w - min(t) OVER w, 6) AS burst_duration, round(packet_length * direction, 6) AS signed_length, round(ln(1 + iat), 6) AS log_iat
FROM b WINDOW w AS (PARTITION BY flow_id, session, burst)""")
def q_packet_features(spark, sf):
    out = flows.packet_rows(observed(spark, sf), SESSION)
    return out.select(*SESSION, "frame_index", F.col("pos").cast("long").alias("pos"), "burst", F.col("pos_in_burst").cast("long").alias("pos_in_burst"), "burst_size", r6("burst_bytes"), "is_burst_start", "is_burst_end", r6("burst_duration"), r6(F.col("packet_length") * F.col("direction"), "signed_length"), r6(F.log1p("iat"), "log_iat"))


H = P + """, h0 AS (SELECT *, t - min(t) OVER w AS dt, max(t) OVER w - min(t) OVER w AS span FROM p WINDOW w AS (PARTITION BY flow_id)
), h AS (SELECT * FROM (SELECT *, unnest(range(greatest(0, CAST(floor((dt - 432000.0) / 216000.0) AS BIGINT) + 1), CAST(floor(dt / 216000.0) AS BIGINT) + 1)) AS k FROM h0) WHERE k * 216000.0 <= span)"""


def hops(spark, sf):
    return flows.hop_windows(packets(spark, sf), FLOW, WIDTH, HOP)


@query(f"WITH {H} SELECT flow_id, k, count(*) AS packet_count FROM h GROUP BY ALL")
def q_sliding_window(spark, sf):
    return hops(spark, sf).groupBy("flow_id", "k").agg(F.count(F.lit(1)).alias("packet_count"))


MACRO = ("packet_count", "byte_count", "duration", "avg_pkt_len", "avg_pay_len", "fwd_bytes", "rev_bytes", "fwd_pkts", "rev_pkts", "min_pkt", "max_pkt", "std_pkt", "min_pay", "max_pay", "std_pay", "ratio_fwd_rev_bytes", "ratio_fwd_rev_pkts", "ratio_len_pay", "tcp_ratio", "udp_ratio")


def macro(spark, sf):
    """The 20 flow features of each window; the packet lengths are cut to whole bytes."""
    h = hops(spark, sf).withColumn("len", F.floor("packet_length")).withColumn("pay", F.col("payload_length"))
    fwd, rev = F.col("direction") == 1, F.col("direction") == -1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    agg = h.groupBy("flow_id", "k").agg(
        F.count(F.lit(1)).cast("double").alias("packet_count"), zero(F.sum("len")).alias("byte_count"), (F.max("t") - F.min("t")).alias("duration"), F.avg("len").alias("avg_pkt_len"), F.avg("pay").alias("avg_pay_len"),
        zero(F.sum(F.when(fwd, F.col("len")))).alias("fwd_bytes"), zero(F.sum(F.when(rev, F.col("len")))).alias("rev_bytes"), F.count_if(fwd).cast("double").alias("fwd_pkts"), F.count_if(rev).cast("double").alias("rev_pkts"),
        F.min("len").cast("double").alias("min_pkt"), F.max("len").cast("double").alias("max_pkt"), F.stddev_pop("len").alias("std_pkt"), F.min("pay").cast("double").alias("min_pay"), F.max("pay").cast("double").alias("max_pay"), F.stddev_pop("pay").alias("std_pay"),
        zero(F.sum("pay")).alias("pays"), F.count_if(F.col("protocol") == 6).alias("tcp"), F.count_if(F.col("protocol") == 17).alias("udp"),
    )
    c = F.col
    return agg.withColumns({"ratio_fwd_rev_bytes": casts.ratio(c("fwd_bytes"), c("rev_bytes")), "ratio_fwd_rev_pkts": casts.ratio(c("fwd_pkts"), c("rev_pkts")), "ratio_len_pay": casts.ratio(c("byte_count"), c("pays")), "tcp_ratio": c("tcp") / c("packet_count"), "udp_ratio": c("udp") / c("packet_count")}).select("flow_id", "k", *MACRO)


M = H + """, m0 AS (SELECT flow_id, k, count(*)::DOUBLE AS packet_count, sum(floor(packet_length))::DOUBLE AS byte_count, max(t) - min(t) AS duration, avg(floor(packet_length)) AS avg_pkt_len, avg(payload_length) AS avg_pay_len,
  coalesce(sum(floor(packet_length)) FILTER (direction = 1), 0)::DOUBLE AS fwd_bytes, coalesce(sum(floor(packet_length)) FILTER (direction = -1), 0)::DOUBLE AS rev_bytes, (count(*) FILTER (direction = 1))::DOUBLE AS fwd_pkts, (count(*) FILTER (direction = -1))::DOUBLE AS rev_pkts,
  min(floor(packet_length))::DOUBLE AS min_pkt, max(floor(packet_length))::DOUBLE AS max_pkt, stddev_pop(floor(packet_length)) AS std_pkt, min(payload_length)::DOUBLE AS min_pay, max(payload_length)::DOUBLE AS max_pay, stddev_pop(payload_length) AS std_pay,
  sum(payload_length)::DOUBLE AS pays, (count(*) FILTER (protocol = 6))::DOUBLE AS tcp, (count(*) FILTER (protocol = 17))::DOUBLE AS udp FROM h GROUP BY ALL
), m AS (SELECT *, CASE WHEN rev_bytes > 0 THEN fwd_bytes / rev_bytes ELSE 0 END AS ratio_fwd_rev_bytes, CASE WHEN rev_pkts > 0 THEN fwd_pkts / rev_pkts ELSE 0 END AS ratio_fwd_rev_pkts, CASE WHEN pays > 0 THEN byte_count / pays ELSE 0 END AS ratio_len_pay, tcp / packet_count AS tcp_ratio, udp / packet_count AS udp_ratio FROM m0)"""


@query(f"WITH {M} SELECT flow_id, k, {', '.join(f'round({c}, 6) AS {c}' for c in MACRO)} FROM m")
def q_macro_window(spark, sf):
    return macro(spark, sf).select("flow_id", "k", *(r6(c) for c in MACRO))


#: Every name with "ratio" in it is a ratio, and so "duration" is one.
LOGGED = ("packet_count", "byte_count", "duration", "fwd_bytes", "rev_bytes", "fwd_pkts", "rev_pkts")
RATIOS = tuple(c for c in MACRO if "ratio" in c)


@query(
    f"WITH {M}, l AS (SELECT flow_id, k, " + ", ".join(f"ln(1 + greatest({c}, 0)) AS {c}" if c in LOGGED else c for c in MACRO) + " FROM m), s AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) + 1e-6 AS s_{c}" for c in MACRO if c not in RATIOS) + " FROM l) SELECT flow_id, k, "
    + ", ".join(f"round(least(5.0, greatest(-5.0, {f'least(10.0, greatest(-10.0, {c}))' if c in RATIOS else f'({c} - a_{c}) / s_{c}'})), 5) AS {c}" for c in MACRO) + " FROM l, s"
)
def q_macro_norm(spark, sf):
    rows = macro(spark, sf).withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in LOGGED})
    plain = [c for c in MACRO if c not in RATIOS]
    stats = rows.agg(*(F.avg(c).alias(f"a_{c}") for c in plain), *((F.stddev_pop(c) + 1e-6).alias(f"s_{c}") for c in plain))
    clip = lambda c, n: F.least(F.greatest(c, F.lit(-float(n))), F.lit(float(n)))
    out = rows.join(F.broadcast(stats))  # one row
    return out.select("flow_id", "k", *(F.round(clip(clip(F.col(c), 10) if c in RATIOS else (F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}"), 5), 5).alias(c) for c in MACRO))


@query(f"""WITH {P}, {H[len(P) + 2:].replace("FROM p WINDOW", "FROM e WINDOW", 1)}, r AS (SELECT *, row_number() OVER w - 1 AS pos, t - first_value(t) OVER w AS since, coalesce(t - lag(t) OVER w, 0.0::DOUBLE) AS inter FROM h WINDOW w AS (PARTITION BY flow_id, k ORDER BY t, frame_index))
SELECT flow_id, k, pos, CAST(trunc(packet_length) AS BIGINT) AS packet_length, CAST(payload_length AS BIGINT) AS payload_length, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol, 4::BIGINT AS ip_version, 0::BIGINT AS ip_ttl, CAST(tcp_flags AS BIGINT) AS tcp_flags, 0::BIGINT AS tcp_window,
  -1::BIGINT AS icmp_type, -1::BIGINT AS icmp_code, 0::BIGINT AS esp_spi, 0::BIGINT AS ah_spi, 0::BIGINT AS gre_protocol, CAST(direction AS BIGINT) AS direction, round(since, 6) AS normalized_time, round(inter, 6) AS inter_arrival, round(CASE WHEN trunc(packet_length) <> 0 THEN payload_length / trunc(packet_length) ELSE 0 END, 6) AS length_ratio, round(payload_length / 64.0::DOUBLE, 6) AS payload_ratio, CAST(protocol = 6 AS INTEGER) AS is_tcp FROM r WHERE pos < 64""")
def q_micro_window(spark, sf):
    out = micro.window_packets(hops(spark, sf), ["flow_id", "k"], ORDER, 64)
    exact = micro.WINDOW_FEATURES[:15]
    return out.select("flow_id", "k", "pos", *exact, *(r6(c) for c in ("normalized_time", "inter_arrival", "length_ratio", "payload_ratio")), "is_tcp")


# micro20 over the events: lengths scaled into the usual range, flags spelled out
def _micro(spark, sf):
    p = flows.gaps(packets(spark, sf), FLOW, ORDER)
    text = F.when(F.col("tcp_flags") == 1, "FIN").when(F.col("tcp_flags") == 4, "RST").when(F.col("payload_length") < 50, "SYN").otherwise("ACK")
    return micro.micro20(p.select("flow_id", "frame_index", "t", (F.floor("packet_length") * 50).alias("packet_length"), F.when(F.col("direction") == 1, 0).otherwise(1).alias("dir01"), (F.col("iat") / 1e5).alias("iat"), text.alias("flags")), FLOW, ORDER)


FEATS = [f"f{i}" for i in range(20)]


MI = P + """, g0 AS (SELECT flow_id, frame_index, t, floor(packet_length) * 50 AS len, CASE WHEN direction = 1 THEN 0 ELSE 1 END AS d, greatest(0.0::DOUBLE, coalesce(t - lag(t) OVER w, 0.0::DOUBLE)) / 1e5 AS iat,
  CASE WHEN tcp_flags = 1 THEN 'FIN' WHEN tcp_flags = 4 THEN 'RST' WHEN payload_length < 50 THEN 'SYN' ELSE 'ACK' END AS flags, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY flow_id) AS n FROM p WINDOW w AS (PARTITION BY flow_id ORDER BY t, frame_index)
), g1 AS (SELECT *, CASE WHEN d <> lag(d) OVER w THEN 1 ELSE 0 END AS turn, CASE WHEN abs(len - lag(len) OVER w) > 100 THEN 1 ELSE 0 END AS jump, lag(len, 1) OVER w AS a, lag(len, 2) OVER w AS b FROM g0 WINDOW w AS (PARTITION BY flow_id ORDER BY i)
), g2 AS (SELECT *, sum(turn) OVER (PARTITION BY flow_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS isl FROM g1
), g3 AS (SELECT *, row_number() OVER (PARTITION BY flow_id, isl ORDER BY i) AS run FROM g2
), g AS (SELECT flow_id, frame_index, i AS pos, CASE WHEN len > 0 THEN log10(len + 1) / 4 ELSE 0 END AS f0, d::DOUBLE AS f1, len / 1500 * CASE WHEN d = 0 THEN 1 ELSE -1 END AS f2, CASE WHEN iat > 0 THEN log10(iat * 1000 + 1) / 3 ELSE 0 END AS f3,
  CASE WHEN i >= 2 THEN least(run / 10.0::DOUBLE, 1) ELSE 0 END AS f4, CASE WHEN i >= 2 THEN sum(CASE WHEN iat < 0.01 THEN 1 ELSE 0 END) OVER w5 / 5.0::DOUBLE ELSE 0 END AS f5, CASE WHEN i >= 2 THEN sum(turn) OVER w9 / 10.0::DOUBLE ELSE 0 END AS f6,
  CASE WHEN i >= 4 THEN quantile_cont(len, 0.25) OVER w5 / 1500 ELSE 0 END AS f7, CASE WHEN i >= 4 THEN quantile_cont(len, 0.75) OVER w5 / 1500 ELSE 0 END AS f8, CASE WHEN i >= 4 THEN sum(jump) OVER w4 / 4.0::DOUBLE ELSE 0 END AS f9, CASE WHEN i >= 4 THEN least(5, least(run, 4) + 1) / 5.0::DOUBLE ELSE 0 END AS f10,
  CASE WHEN flags = 'SYN' THEN 1.0::DOUBLE ELSE 0 END AS f11, CASE WHEN flags = 'ACK' THEN 1.0::DOUBLE ELSE 0 END AS f12, CASE WHEN flags IN ('FIN', 'RST') THEN 1.0::DOUBLE ELSE 0 END AS f13, i / greatest(n - 1, 1)::DOUBLE AS f14, CASE WHEN i < 5 THEN 1.0::DOUBLE ELSE 0 END AS f15,
  CASE WHEN i < 2 OR (len = a AND a = b) THEN 0 WHEN len <> a AND a <> b AND len <> b THEN ln(3) / 2 ELSE (-(2.0::DOUBLE / 3) * ln(2.0::DOUBLE / 3) - (1.0::DOUBLE / 3) * ln(1.0::DOUBLE / 3)) / 2 END AS f16,
  CASE WHEN i >= 2 THEN avg(CASE WHEN len < 100 THEN 1 ELSE 0 END) OVER w3 ELSE 0 END AS f17, CASE WHEN i >= 2 THEN avg(CASE WHEN len > 1000 THEN 1 ELSE 0 END) OVER w3 ELSE 0 END AS f18, CASE WHEN i >= 2 AND sum(len) OVER w3 > 0 THEN sum(greatest(len - 20, 0)) OVER w3 / sum(len) OVER w3 ELSE 0 END AS f19
  FROM g3 WINDOW w3 AS (PARTITION BY flow_id ORDER BY i ROWS 2 PRECEDING), w4 AS (PARTITION BY flow_id ORDER BY i ROWS 3 PRECEDING), w5 AS (PARTITION BY flow_id ORDER BY i ROWS 4 PRECEDING), w9 AS (PARTITION BY flow_id ORDER BY i ROWS 8 PRECEDING))"""


@query(f"WITH {MI} SELECT flow_id, frame_index, pos, {', '.join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM g")
def q_micro20(spark, sf):
    return _micro(spark, sf).select("flow_id", "frame_index", F.col("pos").cast("long").alias("pos"), *(r6(c) for c in FEATS))


@query(f"WITH {P}, r AS (SELECT flow_id, frame_index, row_number() OVER (PARTITION BY flow_id ORDER BY t, frame_index) - 1 AS pos, count(*) OVER (PARTITION BY flow_id) AS n FROM p), v AS (SELECT *, unnest(range(0, 3)) AS variant FROM r), o AS (SELECT *, pos - CASE WHEN n > 32 THEN variant * (n // 3) ELSE 0 END AS step FROM v) SELECT flow_id, variant, step, frame_index FROM o WHERE step >= 0 AND step < 32")
def q_time_split(spark, sf):
    w = Window.partitionBy("flow_id").orderBy(*ORDER)
    rows = packets(spark, sf).withColumn("pos", F.row_number().over(w) - 1)
    return micro.time_split(rows, FLOW, 3, 32).select("flow_id", F.col("variant").cast("long").alias("variant"), F.col("step").cast("long").alias("step"), "frame_index")


def _paths(spark, sf):
    """Label-like paths made from the event table."""
    e = table(spark, sf, "events")
    folder = F.element_at(F.array(*(F.lit(x) for x in ("Tor/Browsing", "NonTor/Video-Streaming", "vpn/skype_voip", "NonVPN/email/Mail", "quic/ftps", "Tor/P2P/torrent", "other/Chat.IM"))), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", F.concat(folder, F.lit("_"), "event_type", F.lit("_packets.csv")).alias("path"))


PATHS = "d AS (SELECT event_id, ['Tor/Browsing', 'NonTor/Video-Streaming', 'vpn/skype_voip', 'NonVPN/email/Mail', 'quic/ftps', 'Tor/P2P/torrent', 'other/Chat.IM'][CAST(event_id % 7 + 1 AS INTEGER)] || '_' || event_type || '_packets.csv' AS path FROM events), c AS (SELECT *, upper(regexp_replace(path, '\\.[^./]+$', '')) AS stem FROM d), w AS (SELECT *, regexp_replace(stem, '[^A-Z0-9]+', '', 'g') AS compact, regexp_split_to_array(stem, '[^A-Z0-9]+') AS words FROM c)"
APPS = "CASE " + " ".join("WHEN " + " OR ".join(f"list_contains(words, '{a}')" + (f" OR contains(compact, '{a}')" if len(a) >= 4 else "") for a in aliases) + f" THEN '{label}'" for label, aliases in labels.APPLICATIONS.items()) + " ELSE 'UNKNOWN' END"


@query(f"WITH {PATHS}, l AS (SELECT event_id, CASE WHEN contains(compact, 'NONTOR') THEN 'NONTOR' WHEN list_contains(words, 'TOR') OR starts_with(compact, 'TOR') THEN 'TOR' WHEN contains(compact, 'NONVPN') THEN 'NONVPN' WHEN contains(compact, 'VPN') THEN 'VPN' WHEN list_contains(words, 'QUIC') THEN 'QUIC' ELSE 'OTHER' END AS primary_label, {APPS} AS application FROM w) SELECT *, primary_label || ':' || application AS combined FROM l")
def q_label_infer(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("event_id", labels.primary(p).alias("primary_label"), labels.application(p).alias("application")).withColumn("combined", F.concat_ws(":", "primary_label", "application"))


LAST = "CASE " + " ".join(f"WHEN contains(x, '{c}') THEN '{c}'" for c in reversed(labels.CANDIDATES)) + " END"


@query(f"WITH {PATHS}, q AS (SELECT event_id, path, list_filter(list_transform(string_split(upper(path), '/'), lambda x: {LAST}), lambda x: x IS NOT NULL) AS f FROM w) SELECT event_id, CASE WHEN contains(lower(path), 'nonvpn') THEN 'NONVPN' WHEN contains(lower(path), 'vpn') THEN 'VPN' ELSE 'UNKNOWN' END AS traffic, coalesce(f[len(f)], 'UNKNOWN') AS app FROM q")
def q_label_infer_debug(spark, sf):
    return _paths(spark, sf).select("event_id", labels.debug_traffic(F.col("path")).alias("traffic"), labels.debug_application(F.col("path")).alias("app"))


CANON = "CASE x " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in labels.TOKENS.items()) + " END"


@query(f"WITH {PATHS}, q AS (SELECT event_id, string_split(upper(path), '/') AS parts FROM w), r AS (SELECT event_id, list_filter(list_transform(list_concat(parts, regexp_split_to_array(parts[len(parts)], '[^A-Z0-9]+')), lambda x: {CANON}), lambda x: x IS NOT NULL) AS f FROM q) SELECT event_id, coalesce(f[1], 'UNKNOWN') AS secondary FROM r")
def q_label_secondary(spark, sf):
    return _paths(spark, sf).select("event_id", labels.secondary(F.col("path")).alias("secondary"))


@query(f"WITH {PATHS} SELECT event_id, CASE WHEN contains(lower(path), 'nonvpn') THEN 'NONVPN' WHEN contains(lower(path), 'vpn') THEN 'VPN' ELSE 'NONVPN' END AS class, CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(v)}') THEN '{k}'" for k, v in labels.ACTIVITIES.items()) + " ELSE 'UNKNOWN' END AS activity FROM w")
def q_label_activity(spark, sf):
    return _paths(spark, sf).select("event_id", labels.activity_class(F.col("path")).alias("class"), labels.activity(F.col("path")).alias("activity"))


@query("SELECT event_id, len(string_split(event_type || '|' || user_id || '|' || event_id, '|')) AS parts, regexp_matches(CAST(event_id AS VARCHAR), '^[0-9]+$') AS last_digits, length(event_type || '|' || user_id || '|' || event_id) > 14 AS long FROM events")
def q_id_format(spark, sf):
    key = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    parts = F.split(key, r"\|")
    return table(spark, sf, "events").select("event_id", F.size(parts).cast("long").alias("parts"), F.element_at(parts, -1).rlike(r"^\d+$").alias("last_digits"), (F.length(key) > 14).alias("long"))


CELL = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'n/a' WHEN 3 THEN '12.75' WHEN 4 THEN '-3e2' ELSE NULL END"


def _cells(spark, sf):
    m = F.col("event_id") % 6
    cell = F.when(m == 0, "").when(m == 1, F.col("user_id").cast("string")).when(m == 2, "n/a").when(m == 3, "12.75").when(m == 4, "-3e2")
    return table(spark, sf, "events").select("event_id", "value", cell.alias("cell"))


@query(f"SELECT event_id, round(coalesce(try_cast(nullif({CELL}, '') AS DOUBLE), value), 6) AS number, CAST(trunc(coalesce(try_cast(nullif({CELL}, '') AS DOUBLE), 7)) AS BIGINT) AS whole FROM events")
def q_coalesce_number(spark, sf):
    return _cells(spark, sf).select("event_id", r6(casts.first_number(F.col("cell"), F.col("value")), "number"), casts.to_int(F.col("cell"), 7).alias("whole"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 18.0::DOUBLE WHEN 1 THEN 24.0 WHEN 2 THEN 10.0 WHEN 3 THEN 100.0 ELSE 0.0 END AS flags FROM events")
def q_tcp_flags(spark, sf):
    m = F.col("event_id") % 5
    cell = F.when(m == 0, "18").when(m == 1, "0x18").when(m == 2, "A").when(m == 3, "1e2").otherwise("xyz")
    return table(spark, sf, "events").select("event_id", casts.tcp_flags(cell).alias("flags"))


@query("SELECT event_type AS label, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS first_seen, row_number() OVER (ORDER BY event_type) - 1 AS sorted FROM events GROUP BY event_type")
def q_label_encode(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "label")
    first, sorted_ = ml.dictionary(e, "label", "first", "event_id"), ml.dictionary(e, "label")
    return first.select("label", F.col("id").cast("long").alias("first_seen")).join(sorted_.select("label", F.col("id").cast("long").alias("sorted")), "label")


KINDS = ("view", "refund", "click", "signup", "purchase")


@query("SELECT label, row_number() OVER (ORDER BY ord) - 1 AS id FROM (VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(KINDS)) + ") v(label, ord) WHERE label IN (SELECT event_type FROM events)")
def q_label_encode_fixed(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "label")
    return ml.dictionary(e, "label", "fixed", fixed=KINDS).select("label", F.col("id").cast("long").alias("id"))


@query(f"WITH {PATHS}, l AS (SELECT event_id, CASE WHEN contains(compact, 'NONTOR') THEN 'NONTOR' WHEN list_contains(words, 'TOR') OR starts_with(compact, 'TOR') THEN 'TOR' ELSE 'OTHER' END AS primary_label, {APPS} AS application FROM w) SELECT event_id, CASE primary_label WHEN 'NONTOR' THEN 0 ELSE 1 END AS tor_binary, list_position(['BROWSING', 'EMAIL', 'CHAT', 'AUDIO', 'VIDEO', 'FILE', 'VOIP', 'P2P'], application) - 1 AS application8 FROM l WHERE primary_label IN ('TOR', 'NONTOR') AND application <> 'UNKNOWN'")
def q_task_labels(spark, sf):
    rows = _paths(spark, sf).select("event_id", labels.primary(F.col("path")).alias("p"), labels.application(F.col("path")).alias("a")).where("p in ('TOR', 'NONTOR') and a <> 'UNKNOWN'")
    names = F.array(*(F.lit(x) for x in labels.APPLICATIONS))
    return rows.select("event_id", F.when(F.col("p") == "NONTOR", 0).otherwise(1).alias("tor_binary"), (F.array_position(names, F.col("a")) - 1).cast("int").alias("application8"))


@query("SELECT c.c_custkey, coalesce(a.n_name, b.n_name, 'UNKNOWN') AS nation, CASE WHEN a.n_name IS NOT NULL THEN 'key' WHEN b.n_name IS NOT NULL THEN 'fallback' ELSE 'none' END AS via FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) a ON c.c_nationkey = a.n_nationkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey BETWEEN 10 AND 20) b ON c.c_nationkey = b.n_nationkey")
def q_manifest_override(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    a = n.where("n_nationkey < 15").withColumnRenamed("n_name", "a")
    b = n.where("n_nationkey between 10 and 20").withColumnRenamed("n_name", "b")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    out = c.join(a, "n_nationkey", "left").join(b, "n_nationkey", "left")
    return out.select("c_custkey", F.coalesce("a", "b", F.lit("UNKNOWN")).alias("nation"), F.when(F.col("a").isNotNull(), "key").when(F.col("b").isNotNull(), "fallback").otherwise("none").alias("via"))


@query("SELECT event_type AS label, count(*) AS rows, 1.0::DOUBLE AS match_rate FROM events GROUP BY event_type")
def q_encode_audit(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"))
    d = ml.dictionary(e, "label")
    coded = e.join(d, "label").select("event_id", "id", "label")
    back = coded.join(d.withColumnRenamed("label", "decoded"), "id", "left").withColumn("decoded", F.coalesce("decoded", F.lit("UNKNOWN")))
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("label") == F.col("decoded")).cast("double")).alias("match_rate"))


@query("SELECT coalesce(a.k, b.k) AS status, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS lost FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) b ON a.k = b.k")
def q_stage_reconcile(spark, sf):
    o = table(spark, sf, "orders")
    a = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("before"))
    b = o.where("o_totalprice > 200000").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("after"))
    return a.join(b, "status", "full").fillna(0).withColumn("lost", F.col("before") - F.col("after"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN o.o_orderkey IS NULL THEN 'ORPHAN_' || l_linenumber ELSE CAST(o.o_orderkey AS VARCHAR) END AS flow FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o.o_orderkey")
def q_orphan_packets(spark, sf):
    kept = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").cast("string").alias("own"))
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(kept, "l_orderkey", "left")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce("own", F.concat(F.lit("ORPHAN_"), F.col("l_linenumber").cast("string"))).alias("flow"))


@query("SELECT l_orderkey, count(*) AS packets FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_orderkey")
def q_semi_packets(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(o, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("packets"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_anti_missing(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, count(l_linenumber) AS packets, round(coalesce(sum(l_quantity), 0), 4) AS bytes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def q_flow_packet_join(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("packets"), F.round(F.sum("l_quantity"), 4).alias("bytes"))
    return table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left").fillna({"packets": 0, "bytes": 0.0})


@query("WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k) SELECT count(x) AS flows, count(y) AS packet_flows, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(x)::DOUBLE, 6) AS match_rate FROM j")
def q_match_rate(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).distinct().withColumn("x", F.lit(1))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("y", F.lit(1))
    j = a.join(b, "k", "full")
    both = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return j.agg(F.count("x").alias("flows"), F.count("y").alias("packet_flows"), both.alias("both"), r6(both / F.count("x"), "match_rate"))


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS high FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_missing_describe(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    m = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(li, "o_orderkey", "left_anti")
    q = lambda x, name: F.round(F.percentile("o_totalprice", x), 4).alias(name)
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("std"), F.min("o_totalprice").alias("low"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max("o_totalprice").alias("high"))


@query("SELECT count(*) AS flows, count(*) FILTER (n <= 3) AS short, round(count(*) FILTER (n <= 3) / count(*)::DOUBLE, 6) AS share FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def q_short_flow_share(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("n") <= 3).alias("short"), r6(F.avg((F.col("n") <= 3).cast("double")), "share"))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def q_set_ops(spark, sf):
    a, b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    one = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return one(a.intersect(b), "both").union(one(b.subtract(a), "only_customer"))


@query("SELECT source, count(*) AS n, count(size) AS sized FROM (SELECT 'part' AS source, p_size AS size FROM part UNION ALL SELECT 'supplier', NULL FROM supplier) GROUP BY source")
def q_union_sources(spark, sf):
    a = table(spark, sf, "part").select(F.lit("part").alias("source"), F.col("p_size").alias("size"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("size").alias("sized"))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS ids, count(*) FILTER (n > 1) AS repeated, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def q_duplicate_flows(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("most"))


SAMPLE = "c AS (SELECT o_orderstatus AS source, o_orderkey AS key, count(*) OVER (PARTITION BY o_orderstatus) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM (SELECT DISTINCT o_orderstatus, o_orderkey FROM orders)), k AS (SELECT source, key, n FROM c WHERE r <= least(greatest(1, CAST(ceil(n * 0.1::DOUBLE) AS BIGINT)), 1000, n))"


def _sample(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("key"))
    return ml.sample(o, "source", "key", 0.1, 42, 1000)


@query(f"WITH {SAMPLE} SELECT source, key FROM k")
def q_sample_flows(spark, sf):
    return _sample(spark, sf).select("source", "key")


@query(f"WITH {SAMPLE} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT key FROM k)")
def q_sample_packets(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(_sample(spark, sf).select(F.col("key").alias("l_orderkey")), "l_orderkey", "left_semi")


@query(f"WITH {SAMPLE} SELECT source, max(n) AS flows_before, count(DISTINCT key) AS flows_after, count(l_orderkey) AS packets_after FROM k LEFT JOIN lineitem ON l_orderkey = key GROUP BY source")
def q_sample_manifest(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    out = _sample(spark, sf).join(li, "key", "left")
    return out.groupBy("source").agg(F.max("flows_before").alias("flows_before"), F.count(F.lit(1)).alias("flows_after"), F.coalesce(F.sum("n"), F.lit(0)).alias("packets_after"))


DOMINANT = "dom AS (SELECT g, label FROM (SELECT o_custkey AS g, o_orderstatus AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1, 2) WHERE r = 1)"
SPLIT = DOMINANT + ", z AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || g), g) AS r, greatest(1, CAST(round_even(count(*) OVER () * 0.15::DOUBLE, 0) AS BIGINT)) AS c FROM dom), sp AS (SELECT g, label, CASE WHEN r <= c THEN 'test' WHEN r <= 2 * c THEN 'val' ELSE 'train' END AS split FROM z)"


def _split(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("label"))
    return ml.group_split(o, "g", "label")


@query(f"WITH {DOMINANT} SELECT g, label FROM dom")
def q_dominant_label(spark, sf):
    return ml.dominant_label(table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("label")), "g", "label")


@query(f"WITH {SPLIT} SELECT g, label, split FROM sp")
def q_group_split(spark, sf):
    return _split(spark, sf)


@query(f"WITH {SPLIT} SELECT split, o_orderstatus AS label, count(*) AS samples, count(DISTINCT o_custkey) AS groups FROM orders JOIN sp ON g = o_custkey GROUP BY ALL")
def q_split_summary(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderstatus").alias("label"))
    return o.join(_split(spark, sf).select("g", "split"), "g").groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("g").alias("groups"))


def _long(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


LONG = "lg AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings), st AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-8 THEN 1.0 ELSE stddev_pop(value) END AS std FROM lg WHERE vec_id % 5 <> 0 GROUP BY feature)"


@query(f"WITH {LONG} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def q_norm_fit(spark, sf):
    return ml.fit_normaliser(_long(spark, sf).where("vec_id % 5 <> 0")).select(F.col("feature").cast("long").alias("feature"), r6("mean"), r6("std"))


@query(f"WITH {LONG} SELECT vec_id, feature, round((value - mean) / std, 5) AS value FROM lg JOIN st USING (feature)")
def q_norm_apply(spark, sf):
    rows = _long(spark, sf)
    stats = ml.fit_normaliser(rows.where("vec_id % 5 <> 0"))
    # one row a feature
    return rows.join(F.broadcast(stats), "feature").select("vec_id", F.col("feature").cast("long").alias("feature"), F.round((F.col("value") - F.col("mean")) / F.col("std"), 5).alias("value"))


@query(f"WITH {LONG} SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM lg GROUP BY feature")
def q_norm_global(spark, sf):
    return ml.fit_normaliser(_long(spark, sf), floor=0.0).select(F.col("feature").cast("long").alias("feature"), r6("mean"), r6("std"))


def _classes(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("class"))


@query("SELECT CAST(c AS INTEGER) AS class, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN (SELECT count(*) FROM embeddings) / (12.0::DOUBLE * n) ELSE 0 END, 6) AS weight FROM range(12) r(c) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON label = c")
def q_class_weights(spark, sf):
    return ml.class_weights(table(spark, sf, "embeddings").select("label"), "label", _classes(spark, 12)).select("class", "n", r6("weight"))


def _predictions(spark, sf):
    """True class, and as prediction the place of the largest of the first ten components."""
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("y"), ml.argmax(F.slice("embedding", 1, 10)).cast("int").alias("p"))


PRED = "pr AS (SELECT vec_id, label AS y, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS p FROM embeddings)"
CLS = PRED + ", cl AS (SELECT CAST(c AS INTEGER) AS class, (SELECT count(*) FROM pr WHERE y = c) AS support, (SELECT count(*) FROM pr WHERE p = c) AS predicted, (SELECT count(*) FROM pr WHERE y = c AND p = c) AS tp FROM range(10) r(c)), pc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall FROM cl), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc)"


@query(f"WITH {PRED} SELECT CAST(a.c AS INTEGER) AS y, CAST(b.c AS INTEGER) AS p, (SELECT count(*) FROM pr WHERE pr.y = a.c AND pr.p = b.c) AS n FROM range(10) a(c), range(10) b(c)")
def q_confusion_matrix(spark, sf):
    grid = _classes(spark, 10).select(F.col("class").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("p"))
    return grid.join(_predictions(spark, sf).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")), ["y", "p"], "left").fillna(0)


@query(f"WITH {CLS} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def q_per_class_metrics(spark, sf):
    return ml.per_class(_predictions(spark, sf), "y", "p", _classes(spark, 10)).select("class", "support", r6("precision"), r6("recall"), r6("f1"))


@query(f"WITH {CLS} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def q_scores(spark, sf):
    c = ml.per_class(_predictions(spark, sf), "y", "p", _classes(spark, 10))
    return c.agg(r6(F.sum("tp") / F.sum("support"), "accuracy"), r6(F.avg("f1"), "macro_f1"), r6(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), "weighted_f1"))


@query("WITH r AS (SELECT label < 5 AS pos, rank() OVER (ORDER BY embedding[1]) + (count(*) OVER (PARTITION BY embedding[1]) - 1) / 2.0::DOUBLE AS rk FROM embeddings) SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))::DOUBLE, 6) AS auc FROM r")
def q_auc(spark, sf):
    s = table(spark, sf, "embeddings").select((F.col("label") < 5).alias("pos"), F.col("embedding")[0].alias("score"))
    return ml.auc(s, "pos", "score").select(r6("auc"))


COHEN = "co AS (SELECT feature, avg(value) FILTER (label < 5) AS a, avg(value) FILTER (label >= 5) AS b, var_pop(value) FILTER (label < 5) AS va, var_pop(value) FILTER (label >= 5) AS vb FROM lg GROUP BY feature), cd AS (SELECT feature, abs(a - b) / (sqrt((va + vb) / 2) + 1e-8) AS cohens_d, abs(a - b) / (abs(b) + 1e-8) AS difference FROM co)"


@query(f"WITH {LONG}, {COHEN} SELECT feature, round(cohens_d, 6) AS cohens_d, round(difference, 4) AS difference FROM cd ORDER BY round(cohens_d, 6) DESC, feature LIMIT 10")
def q_cohens_d(spark, sf):
    low, high = F.when(F.col("label") < 5, F.col("value")), F.when(F.col("label") >= 5, F.col("value"))
    a = _long(spark, sf).groupBy(F.col("feature").cast("long").alias("feature")).agg(F.avg(low).alias("a"), F.avg(high).alias("b"), F.var_pop(low).alias("va"), F.var_pop(high).alias("vb"))
    gap = F.abs(F.col("a") - F.col("b"))
    out = a.select("feature", r6(gap / (F.sqrt((F.col("va") + F.col("vb")) / 2) + 1e-8), "cohens_d"), F.round(gap / (F.abs("b") + 1e-8), 4).alias("difference"))
    return out.orderBy(F.desc("cohens_d"), "feature").limit(10)


SOFT = "so AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE - list_max(embedding[1:10])::DOUBLE)) AS e, embedding[1:10] AS s FROM embeddings), sm AS (SELECT vec_id, label, s, list_transform(e, lambda x: x / list_sum(e)) AS p FROM so)"


def _soft(spark, sf):
    own = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", own.alias("s")).withColumn("p", ml.softmax(F.col("s")))


@query(f"WITH {SOFT} SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS pred, round(list_max(p), 6) AS top, round(p[1], 6) AS p0 FROM sm")
def q_softmax_argmax(spark, sf):
    return _soft(spark, sf).select("vec_id", ml.argmax(F.col("s")).cast("long").alias("pred"), r6(F.array_max("p"), "top"), r6(F.col("p")[0], "p0"))


@query(f"WITH {SOFT}, t AS (SELECT label, least(greatest(p[label + 1], 1e-7), 1 - 1e-7) AS pt, p[label + 1] AS q FROM sm) SELECT label, round(avg(-pow(1 - pt, 1.5) * ln(q)), 6) AS loss FROM t GROUP BY label")
def q_focal_loss(spark, sf):
    rows = _soft(spark, sf).select(F.col("label").cast("int").alias("label"), F.element_at("p", (F.col("label") + 1).cast("int")).alias("q"))
    return rows.groupBy("label").agg(r6(F.avg(ml.focal_loss(F.col("q"), F.lit(1.0))), "loss"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE * exp(embedding[i + 32]::DOUBLE - list_max(embedding[33:64])::DOUBLE))) / list_sum(list_transform(embedding[33:64], lambda x: exp(x::DOUBLE - list_max(embedding[33:64])::DOUBLE))), 6) AS pooled FROM embeddings")
def q_attention_pool(spark, sf):
    part = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", r6(ml.attention_pool(part(1), part(33)), "pooled"))


@query("SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(list_transform(range(1, 9), lambda i: embedding[i]::DOUBLE / (1 + exp(-(embedding[i]::DOUBLE + embedding[i + 8]::DOUBLE))) + (1 - 1 / (1 + exp(-(embedding[i]::DOUBLE + embedding[i + 8]::DOUBLE)))) * embedding[i + 8]::DOUBLE)), 6) AS fused FROM embeddings")
def q_gated_fusion(spark, sf):
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(ml.gated_fusion(part(1), part(9))).alias("i", "fused"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6("fused"))


PACKED = "o AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY 1)"


@query(f"WITH {PACKED} SELECT k, unnest(range(0, 4)) AS i, unnest(list_transform(range(1, 5), lambda i: coalesce(v[i], 0.0))) AS x, unnest(list_transform(range(1, 5), lambda i: CAST(i <= len(v) AS INTEGER))) AS mask FROM o")
def q_pad_mask(spark, sf):
    v = _packed(spark, sf).select("k", ml.pad(F.col("v"), 4).alias("x"), ml.mask(F.col("v"), 4).alias("m"))
    return v.select("k", F.posexplode(F.arrays_zip("x", "m")).alias("i", "z")).select("k", F.col("i").cast("long").alias("i"), "z.x", F.col("z.m").alias("mask"))


def _packed(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("r"))
    return rows.groupBy("k").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["l_quantity"]).alias("v"))


@query(f"WITH {PACKED} SELECT k, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM o")
def q_pack_sequence(spark, sf):
    return _packed(spark, sf).select("k", F.posexplode("v").alias("i", "x")).select("k", F.col("i").cast("long").alias("i"), "x")


@query("SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY source")
def q_label_distribution(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", r6(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(f"WITH {P} SELECT protocol, direction, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT protocol, 0, count(*) FROM p GROUP BY protocol")
def q_protocol_by_label(spark, sf):
    return packets(spark, sf).rollup("protocol", "direction").agg(F.count(F.lit(1)).alias("n")).where("protocol is not null").fillna(0, ["direction"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 10")
def q_top_labels(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "source").limit(10)


@query(f"WITH {LONG} SELECT vec_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS spread FROM lg GROUP BY vec_id")
def q_token_stats(spark, sf):
    return _long(spark, sf).groupBy("vec_id").agg(r6(F.avg("value"), "mean"), r6(F.stddev_pop("value"), "std"), r6(F.max("value") - F.min("value"), "spread"))


@query(f"WITH {LONG} SELECT feature, round(avg(CASE WHEN isfinite(value) THEN 1.0 ELSE 0.0 END), 6) AS finite, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(abs(value)), 6) AS top, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.99), 6) AS q99, bool_and(label BETWEEN 0 AND 9) AS labels_ok FROM lg GROUP BY feature")
def q_sanity_profile(spark, sf):
    v = F.col("value")
    finite = ~(F.isnan(v) | (F.abs(v) == float("inf")))
    q = lambda x, name: r6(F.percentile("value", x), name)
    return _long(spark, sf).groupBy(F.col("feature").cast("long").alias("feature")).agg(r6(F.avg(finite.cast("double")), "finite"), r6(F.min(v), "low"), r6(F.max(v), "high"), r6(F.max(F.abs(v)), "top"), q(0.5, "q50"), q(0.9, "q90"), q(0.99, "q99"), F.bool_and(F.col("label").between(0, 9)).alias("labels_ok"))


@query(f"WITH {H}, n AS (SELECT flow_id, k, least(count(*), 64) AS len FROM h GROUP BY ALL) SELECT round(quantile_cont(len, 0.95), 6) AS p95, round(avg(len / 64.0::DOUBLE), 6) AS mask_rate FROM n")
def q_seqlen_p95(spark, sf):
    n = hops(spark, sf).groupBy("flow_id", "k").agg(F.least(F.count(F.lit(1)), F.lit(64)).alias("len"))
    return n.agg(r6(F.percentile("len", 0.95), "p95"), r6(F.avg(F.col("len") / 64), "mask_rate"))


@query(f"WITH {P} SELECT 'protocol' AS dim, CAST(protocol AS VARCHAR) AS value, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'flags', CAST(tcp_flags AS VARCHAR), count(*) FROM p GROUP BY ALL UNION ALL SELECT 'direction', CAST(direction AS VARCHAR), count(*) FROM p GROUP BY ALL")
def q_decoder_stats(spark, sf):
    dims = F.map_from_arrays(F.array(F.lit("protocol"), F.lit("flags"), F.lit("direction")), F.array(F.col("protocol").cast("string"), F.col("tcp_flags").cast("string"), F.col("direction").cast("string")))
    return packets(spark, sf).select(F.explode(dims).alias("dim", "value")).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S}, f AS (SELECT protocol, flow_id, session, count(*) AS n FROM s GROUP BY ALL) SELECT protocol, count(*) AS total_sessions, count(*) FILTER (n >= 2) AS kept_sessions, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS kept_packets FROM f GROUP BY protocol")
def q_source_summary(spark, sf):
    f = sessions(spark, sf).groupBy("protocol", *SESSION).agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("n") >= 2
    return f.groupBy("protocol").agg(F.count(F.lit(1)).alias("total_sessions"), F.count_if(kept).alias("kept_sessions"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept_packets"))


@query(f"WITH {B}, n AS (SELECT flow_id, session, count(*) AS packets, max(burst) + 1 AS bursts FROM b GROUP BY ALL) SELECT count(*) AS samples, max(packets) AS max_packets, max(least(bursts, 16)) AS max_bursts, round(avg(packets), 6) AS mean_packets, 32 AS packet_slots, 16 AS burst_slots FROM n")
def q_feature_summary(spark, sf):
    n = observed(spark, sf).groupBy(*SESSION).agg(F.count(F.lit(1)).alias("packets"), (F.max("burst") + 1).alias("bursts"))
    return n.agg(F.count(F.lit(1)).alias("samples"), F.max("packets").alias("max_packets"), F.max(F.least("bursts", F.lit(16))).alias("max_bursts"), r6(F.avg("packets"), "mean_packets")).withColumns({"packet_slots": F.lit(PREFIX), "burst_slots": F.lit(BURSTS)})


FIELDS = ("packet_length", "payload_length", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_version", "ip_ttl", "tcp_flags", "tcp_window", "vlan_id", "ether_type")
D = P + """, d AS (SELECT flow_id, frame_index, t, 34 + CASE WHEN frame_index % 4 = 0 THEN 4 ELSE 0 END + CASE WHEN protocol = 6 THEN 20 ELSE 8 END + payload_length AS packet_length, payload_length, src_ip, dst_ip, src_port, dst_port, protocol, 4 AS ip_version, 64 AS ip_ttl,
  CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, CASE WHEN protocol = 6 THEN 500 ELSE 0 END AS tcp_window, CASE WHEN frame_index % 4 = 0 THEN CAST(frame_index % 4000 AS INTEGER) ELSE -1 END AS vlan_id, 2048 AS ether_type FROM e)"""


def _decoded(spark, sf):
    """The events as frames of the wire, read by the decoder."""
    tag = F.when(F.col("frame_index") % 4 == 0, F.array((F.col("frame_index") % 4000).cast("int"))).otherwise(F.array().cast("array<int>"))
    return decoded(frames(packets(spark, sf), tags=tag), pcap.decode, ", ".join(f"{c} {'string' if c.endswith('ip') else 'int'}" for c in FIELDS))


@query(f"WITH {D} SELECT flow_id, frame_index, {', '.join(FIELDS)} FROM d")
def q_decode_frames(spark, sf):
    return _decoded(spark, sf).select("flow_id", "frame_index", *FIELDS)


@query(f"""WITH {D}, k AS (SELECT *, CASE WHEN src_ip <= dst_ip THEN '5T_' || src_ip || '_' || dst_ip || '_' || src_port || '_' || dst_port ELSE '5T_' || dst_ip || '_' || src_ip || '_' || dst_port || '_' || src_port END || '_' || protocol AS base FROM d),
l AS (SELECT *, lag(t) OVER w AS lt, lag(tcp_flags) OVER w AS lf FROM k WINDOW w AS (PARTITION BY base ORDER BY frame_index)),
s AS (SELECT *, base || '_S' || CAST(sum(CASE WHEN lt IS NOT NULL AND ((protocol = 6 AND (lf & 5) <> 0) OR t - lt > 86400.0) THEN 1 ELSE 0 END) OVER (PARTITION BY base ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow FROM l)
SELECT flow AS flow_id, '5T' AS key_type, any_value(protocol) AS protocol, count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS byte_count, round(min(t), 6) AS start_time, round(max(t) - min(t), 6) AS duration FROM s GROUP BY flow HAVING count(*) >= 2""")
def q_capture_flows(spark, sf):
    f, _ = build.capture_flows(_decoded(spark, sf).drop("flow_id").withColumns({"source": F.lit("events"), "skipped": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}), TIMEOUT, 2)
    return f.select("flow_id", "key_type", "protocol", "packet_count", "byte_count", r6("start_time"), r6("duration"))


KINDS_SQL = "CASE frame_index % 6 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 WHEN 3 THEN 50 WHEN 4 THEN 51 ELSE 47 END"
KEPT = ("packet_length", "vlan_ids", "src_mac", "dst_mac", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "icmp_type", "icmp_code", "esp_spi", "ah_spi", "gre_protocol", "ip_ttl", "header_length", "payload_length")


@query(f"""WITH {P}, k AS (SELECT *, {KINDS_SQL} AS kind, CASE WHEN frame_index % 5 = 0 THEN 2 ELSE 0 END AS tags, CAST(frame_index % 4000 AS INTEGER) AS tag FROM e), z AS (SELECT *, CASE kind WHEN 6 THEN 20 WHEN 1 THEN 4 WHEN 47 THEN 4 ELSE 8 END AS size FROM k)
SELECT frame_index, 34 + 4 * tags + size + payload_length AS packet_length, CASE WHEN tags = 2 THEN '7|' || tag ELSE '' END AS vlan_ids, '02:02:02:02:02:02' AS src_mac, '01:01:01:01:01:01' AS dst_mac, src_ip, dst_ip, kind AS protocol, CASE WHEN kind IN (6, 17) THEN src_port ELSE -1 END AS src_port, CASE WHEN kind IN (6, 17) THEN dst_port ELSE -1 END AS dst_port,
  CAST(CASE WHEN kind = 6 THEN 1 ELSE 0 END AS BIGINT) AS tcp_seq, CAST(CASE WHEN kind = 6 THEN 2 ELSE 0 END AS BIGINT) AS tcp_ack, CASE WHEN kind = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, CASE WHEN kind = 6 THEN 500 ELSE 0 END AS tcp_window, CASE WHEN kind = 1 THEN 8 ELSE -1 END AS icmp_type, CASE WHEN kind = 1 THEN CAST(frame_index % 200 AS INTEGER) ELSE -1 END AS icmp_code,
  CASE WHEN kind = 50 THEN frame_index ELSE 0 END AS esp_spi, CASE WHEN kind = 51 THEN frame_index ELSE 0 END AS ah_spi, CASE WHEN kind = 47 THEN 2048 ELSE 0 END AS gre_protocol, 64 AS ip_ttl, 34 + 4 * tags + size AS header_length, payload_length FROM z""")
def q_preserve_frames(spark, sf):
    i, hx = F.col("frame_index"), lambda c, n: F.lpad(F.hex(c), n, "0")
    kind = F.element_at(F.array(*(F.lit(x) for x in (6, 17, 1, 50, 51, 47))), (i % 6 + 1).cast("int"))
    ports = F.concat(hx(F.col("src_port"), 4), hx(F.col("dst_port"), 4))
    header = (
        F.when(i % 6 == 0, F.concat(ports, F.lit("000000010000000250"), hx(F.col("tcp_flags"), 2), F.lit("01F400000000"))).when(i % 6 == 1, F.concat(ports, F.lit("00000000")))
        .when(i % 6 == 2, F.concat(F.lit("08"), hx(i % 200, 2), F.lit("0000"))).when(i % 6 == 3, F.concat(hx(i, 8), F.lit("00000000"))).when(i % 6 == 4, F.concat(F.lit("00000000"), hx(i, 8))).otherwise("00000800")
    )
    tag = F.when(i % 5 == 0, F.array(F.lit(7), (i % 4000).cast("int"))).otherwise(F.array().cast("array<int>"))
    kinds = {c: "string" if c.endswith(("ip", "mac", "ids")) else "long" if c in ("tcp_seq", "tcp_ack", "esp_spi", "ah_spi") else "int" for c in KEPT}
    rows = frames(packets(spark, sf).withColumn("kind", kind), "kind", tag, header)
    return decoded(rows, preserving.decode, ", ".join(f"{c} {k}" for c, k in kinds.items())).select("frame_index", *KEPT)


@query(f"""WITH {P}, x0 AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY t, frame_index) - 1 AS pos FROM p), x1 AS (SELECT *, greatest(0.0::DOUBLE, coalesce(t - lag(t) OVER w, 0.0::DOUBLE)) AS iat, lag(direction) OVER w AS ld FROM x0 WHERE pos < 32 WINDOW w AS (PARTITION BY flow_id ORDER BY pos)),
x2 AS (SELECT *, coalesce(quantile_cont(iat, 0.5) FILTER (iat > 0) OVER w + (quantile_cont(iat, 0.75) FILTER (iat > 0) OVER w - quantile_cont(iat, 0.25) FILTER (iat > 0) OVER w), 0.0::DOUBLE) AS threshold FROM x1 WINDOW w AS (PARTITION BY flow_id)),
b AS (SELECT *, sum(CASE WHEN ld IS NOT NULL AND (direction <> ld OR iat > threshold) THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS burst FROM x2)
SELECT CAST(flow_id AS VARCHAR) AS flow_id, 32 AS packet_slots, CAST(count(*) AS BIGINT) AS packets, 8 AS burst_slots, CAST(least(max(burst) + 1, 8) AS BIGINT) AS bursts, CAST(count(*) FILTER (burst < 8) AS BIGINT) AS packets_in_bursts, CAST(sum(burst) AS BIGINT) AS burst_ids, CAST(sum(direction) AS BIGINT) AS directions FROM b GROUP BY flow_id""")
def q_feature_sequences(spark, sf):
    p = packets(spark, sf).select(F.lit("events").alias("source_key"), F.col("flow_id").cast("string").alias("flow_id"), "src_ip", "dst_ip", "src_port", "dst_port", "t", F.col("direction").cast("double").alias("direction"), "packet_length", "payload_length", F.lit(0.0).alias("ip_ttl"), "protocol", "tcp_flags", F.lit(0).alias("block"), F.col("frame_index").alias("row"))
    out = build.sequences(p, 32, 8)
    total = lambda c, i=None: F.aggregate(c, F.lit(0.0), lambda s, x: s + (x if i is None else x[i]).cast("double")).cast("long")
    return out.select("flow_id", F.size("packet_seq").alias("packet_slots"), total("packet_mask").alias("packets"), F.size("burst_seq").alias("burst_slots"), total("burst_mask").alias("bursts"), total("burst_seq", 1).alias("packets_in_bursts"), total("packet_seq", 9).alias("burst_ids"), total("packet_seq", 2).alias("directions"))


NAMED = "CASE upper(c) " + " ".join(f"WHEN '{t}' THEN '{t}'" for t in labels.WINDOW_APPLICATIONS) + " " + " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in labels.TOKENS.items() if n not in labels.WINDOW_APPLICATIONS) + " END"


@query(f"""WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'vpn' WHEN event_id % 11 = 0 THEN 'Quic' WHEN event_id % 3 = 0 THEN 'none' END AS tl, CASE event_id % 9 WHEN 0 THEN 'skype' WHEN 4 THEN 'Youtube' WHEN 5 THEN 'chat' END AS c, CASE user_id % 3 WHEN 0 THEN 'VPN/imap.csv' WHEN 1 THEN 'tor/gaming/x.csv' ELSE 'plain/ftp.csv' END AS path FROM events),
n AS (SELECT *, CASE WHEN upper(tl) IN ('VPN', 'OTHER', 'TOR', 'QUIC') THEN upper(tl) END AS t, {NAMED} AS a FROM c),
g AS (SELECT user_id, arg_min(t, event_id) FILTER (t IS NOT NULL) AS t, arg_min(a, event_id) FILTER (a IS NOT NULL) AS a FROM n GROUP BY 1)
SELECT user_id, coalesce(t, CASE user_id % 3 WHEN 0 THEN 'VPN' WHEN 1 THEN 'TOR' ELSE 'OTHER' END) AS primary_label, CASE WHEN coalesce(t, CASE user_id % 3 WHEN 0 THEN 'VPN' WHEN 1 THEN 'TOR' ELSE 'OTHER' END) = 'OTHER' THEN 'UNKNOWN' ELSE coalesce(a, CASE user_id % 3 WHEN 0 THEN 'MAIL' WHEN 1 THEN 'GAMING' ELSE 'FILE' END) END AS secondary FROM g""")
def q_file_labels(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(i % 7 == 0, "vpn").when(i % 11 == 0, "Quic").when(i % 3 == 0, "none").alias("traffic_label"), F.when(i % 9 == 0, "skype").when(i % 9 == 4, "Youtube").when(i % 9 == 5, "chat").alias("app"),
        F.when(u % 3 == 0, "VPN/imap.csv").when(u % 3 == 1, "tor/gaming/x.csv").otherwise("plain/ftp.csv").alias("path"),
    )
    return labels.file_labels(rows, "user_id", "path", ["event_id"]).withColumnRenamed("primary", "primary_label")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS variant_id FROM events")
def q_variant_ordinal(spark, sf):
    return micro.variant_ordinal(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("variant_id").cast("long").alias("variant_id"))


@query("SELECT vec_id, 100 AS slots, 1.0::DOUBLE AS filled, round(list_sum(embedding[1:20])::DOUBLE, 3) AS total FROM embeddings")
def q_feature_bag(spark, sf):
    own, mask = micro.bag(F.col("embedding"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", own.alias("b"), mask.alias("m")).select("vec_id", F.size("b").alias("slots"), add("m").alias("filled"), F.round(add(F.flatten("b")), 3).alias("total"))


@query("""WITH m AS (SELECT vec_id, list_transform(range(1, 33), lambda i: CASE WHEN (i + vec_id) % 3 = 0 THEN -10000.0::DOUBLE ELSE least(greatest(embedding[i + 32]::DOUBLE, -10000.0), 10000.0) END) AS s, embedding AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: e[i]::DOUBLE * exp(s[i] - list_max(s)))) / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS pooled FROM m""")
def q_masked_pool(spark, sf):
    part = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    mask = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.when((i + F.col("vec_id")) % 3 == 0, 0).otherwise(1))
    return table(spark, sf, "embeddings").select("vec_id", r6(ml.attention_pool(part(1), ml.masked(part(33), mask)), "pooled"))


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, CASE WHEN r <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM r")
def q_stratified_split(spark, sf):
    return ml.stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id").select("vec_id", "label", "split")
