"""Twenty features of each packet from the few packets before it (trailing frames)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import casts


def micro20(df: DataFrame, flow: list[str], order: list[str]) -> DataFrame:
    """f0..f19 for rows with packet_length, dir01 (0 forward, 1 back), iat and flags (text)."""
    w = Window.partitionBy(*flow).orderBy(*order)
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    length = F.col("packet_length").cast("double")
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*flow)), "_turn": F.coalesce((F.col("dir01") != F.lag("dir01").over(w)).cast("int"), F.lit(0)), "_jump": F.coalesce((F.abs(length - F.lag(length).over(w)) > 100).cast("int"), F.lit(0))})
    df = df.withColumn("_island", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_run", F.row_number().over(Window.partitionBy(*flow, "_island").orderBy(*order)))
    i, late3, late5 = F.col("_i"), F.col("_i") >= 2, F.col("_i") >= 4
    when = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    total = F.sum(length).over(last(3))
    a, b = F.lag(length, 1).over(w), F.lag(length, 2).over(w)
    two = -(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3)
    entropy = F.when((length == a) & (a == b), 0.0).when((length != a) & (a != b) & (length != b), math.log(3)).otherwise(two)
    share = lambda c: F.avg(c.cast("double")).over(last(3))
    quarter = lambda p: F.percentile(length, p).over(last(5)) / 1500
    feats = {
        "f0": when(length > 0, F.log10(length + 1) / 4), "f1": F.col("dir01").cast("double"), "f2": length / 1500 * F.when(F.col("dir01") == 0, 1).otherwise(-1),
        "f3": when(F.col("iat") > 0, F.log10(F.col("iat") * 1000 + 1) / 3), "f4": when(late3, F.least(F.col("_run") / 10, F.lit(1.0))),
        "f5": when(late3, F.sum((F.col("iat") < 0.01).cast("int")).over(last(5)) / 5), "f6": when(late3, F.sum("_turn").over(last(9)) / 10),
        "f7": when(late5, quarter(0.25)), "f8": when(late5, quarter(0.75)), "f9": when(late5, F.sum("_jump").over(last(4)) / 4),
        # the last packet is counted against itself, too
        "f10": when(late5, F.least(F.lit(5), F.least(F.col("_run"), F.lit(4)) + 1) / 5),
        "f11": F.col("flags").contains("SYN").cast("double"), "f12": F.col("flags").contains("ACK").cast("double"), "f13": (F.col("flags").contains("FIN") | F.col("flags").contains("RST")).cast("double"),
        "f14": i / F.greatest(F.col("_n") - 1, F.lit(1)), "f15": (i < 5).cast("double"), "f16": when(late3, entropy / 2),
        "f17": when(late3, share(length < 100)), "f18": when(late3, share(length > 1000)), "f19": when(late3 & (total > 0), F.sum(F.greatest(length - 20, F.lit(0.0))).over(last(3)) / F.when(total > 0, total)),
    }
    return df.withColumns(feats).withColumnRenamed("_i", "pos").drop("_n", "_turn", "_jump", "_island", "_run")


def time_split(df: DataFrame, flow: list[str], variants: int, length: int) -> DataFrame:
    """Segments of each flow's packets (rows with pos from 0): variant v begins at v * floor(n / variants)
    and has up to `length` packets; a flow of at most `length` packets is every variant whole."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*flow))
    out = df.withColumn("_n", n).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    start = F.when(F.col("_n") > length, F.col("variant") * F.floor(F.col("_n") / variants)).otherwise(F.lit(0))
    return out.withColumn("step", F.col("pos") - start).where((F.col("step") >= 0) & (F.col("step") < length)).drop("_n")


#: The columns of a window's packet vector, and what stands where a table has no such column.
WINDOW_FEATURES = (
    "packet_length", "payload_length", "src_port", "dst_port", "protocol", "ip_version", "ip_ttl", "tcp_flags", "tcp_window", "icmp_type", "icmp_code",
    "esp_spi", "ah_spi", "gre_protocol", "direction", "normalized_time", "inter_arrival", "length_ratio", "payload_ratio", "is_tcp",
)
MISSING = {"src_port": -1, "dst_port": -1, "ip_version": 4, "icmp_type": -1, "icmp_code": -1}


def window_packets(df: DataFrame, window: list[str], order: list[str], n: int = 64, t: str = "t") -> DataFrame:
    """The first n packets of each window, `pos` from 0, with the 20 columns of their vector; whole numbers are
    read from text or numbers, and columns the table doesn't have get their usual value."""
    w = Window.partitionBy(*window).orderBy(*order)
    whole = {c: casts.to_int(F.col(c), MISSING.get(c, 0)) if c in df.columns else F.lit(MISSING.get(c, 0)).cast("long") for c in WINDOW_FEATURES[:15]}
    cut = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).where(F.col("pos") < n).withColumns(whole)
    own = Window.partitionBy(*window).orderBy("pos")
    length, pay = F.col("packet_length"), F.col("payload_length")
    return cut.withColumns({
        "normalized_time": F.col(t) - F.first(t).over(own), "inter_arrival": F.coalesce(F.col(t) - F.lag(t).over(own), F.lit(0.0)),
        "length_ratio": F.when(length != 0, pay / F.when(length != 0, length)).otherwise(0.0), "payload_ratio": pay / float(n), "is_tcp": (F.col("protocol") == 6).cast("int"),
    }).select(*window, "pos", *WINDOW_FEATURES)


def bag(vector: Column, size: int = 100, width: int = 20) -> tuple[Column, Column]:
    """(bag of `size` vectors with the given one, cut or filled to `width`, in the first place; its mask)."""
    zero = F.lit(0.0).cast("float")
    own = F.slice(F.concat(F.transform(vector, lambda x: x.cast("float")), F.array_repeat(zero, width)), 1, width)
    return F.concat(F.array(own), F.array_repeat(F.array_repeat(zero, width), size - 1)), F.concat(F.array(F.lit(1.0).cast("float")), F.array_repeat(zero, size - 1))


def variant_ordinal(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """variant_id: a row's number among the rows of its key, from 0."""
    return df.withColumn("variant_id", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
