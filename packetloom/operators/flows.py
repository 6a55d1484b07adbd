"""Sessions, prefixes, gaps, bursts and flow aggregates over packet rows.

All windows partition by the flow, so a chain of these operators needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sessionize(df: DataFrame, flow: list[str], order: str, t: str, flags: str, protocol: str, timeout: float, out: str = "session") -> DataFrame:
    """Numbers the sessions of each flow in frame order: a new one begins after a gap of more than
    `timeout`, and behind a TCP packet with FIN or RST."""
    w = Window.partitionBy(*flow).orderBy(order)
    closed = F.coalesce((F.lag(protocol).over(w) == 6) & (F.lag(flags).over(w).bitwiseAND(5) != 0), F.lit(False))
    late = F.coalesce(F.col(t) - F.lag(t).over(w) > timeout, F.lit(False))
    return df.withColumn("_new", (closed | late).cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def prefix(df: DataFrame, flow: list[str], order: list[str], n: int) -> DataFrame:
    """The first n packets of each flow, with their place `pos` from 0."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*flow).orderBy(*order))).where(F.col("_rn") <= n).withColumn("pos", F.col("_rn") - 1).drop("_rn")


def gaps(df: DataFrame, flow: list[str], order: list[str], t: str = "t") -> DataFrame:
    """iat: time since the packet before, 0 for the first and where time goes back."""
    w = Window.partitionBy(*flow).orderBy(*order)
    return df.withColumn("iat", F.greatest(F.lit(0.0), F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0))))


def threshold(iat: Column, alpha: float, over=None) -> Column:
    """Aggregate, or with `over` window function: median + alpha * interquartile range of the positive gaps; 0 without any."""
    q = F.percentile(F.when(iat > 0, iat), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = q if over is None else q.over(over)
    return F.coalesce(q[1] + F.lit(alpha) * (q[2] - q[0]), F.lit(0.0))


def bursts(df: DataFrame, flow: list[str], order: list[str], alpha: float = 1.0, fixed: float | None = None) -> DataFrame:
    """burst: number of the burst of each packet of rows that have iat.  A burst ends where the direction
    changes or the gap is above the threshold (of this flow's rows, or `fixed`)."""
    all_, w = Window.partitionBy(*flow), Window.partitionBy(*flow).orderBy(*order)
    df = df.withColumn("threshold", F.lit(float(fixed)) if fixed is not None else threshold(F.col("iat"), alpha, all_))
    change = F.coalesce((F.col("direction") != F.lag("direction").over(w)) | (F.col("iat") > F.col("threshold")), F.lit(False))
    return df.withColumn("_new", change.cast("int")).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def observed(df: DataFrame, flow: list[str], n: int, alpha: float = 1.0, fixed: float | None = None, order: tuple[str, ...] = ("t", "frame_index")) -> DataFrame:
    """Prefix, gaps and bursts, in this order: nothing behind the prefix has any influence."""
    return bursts(gaps(prefix(df, flow, list(order), n), flow, ["pos"]), flow, ["pos"], alpha, fixed)


def burst_rows(df: DataFrame, flow: list[str], cap: int) -> DataFrame:
    """One row for each of the first `cap` bursts: 12 features.  The gap before a burst's first packet
    counts among the burst's gaps."""
    by = [*flow, "burst"]
    agg = df.groupBy(*by).agg(
        F.min_by("direction", "pos").alias("burst_direction"), F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("byte_sum"),
        (F.max("t") - F.min("t")).alias("duration"), F.avg("packet_length").alias("mean_len"), F.stddev_pop("packet_length").alias("std_len"),
        F.avg("iat").alias("_all"), F.avg(F.when(F.col("iat") > 0, F.col("iat"))).alias("mean_iat"), F.stddev_pop(F.when(F.col("iat") > 0, F.col("iat"))).alias("std_iat"),
        F.max("iat").alias("max_iat"), F.min_by("iat", "pos").alias("gap"), F.min("pos").alias("first_pos"),
    ).drop("_all")
    many = F.max("burst").over(Window.partitionBy(*flow))
    out = agg.withColumn("is_first", (F.col("burst") == 0).cast("int")).withColumn("is_last", (F.col("burst") == F.least(many, F.lit(cap - 1))).cast("int"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("mean_iat", "std_iat")}
    return out.where(F.col("burst") < cap).withColumns(zero)


def packet_rows(df: DataFrame, flow: list[str]) -> DataFrame:
    """Adds each packet's place in its burst, and its burst's size, bytes and duration."""
    b = Window.partitionBy(*flow, "burst")
    at = F.row_number().over(b.orderBy("pos"))
    size = F.count(F.lit(1)).over(b)
    return df.withColumns({
        "pos_in_burst": at - 1, "burst_size": size, "burst_bytes": F.sum("packet_length").over(b), "is_burst_start": (at == 1).cast("int"),
        "is_burst_end": (at == size).cast("int"), "burst_duration": F.max("t").over(b) - F.min("t").over(b),
    })


def flow_rows(df: DataFrame, flow: list[str]) -> DataFrame:
    """One row for each flow: packets, bytes, times and the first packet's protocol; null flows go."""
    for c in flow:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*flow).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("packet_length").alias("byte_count"), F.min("t").alias("start_time"), F.max("t").alias("end_time"),
        (F.max("t") - F.min("t")).alias("duration"), F.min_by("protocol", "frame_index").alias("protocol"),
    )


def hop_windows(df: DataFrame, flow: list[str], width: float, hop: float) -> DataFrame:
    """A row for each packet and window that holds it: windows [k * hop, k * hop + width) from the flow's
    first packet on, that begin no later than its last packet."""
    w = Window.partitionBy(*flow)
    df = df.withColumn("_dt", F.col("t") - F.min("t").over(w)).withColumn("_end", F.max("t").over(w) - F.min("t").over(w))
    last = F.floor(F.col("_dt") / hop)
    first = F.greatest(F.lit(0), F.floor((F.col("_dt") - width) / hop) + 1)
    return df.withColumn("k", F.explode(F.sequence(first, last))).where(F.col("k") * hop <= F.col("_end")).drop("_end").withColumnRenamed("_dt", "since_start")
