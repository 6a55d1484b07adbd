"""The sessioniser over a stream: each flow's state is its session number, last time and whether it closed.

Rows of a flow are taken in the order of their frame numbers within a micro-batch, and micro-batches in
the order in which they come.  A late row therefore belongs to the session that is open when it arrives;
time that goes back never opens a session.  State is kept until `idle` (a duration text) without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

OUT = "flow_id long, frame_index long, session long"
STATE = "session long, last double, closed boolean"


def sessionize_stream(df: DataFrame, timeout: float, idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """df: flow_id long, frame_index long, t double, tcp_flags int, protocol int."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        session, last, closed = state.get if state.exists else (0, None, False)
        rows = pd.concat(list(frames)).sort_values("frame_index", kind="stable")
        out = []
        for frame, t, flags, protocol in zip(rows["frame_index"], rows["t"], rows["tcp_flags"], rows["protocol"]):
            if last is not None and (closed or t - last > timeout):
                session += 1
            last, closed = float(t), bool(protocol == 6 and flags & 5)
            out.append((key[0], frame, session))
        state.update((int(session), last, closed))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["flow_id", "frame_index", "session"])

    return df.groupBy("flow_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
