"""Forward passes of the two-branch classifier on batches of sequences, in numpy.

Weights are a dictionary of arrays, as saved by whatever trained them; score() sends it to the executors and
gives each sample's class scores.  A linear layer `x` has x.w [out, in] and x.b [out].
"""

from __future__ import annotations

import math

import numpy as np


def linear(p: dict, name: str, x: np.ndarray) -> np.ndarray:
    return x @ p[f"{name}.w"].T + p[f"{name}.b"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x**2).mean(-1, keepdims=True) + eps) * weight


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * weight + bias


def depthwise(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A convolution along each feature on its own; kernel [features, odd width]."""
    half = kernel.shape[1] // 2
    wide = np.pad(x, ((0, 0), (half, half), (0, 0)))
    return sum(wide[:, i : i + x.shape[1]] * kernel[:, i] for i in range(kernel.shape[1])) + bias


def recurrent_block(p: dict, name: str, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """A gated linear recurrence: state' = A state + B update, read out by C."""
    inner = linear(p, f"{name}.in", depthwise(rms_norm(x, p[f"{name}.norm"]), p[f"{name}.conv"], p[f"{name}.conv_bias"]))
    update, gate = np.split(inner, 2, axis=-1)
    a, b, c = p[f"{name}.A"], p[f"{name}.B"], p[f"{name}.C"]
    state, out = np.zeros((len(x), len(a))), np.empty_like(update)
    for t in range(x.shape[1]):
        state = state @ a.T + update[:, t] @ b.T
        out[:, t] = state @ c.T
    if mask is not None:
        out = out * mask[:, :, None]
    return x + linear(p, f"{name}.out", out * sigmoid(gate))


def attention_pool(x: np.ndarray, query: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """A weighted sum over places; masked places weigh next to nothing."""
    s = x @ query
    if mask is not None:
        s = np.where(mask == 0, -1e4, s)
    w = softmax(np.clip(s, -1e4, 1e4), 1)
    return (x * w[:, :, None]).sum(1)


def positions(n: int, width: int) -> np.ndarray:
    """Sines and cosines of places, in turn."""
    angle = np.arange(n)[:, None] * np.exp(np.arange(0, width, 2) * (-math.log(10_000.0) / width))
    out = np.zeros((n, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)[:, : width // 2]
    return out


def self_attention(p: dict, name: str, x: np.ndarray, mask: np.ndarray | None, heads: int) -> np.ndarray:
    many, places, width = x.shape
    q, k, v = (y.reshape(many, places, heads, width // heads).transpose(0, 2, 1, 3) for y in np.split(linear(p, f"{name}.qkv", x), 3, axis=-1))
    s = q @ k.transpose(0, 1, 3, 2) / math.sqrt(width // heads)
    if mask is not None:
        s = np.where(mask[:, None, None, :] == 0, -1e30, s)
    return linear(p, f"{name}.proj", (softmax(s) @ v).transpose(0, 2, 1, 3).reshape(many, places, width))


def encoder_block(p: dict, name: str, x: np.ndarray, mask: np.ndarray | None, heads: int) -> np.ndarray:
    x = layer_norm(x + self_attention(p, name, x, mask, heads), p[f"{name}.n1.w"], p[f"{name}.n1.b"])
    inner = np.maximum(linear(p, f"{name}.ff1", x), 0)
    return layer_norm(x + linear(p, f"{name}.ff2", inner), p[f"{name}.n2.w"], p[f"{name}.n2.b"])


def packet_branch(p: dict, x: np.ndarray, mask: np.ndarray | None, layers: int) -> np.ndarray:
    x = linear(p, "packet.embed", x)
    for i in range(layers):
        x = recurrent_block(p, f"packet.{i}", x, mask)
    return attention_pool(rms_norm(x, p["packet.norm"]), p["packet.query"], mask)


def burst_branch(p: dict, x: np.ndarray, mask: np.ndarray | None, layers: int, heads: int) -> np.ndarray:
    x = linear(p, "burst.embed", x)
    x = x + positions(x.shape[1], x.shape[2])
    for i in range(layers):
        x = encoder_block(p, f"burst.{i}", x, mask, heads)
    return attention_pool(layer_norm(x, p["burst.norm.w"], p["burst.norm.b"]), p["burst.query"], mask)


def fuse(p: dict, a: np.ndarray, b: np.ndarray, mode: str = "gated", fixed: float = 0.5) -> np.ndarray:
    a, b = linear(p, "fuse.packet", a), linear(p, "fuse.burst", b)
    if mode == "concat":
        return linear(p, "fuse.concat", np.concatenate([a, b], -1))
    gate = {"micro_only": 1.0, "burst_only": 0.0, "fixed": fixed, "gated": None}[mode]
    gate = sigmoid(a + b) if gate is None else gate
    return gate * a + (1 - gate) * b


def head(p: dict, x: np.ndarray) -> np.ndarray:
    return linear(p, "head.2", np.maximum(linear(p, "head.1", x), 0))


def _mask(mask, places: int):
    """A mask of zeros and ones for all places; one for the whole sample is spread over them."""
    if mask is None:
        return None
    mask = (np.asarray(mask) > 0).astype(float)
    if mask.ndim != 2 or mask.shape[1] not in (1, places):
        raise ValueError(f"a mask of shape {mask.shape} doesn't fit {places} places")
    return np.broadcast_to(mask, (len(mask), places))


def features(p: dict, packet_seq, burst_seq, packet_mask=None, burst_mask=None, mode: str = "gated", fixed: float = 0.5, layers: tuple[int, int] = (1, 1), heads: int = 4) -> np.ndarray:
    packet_seq, burst_seq = np.asarray(packet_seq, float), np.asarray(burst_seq, float)
    if burst_seq.ndim == 2:
        burst_seq = burst_seq[:, None, :]
    if packet_seq.ndim != 3 or burst_seq.ndim != 3:
        raise ValueError(f"sequences of shapes {packet_seq.shape} and {burst_seq.shape}")
    a = packet_branch(p, packet_seq, _mask(packet_mask, packet_seq.shape[1]), layers[0])
    b = burst_branch(p, burst_seq, _mask(burst_mask, burst_seq.shape[1]), layers[1], heads)
    return fuse(p, a, b, mode, fixed)


def weights(packet_width: int, burst_width: int, classes: int, width: int = 32, hidden: int = 32, state: int = 16, layers: tuple[int, int] = (1, 1), seed: int = 0) -> dict:
    """Random weights of the right shapes, to start from."""
    rng = np.random.default_rng(seed)
    p: dict = {}

    def lin(name, i, o):
        p[f"{name}.w"], p[f"{name}.b"] = rng.normal(0, i**-0.5, (o, i)), np.zeros(o)

    lin("packet.embed", packet_width, width)
    lin("burst.embed", burst_width, width)
    for i in range(layers[0]):
        n = f"packet.{i}"
        lin(f"{n}.in", width, 2 * width)
        lin(f"{n}.out", width, width)
        p |= {f"{n}.norm": np.ones(width), f"{n}.conv": rng.normal(0, 0.5, (width, 3)), f"{n}.conv_bias": np.zeros(width), f"{n}.A": rng.normal(0, 0.01, (state, state)), f"{n}.B": rng.normal(0, 0.01, (state, width)), f"{n}.C": rng.normal(0, 0.01, (width, state))}
    for i in range(layers[1]):
        n = f"burst.{i}"
        for part, a, b in (("qkv", width, 3 * width), ("proj", width, width), ("ff1", width, 2 * width), ("ff2", 2 * width, width)):
            lin(f"{n}.{part}", a, b)
        p |= {f"{n}.{x}.{y}": np.ones(width) if y == "w" else np.zeros(width) for x in ("n1", "n2") for y in ("w", "b")}
    p |= {"packet.norm": np.ones(width), "packet.query": rng.normal(size=width), "burst.norm.w": np.ones(width), "burst.norm.b": np.zeros(width), "burst.query": rng.normal(size=width)}
    for name, a, b in (("fuse.packet", width, hidden), ("fuse.burst", width, hidden), ("fuse.concat", 2 * hidden, hidden), ("head.1", hidden, max(1, hidden // 2)), ("head.2", max(1, hidden // 2), classes)):
        lin(name, a, b)
    return p


def score(df, p: dict, **options):
    """sample_key, scores array<double>, pred_id int of samples with packet_seq, packet_mask, burst_seq, burst_mask."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(p)  # a model's weights

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            args = [np.array(batch.column(i).to_pylist(), float) for i in range(1, 5)]
            got = head(sent.value, features(sent.value, args[0], args[2], args[1], args[3], **options))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.tolist(), pa.list_(pa.float64())), pa.array(got.argmax(1), pa.int32())], ["sample_key", "scores", "pred_id"])

    return df.select("sample_key", "packet_seq", "packet_mask", "burst_seq", "burst_mask").mapInArrow(run, "sample_key string, scores array<double>, pred_id int")
