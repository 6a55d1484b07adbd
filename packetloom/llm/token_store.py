"""Token ids in a binary format of patched frame-of-reference blocks.

One file image holds whole documents in order (all numbers little-endian):

    "PFOR0001" | n_docs u32 | n_blocks u32 | n_ids u64
    doc_id i64 * n_docs | first id of each document u64 * (n_docs + 1)
    start of each block u64 * (n_blocks + 1), from the first block's first byte
    blocks of 256 ids: minimum u32 | width u8 | 0 u8 | exceptions u16
        | 256 offsets from the minimum at `width` bits (low bits) | exception places u8 | full offsets u32

A block's width is that of its 90th percentile; larger offsets are patched from the exception list.
The last block is padded with its last id.  A document or a block is found through the two indexes
without reading the others.

Nulls: a null text is empty and has the end id only; a null doc_id comes first and is kept as null
(its number in the image is the smallest i64).  Repeated rows are all kept; equal doc_ids are in the order
of a hash of their texts, so that they need not all be in one part.
Empty tables give no images.  Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, tokens

BLOCK = 256
PERCENTILE = 90
MAGIC = b"PFOR0001"
NO_ID = -(1 << 63)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 numbers below 2**width as rows of 32 * width bytes; each 32 numbers fill `width` words."""
    v = values.reshape(-1, 8, 32).astype(np.uint32)
    out = np.zeros((len(v), 8, width), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, :, word] |= v[:, :, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= v[:, :, i] >> np.uint32(32 - shift)
    return out.reshape(len(v), -1).view(np.uint8).reshape(len(v), 32 * width)


def unpack(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(raw).view(np.uint32).reshape(-1, 8, width)
    out = np.zeros((len(words), 8, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        x = words[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | (words[:, :, word + 1] << np.uint32(32 - shift))
        out[:, :, i] = x & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """(bytes of all blocks, start of each block and the end)."""
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return b"", np.zeros(1, np.uint64)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    off = full - low[:, None]
    k = min(BLOCK - 1, BLOCK * percentile // 100)
    at = np.partition(off, k, axis=1)[:, k].astype(np.float64)
    width = np.ceil(np.log2(at + 1)).astype(np.int64)
    big = off.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    patched = big.sum(1)
    start = np.concatenate([[0], np.cumsum(8 + 32 * width + 5 * patched)])
    out = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4] = width
    head[:, 6:] = patched.astype("<u2").view(np.uint8).reshape(n, 2)
    out[start[:-1, None] + np.arange(8)] = head
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        kept = off[own] & np.uint32((1 << w) - 1)
        out[(start[own] + 8)[:, None] + np.arange(32 * w)] = pack(kept, w)
    block, place = np.nonzero(big)
    if len(block):
        rank = np.arange(len(block)) - np.concatenate([[0], np.cumsum(patched)])[block]
        base = start[block] + 8 + 32 * width[block]
        out[base + rank] = place
        out[(base + patched[block] + 4 * rank)[:, None] + np.arange(4)] = off[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start.astype(np.uint64)


def decode_blocks(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of all blocks, 256 each."""
    start = start.astype(np.int64)
    n = len(start) - 1
    if n == 0:
        return np.empty(0, np.uint32)
    head = raw[start[:-1, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width = head[:, 4].astype(np.int64)
    patched = np.ascontiguousarray(head[:, 6:]).view("<u2").ravel().astype(np.int64)
    off = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        off[own] = unpack(raw[(start[own] + 8)[:, None] + np.arange(32 * w)], w)
    block = np.repeat(np.arange(n), patched)
    if len(block):
        rank = np.arange(len(block)) - np.concatenate([[0], np.cumsum(patched)])[block]
        base = start[block] + 8 + 32 * width[block]
        value = raw[(base + patched[block] + 4 * rank)[:, None] + np.arange(4)]
        off[block, raw[base + rank]] = np.ascontiguousarray(value).view("<u4").ravel()
    return (off + low[:, None]).ravel()


def write_image(doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    blocks, index = encode_blocks(ids)
    return b"".join([MAGIC, struct.pack("<IIQ", len(doc_ids), len(index) - 1, len(ids)), doc_ids.astype("<i8").tobytes(), bounds.astype("<u8").tobytes(), index.astype("<u8").tobytes(), blocks])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids, bounds) of a file image."""
    if image[:8] != MAGIC:
        raise ValueError("not a PFOR0001 image")
    docs, blocks, n = struct.unpack_from("<IIQ", image, 8)
    at = 24
    doc_ids = np.frombuffer(image, "<i8", docs, at)
    bounds = np.frombuffer(image, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
    index = np.frombuffer(image, "<u8", blocks + 1, at := at + 8 * (docs + 1))
    raw = np.frombuffer(image, np.uint8, offset=at + 8 * (blocks + 1))
    return doc_ids, decode_blocks(raw, index)[:n], bounds


def read_document(image: bytes, k: int) -> np.ndarray:
    """The ids of the k-th document of an image, from its own blocks only."""
    docs, blocks, _ = struct.unpack_from("<IIQ", image, 8)
    at = 24 + 8 * docs
    a, b = (int(x) for x in np.frombuffer(image, "<u8", 2, at + 8 * k))
    index = np.frombuffer(image, "<u8", blocks + 1, at + 8 * (docs + 1))
    first, last = a // BLOCK, -(-b // BLOCK)
    raw = np.frombuffer(image, np.uint8, offset=at + 8 * (docs + 1) + 8 * (blocks + 1))
    return decode_blocks(raw, index[first : last + 1])[a - first * BLOCK : b - first * BLOCK]


def images(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """part int, first long (ids of the part before this image), n_docs, n_ids long, image binary.

    Documents are range-partitioned by doc_id, so parts, and images within a part, ascend."""
    shared.ship(docs.sparkSession)
    kind = "part int, first long, n_docs long, n_ids long, image binary"

    def write(batches):
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, j, ids, bounds in tokens.encode_column(batch.column(1), vocabulary, end_id):
                image = write_image(doc_ids[i:j], ids, bounds)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (first, j - i, len(ids))), pa.array([image], pa.binary())], ["part", "first", "n_docs", "n_ids", "image"])
                first += len(ids)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    th = F.xxhash64("text")
    return own.repartitionByRange("doc_id", th).sortWithinPartitions("doc_id", th, "text").mapInArrow(write, kind)


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from file images as images() returns them."""
    spark = stored.sparkSession
    shared.ship(spark)
    # one row for each partition of the writing job
    totals = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, base = 0, []
    for part, n in totals:
        base.append((part, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(base or [(0, 0)], "part int, base long"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, ids, bounds = read_image(image.as_buffer().to_pybytes())
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = (bounds * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), pa.array(first + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.join(bases, "part").select((F.col("base") + F.col("first")).alias("first"), "image").mapInArrow(read, kind)


def export_files(stored: DataFrame, local_dir: str) -> int:
    """Writes every image as its own file part-PPPPP-FFFFFFFFFFFF.pfor on the driver's machine, one at a time."""
    import os

    os.makedirs(local_dir, exist_ok=True)
    n = 0
    for r in stored.select("part", "first", "image").toLocalIterator():
        with open(os.path.join(local_dir, f"part-{r['part']:05d}-{r['first']:012d}.pfor"), "wb") as f:
            f.write(r["image"])
        n += 1
    return n


def op5_token_store(spark, sf_dir) -> DataFrame:
    return digest(shared.stage(images(shared.documents(spark, sf_dir), tokens.vocabulary())))
