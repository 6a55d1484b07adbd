"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into full pieces and a rest.  Pieces are range-sorted by length
(ties by a hash, so that a length that a third of all pieces have is still dealt out evenly) and get
their rank among the pieces of their length.  They are placed in bulk-synchronous rounds, from the
longest length to the shortest.  In a round, all pieces of one length are matched at once with the gaps,
which are kept sorted: a sweep over the successors (the smallest gaps that fit, then the next) gives every
gap as many pieces as it holds; pieces compete by rank, the lower rank gets the smaller gap; all gaps are
updated, and the next round begins.  Pieces that no gap holds open new sequences.  Since equal lengths
and equal gaps are interchangeable, the sweep works on runs: (length, ranks from..to) and (gap, sequences
from..to), at most as many as there are lengths, whatever the corpus.  The sweep therefore takes place on
the driver, while the sort, the ranks and the places, which do depend on the corpus, are made on the
executors.  The result is exactly best-fit decreasing.

Nulls: a null text is empty and gives one piece (the end id); a null doc_id stays null.  Repeated rows
are all packed.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import shared, tokens

CAPACITY = 4096


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece.  One pass, no shuffle."""
    shared.ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        for batch in batches:
            doc_ids = batch.column(0)
            for i, j, ids, bounds in tokens.encode_column(batch.column(1), vocabulary, end_id):
                n = np.diff(bounds)
                many = -(-n // capacity)
                row = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = ((bounds[row] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(first, (length * 4).tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(i + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length int, ids_crc32 long")


def ranked(cut: DataFrame) -> DataFrame:
    """pieces() in the order of their lengths, with part (ascending) and place, a piece's rank among those of
    its length in its part."""
    kind = T.StructType([*cut.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            if not len(length):
                continue
            place = np.arange(len(length)) - np.searchsorted(length, length)
            place[length == last] += seen
            last, seen = length[-1], place[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(place)], kind.fieldNames())

    salt = F.xxhash64("doc_id", "piece", "ids_crc32")
    return cut.repartitionByRange("length", salt).sortWithinPartitions("length").mapInArrow(number, kind)


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for counts[length] pieces of each length, as rows (length, first rank, pieces, first
    sequence, pieces in each sequence, offset of the first piece there), by length and rank."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    order: list[int] = []  # the gaps that there are, ascending
    opened, out = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, fresh = counts[length], 0, []
        at = bisect.bisect_left(order, length)
        while left:
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            whole = min(n, left // each)
            for run, per in ((whole, each), (min(1, n - whole), left - whole * each)):
                if run and per and left:
                    take = run * per
                    out.append((length, rank, take, first, per, capacity - gap))
                    fresh.append((gap - per * length, first, run))
                    left, rank, first, n = left - take, rank + take, first + run, n - run
            put(gap, first, n)
        for x in fresh:  # gaps are updated when the round is over
            put(*x)
    table = np.array(out, np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ranked() (staged: it is read twice)."""
    shared.ship(placed.sparkSession)
    # parts are ranges of lengths: there are fewer rows than lengths and parts together
    counts: dict[int, int] = {}
    bases: dict[tuple[int, int], int] = {}
    for r in placed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).orderBy("part", "length").collect():
        bases[r["part"], r["length"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    table = rounds(counts, capacity)
    stride = np.int64(1) << 48
    kind = T.StructType([*(f for f in placed.schema if f.name not in ("part", "place")), *(T.StructField(x, T.LongType()) for x in ("sequence_id", "offset"))])
    names = kind.fieldNames()[:-2]
    parts = sorted(bases)
    of_part = np.array([p * stride + n for p, n in parts], np.int64)
    base = np.array([bases[x] for x in parts], np.int64)

    def place(batches):
        key = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            part, length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("part", "length", "place"))
            rank = rank + base[np.searchsorted(of_part, part * stride + length)]
            at = np.searchsorted(key, length * stride + rank, "right") - 1
            k = rank - table[at, 1]
            per = np.maximum(table[at, 4], 1)
            sequence, offset = table[at, 3] + k // per, table[at, 5] + (k % per) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(sequence), pa.array(offset)], kind.fieldNames())

    return placed.mapInArrow(place, kind)


def best_fit(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(shared.stage(ranked(shared.stage(pieces(docs, vocabulary or tokens.vocabulary(), capacity)))), capacity)


def op1_best_fit_packing(spark, sf_dir) -> DataFrame:
    out = best_fit(shared.documents(spark, sf_dir))
    return out.withColumn("length", F.col("length").cast("long"))
