"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity.

Texts are lower-cased and cut into words (runs of letters, digits and code points beyond ASCII), words
into shingles of five.  A shingle weighs ln(1 + N / n) for n of the N items having it (n = 1 for one
that no item has).  A document leaks an item if some window of as many words as the item (or the whole
document, where it is shorter) has a weighted multiset Jaccard similarity of `threshold` or more to it.

1. Windows.  Both the window's and the union's weight are at most the shared weight over the threshold;
   windows whose shingles of any item weigh less than that share are left out.  This loses nothing.
2. The others get 128-bit SimHash fingerprints.  Items within RADIUS bits are found by a multi-index:
   the bits are cut into RADIUS + 1 blocks, and two fingerprints within the radius agree in one block at
   least, so looking up all blocks finds all of them.  (At similarity 0.8 the expected distance is 19
   bits with a deviation of 4; unrelated texts differ in 64.)
3. Candidates are verified by their exact similarity, so collisions of fingerprints don't count.

Items with fewer words than five are one shingle; items without words match nothing.  Items are sent
out in blocks of at most BLOCK_WORDS words, one pass over the documents for each, so what is broadcast
is bounded whatever the benchmark's size.  N and n are counted over all blocks.

Nulls: null texts have no words; null doc_ids and item_ids are kept as null.  Repeated rows and items
each give their rows; empty tables give none.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, textbytes as tb
from .textbytes import U64

K, THRESHOLD = 5, 0.8
BITS, RADIUS = 128, 32
#: Words of benchmark items in one pass.
BLOCK_WORDS = 2_000_000
_BIT = np.arange(64, dtype=np.uint64)
#: Places whose windows are looked at together.
STRIP = 1 << 14


def item_words(texts: list[str]) -> list[np.ndarray]:
    data, offs = tb.buffers(pa.array(texts, pa.string()))
    _, _, row, h = tb.words(data, offs, tb.NOT_WORD)
    at = tb.row_starts(row, len(texts))
    return [h[a:b] for a, b in zip(at, at[1:])]


class Index:
    """The items of one pass."""

    def __init__(self, ids: list, words: list[np.ndarray], weight: dict[int, float], unknown: float, threshold: float = THRESHOLD):
        self.ids, self.threshold, self.unknown = ids, threshold, unknown
        self.size = np.array([len(w) for w in words], np.int64)
        self.k = np.minimum(self.size, K)
        self.grams = [tb.shingles(w, np.zeros(len(w), np.int64), int(k))[0] if k else np.empty(0, np.uint64) for w, k in zip(words, self.k)]
        self.known = np.array(sorted({int(g) for x in self.grams for g in x.tolist()}), np.uint64)
        self.weight = np.array([weight[int(g)] for g in self.known.tolist()])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known >> U64(44)).astype(np.int64)] = True
        prints = [self.fingerprints(x, np.array([0]), np.array([len(x)]))[0] for x in self.grams]
        self.prints = np.array(prints, np.uint8).reshape(len(ids), BITS // 8)
        self.cuts = np.linspace(0, BITS, RADIUS + 2).astype(int)
        self.place = np.concatenate([1 << np.arange(n) for n in np.diff(self.cuts)]).astype(np.int64)
        self.total = np.array([float(self.weights(x)[0].sum()) for x in self.grams])
        #: For each number of words: its items, and for each block and value the items that have it, as bits.
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            items = np.flatnonzero(self.size == size)
            table = np.zeros((RADIUS + 1, 1 << int(np.diff(self.cuts).max()), len(items)), bool)
            for i, codes in enumerate(self.codes(self.prints[items])):
                table[np.arange(RADIUS + 1), codes, i] = True
            self.groups[size] = items, np.packbits(table, axis=2)

    def codes(self, prints: np.ndarray) -> np.ndarray:
        """The values of the blocks of fingerprints."""
        return np.add.reduceat(np.unpackbits(prints, axis=1) * self.place, self.cuts[:-1], axis=1)

    def weights(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every shingle, and whether an item has it."""
        has, w = np.zeros(len(g), bool), np.full(len(g), self.unknown)
        maybe = np.flatnonzero(self.seen[(g >> U64(44)).astype(np.int64)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, g[maybe]), len(self.known) - 1)
            hit = self.known[at] == g[maybe]
            has[maybe[hit]] = True
            w[maybe[hit]] = self.weight[at[hit]]
        return w, has

    def fingerprints(self, g: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """SimHash of g[start:end] for each window, as packed bits."""
        w, _ = self.weights(g)
        total = np.zeros((len(g) + 1, BITS))
        for half in range(BITS // 64):
            bits = ((tb.mix(g + U64(half + 1))[:, None] >> _BIT) & U64(1)).astype(np.float64) * 2 - 1
            np.cumsum(bits * w[:, None], axis=0, out=total[1:, 64 * half : 64 * half + 64])
        return np.packbits(total[end] - total[start] > 0, axis=1)

    def similarity(self, g: np.ndarray, item: int) -> float:
        own, n = np.unique(g, return_counts=True)
        other, m = np.unique(self.grams[item], return_counts=True)
        w, _ = self.weights(own)
        v, _ = self.weights(other)
        _, x, y = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        shared_weight = float((w[x] * np.minimum(n[x], m[y])).sum())
        return shared_weight / (float((w * n).sum()) + float((v * m).sum()) - shared_weight)

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item of `size` words) within RADIUS, by way of the blocks."""
        items, table = self.groups[size]
        codes = self.codes(prints)
        met = np.zeros((len(prints), table.shape[2]), np.uint8)
        for block in range(RADIUS + 1):
            met |= table[block, codes[:, block]]
        at, i = np.nonzero(np.unpackbits(met, axis=1, count=len(items)))
        near = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint64)[at] ^ self.prints.view(np.uint64)[items[i]]).sum(1) <= RADIUS
        return at[near], items[i[near]]

    def scan(self, h: np.ndarray, k: int, g: np.ndarray, w: np.ndarray, has: np.ndarray):
        """(item, first word, words, similarity) of the best (then first) window for every item that a
        document of word hashes h, k-shingles g leaks."""
        best: dict[int, tuple[float, int, int]] = {}
        hit, whole = (np.concatenate([[0], np.cumsum(x)]) for x in (w * has, w))
        for size in np.unique(self.size[self.k == k]).tolist():
            n = min(size, len(h))
            m = n - k + 1
            if m < 1 or (n < size and n < self.threshold * size):
                continue
            shown, own = hit[m:] - hit[:-m], whole[m:] - whole[:-m]
            able = np.flatnonzero(shown >= self.threshold * own - 1e-9)
            for part in np.split(able, np.flatnonzero(np.diff(able // STRIP)) + 1) if len(able) else ():
                step = np.zeros(part[-1] - part[0] + m + 1, np.int64)
                step[part - part[0]] += 1
                step[part - part[0] + m] -= 1
                cover = part[0] + np.flatnonzero(np.cumsum(step) > 0)
                at = np.searchsorted(cover, part)
                window, item = self.candidates(self.fingerprints(g[cover], at, at + m), size)
                start = part[window]
                top = np.minimum(shown[start], self.total[item])
                bound = top / (own[start] + self.total[item] - top)
                for j in np.lexsort((start, -bound)).tolist():
                    i, s = int(item[j]), int(start[j])
                    if bound[j] < max(self.threshold, best[i][0] if i in best else 0) - 1e-9:
                        continue  # no better than what is known
                    sim = self.similarity(g[s : s + m], i)
                    if sim >= self.threshold - 1e-9 and (i not in best or (round(sim, 9), -s) > (round(best[i][0], 9), -best[i][1])):
                        best[i] = (sim, s, n)
        return [(i, s, n, sim) for i, (sim, s, n) in sorted(best.items())]


def _own(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))


def _counts(words: list[np.ndarray]) -> dict[int, int]:
    """How many of the items have each shingle."""
    counts: dict[int, int] = {}
    for x in words:
        k = min(len(x), K)
        for g in set(tb.shingles(x, np.zeros(len(x), np.int64), k)[0].tolist()) if k else ():
            counts[g] = counts.get(g, 0) + 1
    return counts


def _all_counts(benchmark: DataFrame) -> DataFrame:
    """gram, n: the shingles that several items have, over the whole benchmark."""

    def count(batches):
        for batch in batches:
            got = _counts(item_words(batch.column(batch.schema.get_field_index("text")).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(got), np.uint64).view(np.int64)), pa.array(list(got.values()), pa.int64())], ["gram", "n"])

    return shared.stage(_own(benchmark).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"))


def _items(benchmark: DataFrame):
    """Lists of items of a bounded number of words; the driver holds two lists at a time."""
    rows = _own(benchmark).orderBy("item_id", "text")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if ids and size + len(r["text"]) > 4 * BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of every item a document leaks."""
    return _leaks(docs, benchmark, threshold).drop("th")


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """leaks(), with th, by which and by doc_id a row is found again."""
    spark = docs.sparkSession
    shared.ship(spark)
    kind = "doc_id long, th long, item_id long, first_word long, n_words long, similarity double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    out = None
    blocks = _items(benchmark)
    block, after = next(blocks, None), next(blocks, None)
    several = _all_counts(benchmark) if after else None
    total = benchmark.count() if after else len(block[0]) if block else 0
    while block:
        ids, texts = block
        block, after = after, next(blocks, None)
        words = item_words(texts)
        counts = _counts(words)
        if several is not None:
            grams = spark.createDataFrame(pa.table({"gram": np.array(list(counts), np.uint64).view(np.int64)}))
            for r in several.join(grams, "gram").toLocalIterator():
                counts[r["gram"] % (1 << 64)] = r["n"]
        weight = {g: float(np.log(1 + total / n)) for g, n in counts.items()}
        unknown = float(np.log(1 + total))
        send = spark.sparkContext.broadcast((ids, words, weight, unknown, threshold))

        def run(batches, send=send):
            index = Index(*send.value)
            kinds = sorted(set(index.k[index.k > 0].tolist()))
            for batch in batches:
                data, offs = tb.buffers(batch.column(1))
                doc, item, first, n, sim = [], [], [], [], []
                for i, j in tb.row_slices(offs):
                    _, _, row, h = tb.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tb.NOT_WORD)
                    for k in kinds:
                        g, at = tb.shingles(h, row, k)
                        w, has = index.weights(g)
                        for r in np.unique(row[at[has]]).tolist():
                            a, b = np.searchsorted(row, (r, r + 1))
                            x, y = np.searchsorted(at, (a, b))
                            for got in index.scan(h[a:b], k, g[x:y], w[x:y], has[x:y]):
                                doc.append(i + r)
                                for column, value in zip((item, first, n, sim), got):
                                    column.append(value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(doc, pa.int64())) for c in (0, 2)), pa.array([index.ids[x] for x in item], pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array([round(x, 6) for x in sim], pa.float64())], ["doc_id", "th", "item_id", "first_word", "n_words", "similarity"])

        part = own.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that leak; rows of equal doc_id and text go together."""
    doc, th = shared.fresh(docs, "doc", "th")
    gone = _leaks(docs, benchmark, threshold).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    own = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    return own.join(gone, (own[th] == gone[th]) & own["doc_id"].cast("long").eqNullSafe(gone[doc]), "left_anti").select(*shared.columns(docs))


def op4_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return leaks(shared.documents(spark, sf_dir), shared.documents(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: The exact similarity of every window that shares a shingle with an item, without fingerprints.
OP4_SQL = (
    "WITH b AS (SELECT row_number() OVER () AS b, item_id, "
    + _WORDS
    + """ AS w FROM benchmark
), i AS (
  SELECT *, len(w) AS size, least(len(w), 5) AS k, (SELECT count(*) FROM benchmark) AS total FROM b WHERE len(w) > 0
), ig0 AS (
  SELECT b, k, list_aggregate(w[x:x + k - 1], 'string_agg', ' ') AS g FROM (SELECT *, unnest(range(1, size - k + 2)) AS x FROM i)
), ig AS (
  SELECT b, k, g, count(*) AS c FROM ig0 GROUP BY ALL
), weight AS (
  SELECT k, g, ln(1 + (SELECT count(*) FROM benchmark) / count(*)::DOUBLE) AS wt FROM ig GROUP BY ALL
), whole AS (
  SELECT b, sum(c * wt) AS total FROM ig JOIN weight USING (k, g) GROUP BY b
), d AS (
  SELECT row_number() OVER () AS r, doc_id, """
    + _WORDS
    + """ AS w FROM documents
), dg AS (
  SELECT r, x - 1 AS p, k, list_aggregate(w[x:x + k - 1], 'string_agg', ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS x FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
), met AS (
  SELECT dg.r, dg.p, ig.b FROM dg JOIN ig USING (k, g)
), shape AS (
  SELECT DISTINCT met.r, met.b, met.p, i.k, least(i.size, len(d.w)) AS n, len(d.w) AS words, i.size FROM met JOIN i USING (b) JOIN d USING (r)
), start AS (
  SELECT DISTINCT r, b, k, n, unnest(range(greatest(0, p - (n - k)), least(p, words - n) + 1)) AS s FROM shape WHERE n = size OR n >= 0.8 * size
), own AS (
  SELECT start.r, start.b, start.s, start.n, start.k, dg.g, count(*) AS c FROM start JOIN dg ON dg.r = start.r AND dg.k = start.k AND dg.p BETWEEN start.s AND start.s + start.n - start.k GROUP BY ALL
), sums AS (
  SELECT own.r, own.b, own.s, own.n, sum(own.c * coalesce(weight.wt, ln(1 + (SELECT count(*) FROM benchmark)))) AS mine, sum(least(own.c, ig.c) * weight.wt) AS common
  FROM own LEFT JOIN weight ON weight.k = own.k AND weight.g = own.g LEFT JOIN ig ON ig.b = own.b AND ig.g = own.g GROUP BY ALL
), sim AS (
  SELECT sums.r, sums.b, sums.s, sums.n, common / (mine + whole.total - common) AS similarity FROM sums JOIN whole USING (b) WHERE common > 0
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, b ORDER BY round(similarity, 9) DESC, s) AS rank FROM sim WHERE similarity >= 0.8 - 1e-9
)
SELECT d.doc_id, b.item_id, best.s AS first_word, best.n AS n_words, round(best.similarity, 6) AS similarity FROM best JOIN d USING (r) JOIN b USING (b) WHERE rank = 1
"""
)
