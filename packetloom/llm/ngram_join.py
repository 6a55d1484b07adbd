"""Set-similarity self-join of documents on word n-grams, by vertical partitioning.

The global order of n-grams (that of their 64-bit hashes) is cut into fragments.  A document's set
falls into segments, one for each fragment.

1. Candidates.  Two sets with Jaccard t and at most M n-grams each differ in at most
   T = 2M(1-t)/(1+t) of them, so with more than T fragments some segment is the same in both.  Sets are
   dealt into size classes, such that linked sets lie in one class or two adjacent ones; each set gives
   hashes of its segments for its own class's cut and the next one's.  Empty segments carry no
   evidence, hence a few spare fragments; a set with more empty segments than that repeats the scheme
   with another n-gram order until it has few.  (At the first order that either of two sets stops at,
   both give segments, and the one that stopped leaves enough that aren't empty: no link is lost.)
   Segments that only one set has go.  Sets that share a segment are parted by their histograms: n-grams
   counted in ranges of the order; the counts of two sets differ by no more in all than the sets do, so
   this loses no link either.  (It keeps passages that many long texts share from tying all of these
   together.)  Beyond GROUP sets a segment's sets stay together.  What is left forms clusters.
2. Overlaps, by vertical partitioning.  A cluster's sets are dealt into blocks of about BLOCK_SETS, and the
   n-gram order is cut into fragments, such that two blocks have about FRAGMENT_GRAMS n-grams in each.
   A task has one fragment of one pair of blocks, whatever the sets' sizes, and counts the partial overlaps
   there, without looking at the rest of the sets; its counts are one row.  A second step sums the rows
   of all fragments per pair, tests the pairs against the threshold, and returns each set's links and a
   spanning forest.  Pairs of sets are counted but never emitted as rows.
3. Components of the forests.  Equal sets are one class all along, counted once.

Words are runs of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased.  With fewer words than n, the whole
sequence is the one n-gram; without words (or with null text) the set is empty and links with nothing.

Nulls: a null doc_id stays null, its document takes part, and it is nobody's component_id unless it
links with no document that has an id (then null).  Repeated rows are documents of their own.  Ids may
be negative.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph, shared, textbytes as tb
from .textbytes import U64

#: Sets of a cluster in a block, about.
BLOCK_SETS = 512
#: n-grams that two blocks have in a fragment, about.
FRAGMENT_GRAMS = 300_000
#: n-grams whose overlaps are counted by one product.
STRIP = 4096
#: Sets that share a segment are compared by their histograms up to so many; more stay together.
GROUP = 256


class Cuts:
    """Size classes and their numbers of fragments for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.first = num, den, [1]

    def of(self, n: int) -> int:
        """The size class of n n-grams."""
        while self.first[-1] <= n:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.first, n, "right")) - 1

    def fragments(self, c: int) -> tuple[int, int]:
        """(fragments, spare ones) of class c's cut; (0, 0) where linked sets are equal."""
        while len(self.first) < c + 2:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        differ = 2 * (self.first[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        spare = 1 + differ // 12
        return (differ + 1 + spare, spare) if differ else (0, 0)


def segment_keys(grams: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Hashes of a sorted set's segments that are not empty, for the cuts it takes part in."""
    out = []
    own = cuts.of(len(grams))
    for c in (own, own + 1):
        pieces, spare = cuts.fragments(c)
        order, turn = grams, 0
        while pieces:
            bounds = np.searchsorted((order >> U64(32)) * U64(pieces) >> U64(32), np.arange(pieces + 1))
            sums = np.zeros(len(order) + 1, np.uint64)
            np.cumsum(tb.mix(order), out=sums[1:])
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            tag = U64((c * 1_000_003 + turn * 7919) & 0xFFFFFFFF) << U64(32)
            out.append(tb.mix(tb.mix(sums[bounds[full + 1]] - sums[bounds[full]]) + (tag | full.astype(np.uint64))))
            if pieces - len(full) <= spare:
                break
            turn += 1
            order = np.sort(tb.mix(grams ^ U64(turn)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def gram_sets(column, k: int):
    """Yields (row, sorted n-gram hashes) of every text."""
    data, offs = tb.buffers(column)
    for i, j in tb.row_slices(offs):
        _, _, row, h = tb.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tb.WHITE, tb.LOWER)
        g, at = tb.shingles(h, row, k)
        word, gram = tb.row_starts(row, j - i).tolist(), tb.row_starts(row[at], j - i).tolist()
        for r in range(j - i):
            own = np.sort(g[gram[r] : gram[r + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif not len(own) and word[r + 1] > word[r]:
                short = h[word[r] : word[r + 1]]
                own = tb.shingles(short, np.zeros(len(short), np.int64), len(short))[0]
            yield i + r, own


def set_hashes(grams: np.ndarray) -> tuple[int, int]:
    n = U64(len(grams))
    return tuple(int(np.int64(np.uint64((tb.mix(tb.mix(grams ^ U64(salt)).sum(keepdims=True) + n))[0]).view(np.int64))) for salt in (0x51ED, 0xA2B7)) if len(grams) else (0, 0)


def histogram(grams: np.ndarray) -> bytes:
    """How many of a set's n-grams lie in each of 2**b equal ranges of the order (15 for more), two to a
    byte; b grows with the set, four to eight n-grams lie in a range on average."""
    b = max(3, (len(grams) // 8).bit_length())
    n = np.minimum(np.bincount((grams >> U64(64 - b)).astype(np.int64), minlength=1 << b), 15).astype(np.uint8)
    return (n[::2] | (n[1::2] << 4)).tobytes()


def differences(histograms: list[bytes]) -> np.ndarray:
    """For all pairs, a number of n-grams that only one of two sets has, at least."""
    packed = [np.frombuffer(x, np.uint8) for x in histograms]
    least = min(len(x) for x in packed)
    counts = np.empty((len(packed), 2 * least), np.int32)
    cut = np.empty(len(packed), bool)
    for i, x in enumerate(packed):
        both = np.stack([x & 15, x >> 4], 1).reshape(2 * least, -1)
        counts[i] = both.sum(1)
        cut[i] = (both == 15).any()
    out = np.empty((len(packed), len(packed)), np.int64)
    for i in range(len(packed)):
        out[i] = np.abs(counts - counts[i]).sum(1)
    # a range cut off at 15 is only comparable in histograms of as many ranges
    size = np.array([len(x) for x in packed])
    out[(cut[:, None] | cut[None, :]) & (size[:, None] != size[None, :])] = 0
    return out


def part_group(s1: np.ndarray, n: np.ndarray, histograms: list[bytes], num: int, den: int) -> np.ndarray:
    """For each of the sets of one segment the smallest s1 that it may be linked with, also by others."""
    near = (num + den) * differences(histograms) <= (den - num) * (n[:, None] + n[None, :])
    label = s1.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


def _own(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash: what finds a row again, with or without a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).alias("th"))


def _signatures(docs: DataFrame, k: int, num: int, den: int, with_keys: bool) -> DataFrame:
    """Each document's number of n-grams and hashes of its set; with_keys: those of its segments, else its histogram."""
    shared.ship(docs.sparkSession)

    def run(batches):
        cuts, given = Cuts(num, den), set()  # a partition gives the segments of equal sets once
        for batch in batches:
            n, a, b, keys, hist = [], [], [], [], []
            for _, grams in gram_sets(batch.column(1), k):
                n.append(len(grams))
                x, y = set_hashes(grams)
                a.append(x)
                b.append(y)
                keys.append(segment_keys(grams, cuts) if with_keys and len(grams) and x not in given else np.empty(0, np.uint64))
                hist.append(None if with_keys else histogram(grams))
                given.add(x)
            size = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat)), pa.array(hist, pa.binary())], ["doc_id", "th", "n_shingles", "s1", "s2", "keys", "hist"])

    return _own(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, s1 long, s2 long, keys array<long>, hist binary")


def _fragments(docs: DataFrame, k: int) -> DataFrame:
    """The n-gram sets of (node, cluster, n, copies, blocks, fragments, block, s1, s2, text), packed, a row for
    each fragment of the n-gram order."""
    names = ["node", "cluster", "n", "copies", "blocks", "block"]

    def run(batches):
        for batch in batches:
            keep, number, grams = [], [], []
            a, b, pieces = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("s1", "s2", "fragments"))
            for r, g in gram_sets(batch.column(batch.schema.get_field_index("text")), k):
                if set_hashes(g) != (a[r], b[r]):
                    continue  # another row with the representative's doc_id
                bounds = np.searchsorted((g >> U64(32)) * U64(pieces[r]) >> U64(32), np.arange(pieces[r] + 1)).tolist()
                for f, (x, y) in enumerate(zip(bounds, bounds[1:])):
                    if y > x:
                        keep.append(r)
                        number.append(f)
                        grams.append(g[x:y].tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)).take(at) for x in names), pa.array(number, pa.int32()), pa.array(grams, pa.binary())], [*names, "fragment", "grams"])

    return docs.mapInArrow(run, "node long, cluster long, n long, copies long, blocks int, block int, fragment int, grams binary").dropDuplicates(["node", "fragment"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1
    owner, number = owner[often], number[often]
    total = np.zeros((len(sets), len(sets)), np.float32)
    if len(number):
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
        cut = np.searchsorted(number, np.arange(0, number[-1] + 1, STRIP)).tolist() + [len(number)]
        for f, (x, y) in enumerate(zip(cut, cut[1:])):
            part = np.zeros((len(sets), int(number[y - 1]) - f * STRIP + 1), np.float32)
            part[owner[x:y], number[x:y] - f * STRIP] = 1
            total += part @ part.T
    return total


def partial_overlaps(block: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n-grams in both) of all pairs a < b with any, of one block, or between two."""
    common = np.triu(overlaps(sets), 1)
    if block.min() != block.max():
        common *= block[:, None] != block[None, :]
    a, b = np.nonzero(common)
    return a, b, common[a, b].astype(np.int64)


def linked_sets(n: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, num: int, den: int):
    """(links of each set in documents, root of each set in the links' forest) for pairs (a, b) of sets of n
    n-grams and their whole overlaps."""
    link = den * common >= num * (n[a] + n[b] - common)
    a, b = a[link], b[link]
    links = np.bincount(a, copies[b], len(n)).astype(np.int64) + np.bincount(b, copies[a], len(n)).astype(np.int64)
    root = np.arange(len(n))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return links, root
        root = new


def grouped(batches, keys: tuple[str, ...]):
    """Groups of rows of equal keys, from batches sorted by them: lists of columns by name."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(cut, cut[1:]):
            own = tuple(c[x] for c in cols)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _parted(met: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): every set a of a segment and the b that stands for the part of the segment's sets it is in.
    met: key, s1, n, hist."""

    def run(batches):
        for t in grouped(batches, ("key",)):
            s1 = t.column("s1").to_numpy()
            root = part_group(s1, t.column("n").to_numpy(), t.column("hist").to_pylist(), num, den)
            far = root != s1
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(s1[far]), pa.array(root[far])], ["a", "b"])

    return met.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


PARTIAL = ("node", "n", "copies", "a", "b", "common")


def _partial(sets: DataFrame) -> DataFrame:
    """A row of packed counts for each fragment of each pair of blocks."""

    def run(batches):
        for t in grouped(batches, ("cluster", "i", "j", "fragment")):
            node, n, copies, block = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "copies", "block"))
            if len(node) < 2:
                continue
            a, b, common = partial_overlaps(block, [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()])
            if not len(a):
                continue
            at = [t.column(c).combine_chunks().slice(0, 1) for c in ("cluster", "i", "j")]
            packed = [node, n, copies, *(x.astype(np.int32) for x in (a, b, common))]
            yield pa.RecordBatch.from_arrays([*at, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["cluster", "i", "j", *PARTIAL])

    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    spread = sets.withColumn("other", other).select("node", "cluster", "n", "copies", "block", "fragment", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    keys = ["cluster", "i", "j", "fragment"]
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "cluster long, i int, j int, " + ", ".join(f"{x} binary" for x in PARTIAL))


class _Sum:
    """The overlaps of one pair of blocks, summed fragment by fragment."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.n: list[int] = []
        self.copies: list[int] = []
        self.total = np.zeros((8, 8), np.int64)

    def add(self, node, n, copies, a, b, common) -> None:
        for x, y, z in zip(node.tolist(), n.tolist(), copies.tolist()):
            if x not in self.at:
                self.at[x] = len(self.n)
                self.n.append(y)
                self.copies.append(z)
        if len(self.n) > len(self.total):
            wide = np.zeros((2 * len(self.n), 2 * len(self.n)), np.int64)
            wide[: len(self.total), : len(self.total)] = self.total
            self.total = wide
        at = np.array([self.at[x] for x in node.tolist()])
        self.total[np.minimum(at[a], at[b]), np.maximum(at[a], at[b])] += common

    def links(self, num: int, den: int):
        a, b = np.nonzero(self.total)
        got, root = linked_sets(np.array(self.n), np.array(self.copies), a, b, self.total[a, b], num, den)
        node = np.array(list(self.at), np.int64)
        return node, got, node[root]


def _link(partial: DataFrame, num: int, den: int) -> DataFrame:
    """node, links, root: from the sums of the partial overlaps of each pair of blocks."""

    def run(batches):
        key, held, out = None, _Sum(), []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(x)) for x in ("cluster", "i", "j", *PARTIAL)]
            for r in range(batch.num_rows):
                own = tuple(c[r].as_py() for c in cols[:3])
                if own != key and key is not None:
                    out.append(held.links(num, den))
                    held = _Sum()
                key = own
                held.add(*(np.frombuffer(c[r].as_buffer(), t) for c, t in zip(cols[3:], (np.int64,) * 3 + (np.int32,) * 3)))
            if len(out) > 1000:
                yield _linked_batch(out)
                out = []
        if key is not None:
            out.append(held.links(num, den))
        if out:
            yield _linked_batch(out)

    keys = ["cluster", "i", "j"]
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, links long, root long")


def _linked_batch(got: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], ["node", "links", "root"])


def _joined(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """join(), with th, by which and by doc_id a row is found again."""
    # segments are made in a pass of their own: they go to their shuffle and are never stored besides
    signed = shared.stage(_signatures(docs, k, num, den, False).drop("keys"))
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th"), F.first("hist").alias("hist"))
    # dealt once by key; the count of a key's sets and the join back to them both read that shuffle
    segments = _signatures(docs, k, num, den, True).select(F.explode("keys").alias("key"), "s1").where("key is not null and s1 is not null").repartition("key")
    shown = segments.groupBy("key").agg(F.min("s1").alias("m"), F.max("s1").alias("x")).where("m != x").select("key", "m")
    met = shared.stage(segments.join(shown, "key").select("key", "m", "s1").distinct())
    # of segments that the same sets share, one
    groups = met.groupBy("key", "m").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("s1")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "s1")).alias("y"))
    groups = shared.stage(groups.groupBy("m", "c", "x", "y").agg(F.min("key").alias("key")).select("key", "c"))
    few = met.join(groups.where(F.col("c") <= GROUP), "key").select("key", "s1")
    many = met.join(groups.where(F.col("c") > GROUP), "key").where("s1 != m").select(F.col("s1").alias("a"), F.col("m").alias("b"))
    parted = _parted(few.join(classes.select("s1", "n", "hist"), "s1"), num, den)
    clusters = graph.components(parted.union(many))
    members = clusters.select(F.col("id").alias("s1"), F.col("component").alias("cluster")).join(classes, "s1").withColumn("node", F.col("s1"))
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_SETS)
    sizes = members.groupBy("cluster").agg(blocks.cast("int").alias("blocks"), F.greatest(F.ceil(2 * F.sum("n") / blocks / FRAGMENT_GRAMS), F.lit(1)).cast("int").alias("fragments"))
    members = shared.stage(members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("s2", "s1"), F.col("blocks")).cast("int")))
    # the members grow with the corpus: one plan at every size
    texts = members.hint("merge").join(_own(docs).withColumnRenamed("doc_id", "own"), ["th"]).where(F.col("own").eqNullSafe(F.col("rep")))
    linked = shared.stage(_link(_partial(_fragments(texts, k)), num, den))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = graph.components(linked.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = classes.withColumn("node", F.col("s1")).join(links, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    # classes of one document that link with nothing need no row here
    found = shared.stage(found.where("copies > 1 or component is not null").select("s1", "s2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(least, "component").select("s1", "s2", "n_links", "component_id")
    out = signed.select("doc_id", "th", "n_shingles", "s1", "s2").join(found, ["s1", "s2"], "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents that the document links with) of every row,
    for links of Jaccard similarity num / den or more."""
    return _joined(docs, k, num, den).drop("th")


def keep_one(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs without those whose component has a smaller doc_id, a null one being the largest; rows of equal
    doc_id and text stay together, and so do the rows of a component without any doc_id."""
    doc, th = shared.fresh(docs, "doc", "th")
    later = F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("component_id") < F.col("doc_id")))
    gone = _joined(docs, k, num, den).where(later).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumn(th, F.xxhash64(text, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))))
    found = (own[th] == gone[th]) & own["doc_id"].cast("long").eqNullSafe(gone[doc])
    return own.join(gone, found, "left_anti").select(*shared.columns(docs))


def op6_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return join(shared.documents(spark, sf_dir), 3, 90, 100)


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)
), r AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT * FROM r
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
  least(d.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
