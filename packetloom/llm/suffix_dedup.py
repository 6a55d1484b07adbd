"""Exact substring dedup over bytes by a hash-compared suffix sort.

A byte goes if a string of `width` (200) bytes that covers it also starts anywhere else.  Strings are
judged on the input, and never cross texts.

1. Anchors.  Every string of 200 bytes has an anchor: of its 101 substrings of 100 bytes, the one with the
   smallest hash (the first of equals).  The anchor depends on the string's content alone, so equal
   strings have equal anchors in equal places; neighbouring strings mostly share one, about one position
   in fifty is an anchor.  The strings with one anchor form its context, a run of bytes.
2. Anchors are dealt by their hash.  One that is alone has no equal strings.  Where two contexts are the
   same (64 bits of a polynomial hash of the anchor and 64 bits of XXH3 of the context, length and place),
   all their strings occur twice.
3. Anchors with several different contexts: the suffixes that begin in the contexts are sorted, each
   context once.  Strings in which 50 bytes or fewer come before the anchor have the 50 bytes behind it in
   common with their equals, all others the 51 bytes before it: contexts are dealt in two halves, by the
   anchor and those bytes.  Suffixes are dealt by place and first eight bytes, and then merge-sorted; two
   suffixes are compared by their longest common extension, found by binary search over prefix polynomial
   hashes, and by the byte behind it.  Neighbours in that order that agree on 200 bytes are verified byte
   by byte.
4. Each text's covered runs are united and cut out.

Equal contexts are combined in each batch before the shuffle (two rows of them go on), so copies don't
pile up.  Different contexts that agree in an anchor and the bytes beside it meet in one task; they take
some 250 bytes each, and beyond MANY of them the suffixes are sorted place by place, in groups dealt by
the hash of the 200 bytes.

Nulls: a null text is empty; a null doc_id stays null.  Repeated rows are texts of their own, so each is
the other's copy.  Texts shorter than 200 bytes lose nothing.  Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import shared, textbytes as tb
from .ngram_join import grouped
from .textbytes import U64

WIDTH, GRAM = 200, 100
#: Bytes beside the anchor by which the halves of contexts are dealt.
SIDE = 50
#: Contexts whose suffixes are sorted at once.
MANY = 10_000
LOW32 = U64(0xFFFFFFFF)


def anchors(data: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(row, anchor's place in the row, first and last string's start before/after it, hash of the
    anchor, hash of the context) of all anchors; off = anchor - first start, run = last - first start."""
    size = np.diff(offs)
    n = len(data)
    if n < width or not (size >= width).any():
        z = np.empty(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    p = tb.prefix_hash(tb.BYTE_CODE[data])
    at = np.arange(n - gram + 1)
    h = tb.span_hash(p, at, at + gram)
    m = (h & ~LOW32) | at.astype(np.uint64)
    spread, have = width - gram + 1, 1
    while have * 2 <= spread:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if spread > have:
        m = np.minimum(m[: len(m) - (spread - have)], m[spread - have :])
    step = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(size >= width)
    step[offs[long]] += 1
    step[offs[long + 1] - width + 1] -= 1
    start = np.flatnonzero(np.cumsum(step[: len(m)]) > 0)
    place = (m[start] & LOW32).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    tail = np.concatenate([head[1:], [len(start)]]) - 1
    first, last, place = start[head], start[tail], place[head]
    row = np.searchsorted(offs, first, "right") - 1
    off, run = place - first, last - first
    raw, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
    context = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + width).tolist())], np.uint64)
    context ^= tb.mix((off * 65536 + run).astype(np.uint64))
    return row, place - offs[row], off, run, h[place], context


class Suffixes:
    """Hash comparisons of substrings of one buffer."""

    def __init__(self, data: np.ndarray, width: int):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.width = width
        self.p = tb.prefix_hash(tb.BYTE_CODE[data])
        self.down = tb.powers(len(self.p))[1]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, up to width, by binary search."""
        known = np.zeros(len(a), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        pa_, pb, da, db = self.p[a], self.p[b], self.down[a], self.down[b]
        while step:
            to = known + step
            able = to <= self.width
            to = np.where(able, to, known)
            same = (self.p[a + to] - pa_) * da == (self.p[b + to] - pb) * db
            known = np.where(able & same, to, known)
            step >>= 1
        return known

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(a, b)
        return np.where(e >= self.width, or_equal, self.data[a + np.minimum(e, self.width - 1)] < self.data[b + np.minimum(e, self.width - 1)])

    def merge_sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sorts the suffixes of each group (groups are runs of equal numbers): rounds of merging
        neighbouring runs, in which all suffixes find their rank in the other run at once."""
        n = len(at)
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        width = 1
        while n and width < size.max():
            inner = np.arange(n) - first
            busy = np.flatnonzero(size > width)
            own = inner[busy] // width
            right = own % 2 == 1
            other = np.where(right, own - 1, own + 1) * width
            low = np.minimum(other, size[busy])
            high = np.minimum(other + width, size[busy])
            base, begin = first[busy], low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                # how many of the other run come before: equals of the left run do, of the right don't
                before = self.less(at[base[open_] + mid], at[busy[open_]], right[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            merged = base + np.minimum(own, own - 2 * right + 1) // 2 * 2 * width + inner[busy] % width + (low - begin)
            out = at.copy()
            out[merged] = at[busy]
            at = out
            width *= 2
        return at

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte by byte."""
        out = np.ones(len(a), bool)
        for j in range(0, self.width, 8):
            k = np.arange(j, min(j + 8, self.width))
            out &= (self.data[a[:, None] + k] == self.data[b[:, None] + k]).all(1)
        return out


def repeats(contexts: list[bytes], off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context of one anchor, the first and last start (from the context's first byte) of a
    string that another context has as well; (1, 0) if there is none."""
    if len(contexts) > MANY:
        return _repeats_by_place(contexts, off, width)
    return _sorted_repeats(contexts, off, width)


def _repeats_by_place(contexts: list[bytes], off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many contexts: strings of one place and one hash at a time.  Of equal strings two are
    sorted, what holds for them holds for the others."""
    low, high = np.full(len(contexts), 1 << 40), np.full(len(contexts), -1)
    many = np.array([len(c) for c in contexts], np.int64) - width + 1
    for place in range(int(max(0, (off - many + 1).min())), int(off.max()) + 1):
        begin = off - place
        own = np.flatnonzero((begin >= 0) & (begin < many))
        groups: dict[int, dict[bytes, list[int]]] = {}
        parts = 1 + len(own) // MANY
        for i, x in zip(own.tolist(), begin[own].tolist()):
            string = contexts[i][x : x + width]
            groups.setdefault(xxhash.xxh3_64_intdigest(string) % parts, {}).setdefault(string, []).append(i)
        for strings in groups.values():
            shown = [(s, at) for s, owners in strings.items() for at in owners[:2]]
            first, last = _sorted_repeats([s for s, _ in shown], np.full(len(shown), place), width)
            for (s, _), found in zip(shown, last >= first):
                if found:
                    at = np.array(strings[s])
                    low[at], high[at] = np.minimum(low[at], begin[at]), np.maximum(high[at], begin[at])
    return np.where(high < 0, 1, low), np.where(high < 0, 0, high)


def _sorted_repeats(contexts: list[bytes], off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) for c in contexts], np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sort = Suffixes(data, width)
    many = size - width + 1
    owner = np.repeat(np.arange(len(contexts)), many)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = base[owner] + begin
    place = off[owner] - begin
    eight = np.ascontiguousarray(sort.data[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
    order = np.lexsort((eight, place))
    same = np.concatenate([[False], (eight[order][1:] == eight[order][:-1]) & (place[order][1:] == place[order][:-1])])
    tied = same | np.concatenate([same[1:], [False]])
    order, group = order[tied], np.cumsum(~same)[tied]
    first, last = np.ones(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    if not len(order):
        return first, last
    by_at = np.argsort(at)
    sorted_at = sort.merge_sort(at[order], group)
    back = by_at[np.searchsorted(at[by_at], sorted_at)]
    near = np.flatnonzero(group[1:] == group[:-1])
    near = near[sort.extension(sorted_at[near], sorted_at[near + 1]) >= width]
    near = near[sort.equal(sorted_at[near], sorted_at[near + 1])]
    hit = back[np.unique(np.concatenate([near, near + 1]))]
    low, high = np.full(len(contexts), 1 << 40), np.full(len(contexts), -1)
    np.minimum.at(low, owner[hit], begin[hit])
    np.maximum.at(high, owner[hit], begin[hit])
    found = high >= 0
    first[found], last[found] = low[found], high[found]
    return first, last


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def covered(docs: DataFrame) -> DataFrame:
    """doc, th (which find a row again; a null doc_id's doc is a second hash of the text), first, last: runs of bytes [first, last) that go; they overlap."""
    spark = docs.sparkSession
    shared.ship(spark)
    names = ["doc", "th", "place", "off", "run", "anchor", "context", "sure"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.bool_()]

    def find(batches):
        for batch in batches:
            data, offs = tb.buffers(batch.column(2))
            got = []
            for i, j in tb.row_slices(offs):
                row, *rest = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                got.append((row + i, *rest))
            row, place, off, run, h, c = (np.concatenate(x) for x in zip(*got)) if got else [np.empty(0, np.int64)] * 6
            key = tb.mix(h.astype(np.uint64)) ^ c.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(key[order], key[order])
            sure = rank > 1
            # what is known to be repeated needs no company: it gets a number of its own
            h = np.where(sure, tb.mix(key + rank.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), h.astype(np.uint64))
            at = pa.array(row)
            columns = [batch.column(0).take(at), batch.column(1).take(at), place, off, run, h.view(np.int64), c.astype(np.uint64).view(np.int64), sure]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types)], names)

    found = _rows(docs).select("doc", "th", "text").mapInArrow(find, "doc long, th long, place long, off short, run short, anchor long, context long, sure boolean")
    both, alone = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    counted = found.repartition("anchor").withColumn("n", F.count(F.lit(1)).over(both)).withColumn("rank", F.row_number().over(both.orderBy("doc", "place"))).withColumn("all", F.count(F.lit(1)).over(alone))
    met = shared.stage(counted.where("all > 1 or sure").withColumn("sure", F.expr("sure or n > 1")))
    whole = met.where("sure").select("doc", "th", (F.col("place") - F.col("off")).alias("first"), (F.col("place") - F.col("off") + F.col("run") + WIDTH).alias("last"))

    asked = met.where("all > n and rank = 1").groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "place", "off", "run", "sure")).alias("asked"))
    kind = "key long, doc long, th long, start long, off int, sure boolean, bytes binary"

    def extract(batches):
        for batch in batches:
            data, offs = tb.buffers(batch.column(2))
            out = [[] for _ in range(7)]
            for r, (doc, th, asked_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                raw = data[offs[r] : offs[r + 1]].tobytes()
                for a in asked_:
                    place, off, run = a["place"], a["off"], a["run"]
                    # the strings whose first byte is up to SIDE before the anchor, and those that begin before
                    halves = (max(0, off - SIDE), run, raw[place + GRAM : place + GRAM + SIDE]), (0, min(run, off - SIDE - 1), raw[max(place - SIDE - 1, 0) : place])
                    for half, (low, high, side) in enumerate(halves):
                        if low > high:
                            continue
                        x = place - off
                        key = xxhash.xxh3_64_intdigest(side, (a["anchor"] * 2 + half) & (1 << 64) - 1)
                        for column, value in zip(out, (key - (1 << 63), doc, th, x + low, off - low, a["sure"], raw[x + low : x + high + WIDTH])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["key", "doc", "th", "start", "off", "sure", "bytes"])

    texts = asked.hint("merge").join(_rows(docs).drop("doc_id"), ["doc", "th"])
    contexts = texts.select("doc", "th", "text", "asked").mapInArrow(extract, kind).repartition("key").sortWithinPartitions("key", "doc", "th", "start")

    def sort(batches):
        for t in grouped(batches, ("key",)):
            sure = t.column("sure").to_numpy()
            if len(sure) < 2 or sure.all():
                continue
            first, last = repeats(t.column("bytes").to_pylist(), t.column("off").to_numpy().astype(np.int64))
            keep = np.flatnonzero((last >= first) & ~sure)
            if len(keep):
                at, start = pa.array(keep), t.column("start").to_numpy()[keep]
                yield pa.RecordBatch.from_arrays([t.column("doc").combine_chunks().take(at), t.column("th").combine_chunks().take(at), pa.array(start + first[keep]), pa.array(start + last[keep] + WIDTH)], ["doc", "th", "first", "last"])

    return whole.unionByName(contexts.mapInArrow(sort, "doc long, th long, first long, last long"))


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of removed runs), kept (binary)."""
    spans = covered(docs).groupBy("doc", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = _rows(docs).join(spans.hint("merge"), ["doc", "th"], "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]

    def cut(batches):
        for batch in batches:
            data, offs = tb.buffers(batch.column(1))
            n, gone, many, sha, runs, kept = [], [], [], [], [], []
            for r, (first, last) in enumerate(zip(batch.column(2), batch.column(3))):
                raw = data[offs[r] : offs[r + 1]].tobytes()
                own = unite(list(zip(first.as_py() or (), last.as_py() or ())))
                edges = [0, *(x for s in own for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in ((n, len(raw)), (gone, len(raw) - len(left)), (many, len(own)), (sha, hashlib.sha256(left).hexdigest()), (runs, [list(x) for x in own]), (kept, left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary")


def op8_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    return dedup(shared.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every string of 200 bytes by its MD5 number.
OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), s AS (
  SELECT r, i, md5_number(b[i + 1:i + 200]) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)
), again AS (
  SELECT h FROM s GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s WHERE h IN (SELECT h FROM again)
), run AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit
), span AS (
  SELECT r, min(i) AS x, max(i) + 200 AS y FROM run GROUP BY r, g
), kept AS (
  SELECT r, lag(y, 1, 0) OVER w AS x, x AS y FROM span WINDOW w AS (PARTITION BY r ORDER BY x)
  UNION ALL SELECT r, max(y), NULL FROM span GROUP BY r
), cut AS (
  SELECT d.r, string_agg(hex(CASE WHEN k.y IS NULL THEN d.b[k.x + 1:octet_length(d.b)] ELSE d.b[k.x + 1:k.y] END), '' ORDER BY k.x) AS left_hex FROM kept k JOIN d USING (r) WHERE k.x < coalesce(k.y, octet_length(d.b)) GROUP BY d.r
), n AS (
  SELECT r, CAST(sum(y - x) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r
)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_spans, 0) AS n_spans,
  CASE WHEN n.r IS NULL THEN sha256(d.b) ELSE sha256(unhex(coalesce(cut.left_hex, ''))) END AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN cut USING (r)
"""
