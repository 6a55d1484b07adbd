"""Substring dedup by collinear chaining: fuzzy passages of a document that an earlier one has too.

1. Seeds.  Texts are lower-cased and cut into words (letters, digits, code points beyond ASCII).  Of every
   WINDOW successive runs of K words, the one with the smallest hash is a seed, so any 17 words that two
   documents share hold a seed they share.
2. Every seed, at all its places, is joined with its earliest occurrence (by doc_id).  A passage that
   thousands share gives one match for each of them, not one for each pair.  Where successive seeds have
   their earliest occurrences in different documents (or places), two runs from each on are also joined
   with the earliest document that has the whole run: the first of `min_words` words, which
   `min_words` + 2 * (WINDOW - 1) words that are shared exactly always have,
   and the first of `min_words` - 2 * (WINDOW - 1), which every `min_words` shared words have.
3. The matches of a document and an earlier one are chained: places ascend in both, a seed counts its
   words, and a gap costs GAP for each word skipped in either.  The best predecessor is a prefix maximum
   in a Fenwick tree over the earlier document's places.  Chains are taken out best first.  (Where all
   matches lie on one diagonal, the order is the chain and it is only cut at large gaps.)
4. Chains are aligned word by word, with EDGE words more at both ends: along the diagonal; or, where there
   were insertions, through the words that each side has once, and diagonally between them; or, where
   there are few such words, by a full local alignment (of overlapping pieces, where the table would be
   too large).  All passages of a chain are given, not the best one only.  A passage counts if it has `min_words` words or more in both
   documents and `identity` or more of the aligned words are the same.

Nulls: null texts have no words; a null doc_id comes before all others.  Repeated rows are one document
(their text is the same); rows with one doc_id and different texts are told apart by the text's hash, and
may match each other.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, textbytes as tb
from .textbytes import U64

K, WINDOW = 6, 12
MIN_WORDS, IDENTITY = 50, 0.8
GAP, EDGE, FAR = 0.05, 50, 100
#: Words of a chain off one diagonal that are aligned together, in either document.
PART = 1000
#: Cells of a full alignment table.
CELLS = 1_500_000
NO_ID = -(1 << 63)
#: Where a seed is, and where it is first.
AT, REF = ["doc", "th", "place"], ["ref", "ref_th", "ref_place"]
PLACES = "doc long, th long, place int, ref long, ref_th long, ref_place int"


def seeds(h: np.ndarray, row: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the seeds in words h of rows `row`; short texts have at least one."""
    g, at = tb.shingles(h, row, k)
    if not len(g):
        return g, at
    key = (g & ~U64(0xFFFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    low, have = key, 1
    while have * 2 <= window and len(low) > have:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if window > have and len(low) > window - have:
        low = np.minimum(low[: len(low) - (window - have)], low[window - have :])
        have = window
    r = row[at]
    inside = r[: len(low)] == r[have - 1 : have - 1 + len(low)] if len(low) else np.empty(0, bool)
    pick = np.zeros(len(g), bool)
    pick[(low[inside] & U64(0xFFFFFFFF)).astype(np.int64)] = True
    # texts with fewer runs than a window: the smallest of all
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    short = np.diff(np.concatenate([first, [len(r)]])) < have
    pick[(np.minimum.reduceat(key, first)[short] & U64(0xFFFFFFFF)).astype(np.int64)] = True
    return g[pick], at[pick]


class Fenwick:
    """Prefix maxima of (value, number)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Of the places below i."""
        out = (-1e18, -1)
        while i:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP) -> list[np.ndarray]:
    """Collinear chains of the matches (x, y), as indices, best first; every match is in one at most."""
    order = np.lexsort((y, x))
    d = x[order] - y[order]
    if (d == d[0]).all():
        return np.split(order, np.flatnonzero(np.diff(x[order]) > FAR) + 1)
    xs, ys = x[order].tolist(), y[order].tolist()
    rank = np.unique(y[order], return_inverse=True)[1].tolist()
    tree, score, before, ready = Fenwick(len(order)), [0.0] * len(order), [-1] * len(order), 0
    for i in range(len(order)):
        while xs[ready] < xs[i]:  # equal places in x don't chain
            tree.put(rank[ready], (score[ready] + gap * (xs[ready] + ys[ready]), ready))
            ready += 1
        value, j = tree.top(rank[i])
        value -= gap * (xs[i] + ys[i])
        score[i], before[i] = (k + value, j) if j >= 0 and value > 0 else (float(k), -1)
    # all from one table (a text that repeats a line has as many chains): a chain ends where a better one has been
    free, out = [True] * len(order), []
    for at in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while at >= 0 and free[at]:
            free[at] = False
            chain.append(at)
            at = before[at]
        if chain:
            out.append(order[chain[::-1]])
    return out


def best_run(match: np.ndarray) -> tuple[int, int]:
    """The run with the largest sum, where a match counts 1 and a miss -3."""
    total = np.concatenate([[0], np.cumsum(np.where(match, 1, -3))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def good_runs(match: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int]]:
    """Disjoint runs of min_words or more of which a share of `identity` or more are matches; no other such
    run is left beside them."""
    out, waiting, miss = [], [(0, len(match))], -identity / max(1 - identity, 1e-6)
    while waiting:
        x, y = waiting.pop()
        if y - x < min_words:
            continue
        i, j = best_run(match[x:y])
        if j - i < min_words or match[x + i : x + j].sum() < identity * (j - i):
            # the longest run of that identity: sums that are never lower at its end than at its start
            total = np.concatenate([[0], np.cumsum(np.where(match[x:y], 1, miss))])
            low = np.minimum.accumulate(total)
            start = np.searchsorted(-low, -total - 1e-9)
            i, j = int(start[at := int(np.argmax(np.arange(len(total)) - start))]), at
            if j - i < min_words:
                continue
        out.append((x + i, x + j))
        waiting += [(x, x + i), (x + j, y)]
    return sorted(out)


def _pairs_runs(x: np.ndarray, y: np.ndarray, min_words: int, identity: float):
    """(from, to) in both, equal words, length of the good runs of matched places (x, y), ascending in both."""
    if len(x) < identity * min_words:
        return
    column = np.concatenate([[0], np.cumsum(np.maximum(np.diff(x), np.diff(y)))])
    match = np.zeros(int(column[-1]) + 1, bool)
    match[column] = True
    for i, j in good_runs(match, min_words, identity):
        p, q = np.searchsorted(column, (i, j))
        a, b, c, d, n = int(x[p]), int(x[q - 1]) + 1, int(y[p]), int(y[q - 1]) + 1, int(column[q - 1] - column[p]) + 1
        if b - a >= min_words and d - c >= min_words and q - p >= identity * n:
            yield a, b, c, d, int(q - p), n


def all_passages(a: np.ndarray, b: np.ndarray, shift: int | None, min_words: int, identity: float):
    """The passages of a that b has: along the diagonal x - y = shift if there is one, and by alignment in
    what is left of a beside those found."""
    waiting = [(0, len(a))]
    while waiting:
        lo, hi = waiting.pop()
        own = a[lo:hi]
        if hi - lo < min_words or not _enough(own, b, identity * min_words):
            continue  # too few words in both for any passage
        got = []
        if shift is not None:
            x = np.arange(max(lo, shift), min(hi, len(b) + shift))
            x = x[a[x] == b[x - shift]]
            got = [(p - lo, q - lo, *rest) for p, q, *rest in _pairs_runs(x, x - shift, min_words, identity)]
        if not got and (near := anchored(own, b)) is not None:
            x = np.flatnonzero(near >= 0)
            got = list(_pairs_runs(x, near[x], min_words, identity))
        cut = [(p, q) for p, q, *_ in got]
        if not got and len(own) * len(b) <= CELLS:
            x, y, start, end = aligned(own, b)[:4]
            got = list(_pairs_runs(x, y, min_words, identity))
            cut = [(p, q) for p, q, *_ in got] or [(start, end)]
        elif not got:
            got = _by_pieces(own, b, None if shift is None else shift - lo, min_words, identity)
            cut = [(p, q) for p, q, *_ in got]
        for p, q, *rest in got:
            yield lo + p, lo + q, *rest
        if cut:
            waiting += [(lo + p, lo + q) for p, q in zip([0, *(q for _, q in cut)], [*(p for p, _ in cut), hi - lo])]


def _by_pieces(a: np.ndarray, b: np.ndarray, shift: int | None, min_words: int, identity: float) -> list[tuple]:
    """Passages by alignment, where a table would be too large: pieces that overlap, of both, in every
    combination (where there is a diagonal, of those beside it)."""
    step, out = max(PART - 2 * min_words, 1), []
    for s in range(0, max(len(a) - 2 * min_words, 1), step):
        for t in range(0, max(len(b) - 2 * min_words, 1), step):
            if shift is not None and abs(s - t - shift) > PART:
                continue
            own, other = a[s : s + PART], b[t : t + PART]
            if _enough(own, other, identity * min_words):
                x, y = aligned(own, other)[:2]
                out += [(s + p, s + q, t + r, t + u, *rest) for p, q, r, u, *rest in _pairs_runs(x, y, min_words, identity)]
    kept: list[tuple] = []
    for got in sorted(out, key=lambda v: (v[0] - v[1], v)):
        if all(got[1] <= v[0] or v[1] <= got[0] for v in kept):
            kept.append(got)
    return sorted(kept)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of two word sequences (match 1, mismatch and gap -1): (from, to) in both,
    equal words, length."""
    x, _, i, j, k, m, length = aligned(a, b)
    return i, j, k, m, len(x), length


def aligned(a: np.ndarray, b: np.ndarray) -> tuple:
    """That alignment's matched places in both, (from, to) in both, and length."""
    n, m = len(a), len(b)
    rows = np.zeros((n + 1, m + 1), np.int32)
    j = np.arange(m + 1)
    for i in range(1, n + 1):
        t = np.zeros(m + 1, np.int32)
        t[1:] = np.maximum(rows[i - 1, :-1] + np.where(b == a[i - 1], 1, -1), rows[i - 1, 1:] - 1)
        rows[i] = np.maximum(np.maximum.accumulate(np.maximum(t, 0) + j) - j, 0)
    i, k = np.unravel_index(int(np.argmax(rows)), rows.shape)
    end, same, length = (int(i), int(k)), [], 0
    while rows[i, k] > 0:
        s = 1 if a[i - 1] == b[k - 1] else -1
        if rows[i, k] == rows[i - 1, k - 1] + s:
            i, k = i - 1, k - 1
            if s == 1:
                same.append((i, k))
        elif rows[i, k] == rows[i - 1, k] - 1:
            i -= 1
        else:
            k -= 1
        length += 1
    x, y = np.array(same[::-1], np.int64).reshape(-1, 2).T
    return x, y, int(i), end[0], int(k), end[1], length


def ascending(y: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly ascending subsequence."""
    from bisect import bisect_left

    tails: list[int] = []
    at: list[int] = []
    before = []
    for i, v in enumerate(y.tolist()):
        j = bisect_left(tails, v)
        before.append(at[j - 1] if j else -1)
        tails[j : j + 1] = [v]
        at[j : j + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], np.int64)


def bridge(a: np.ndarray, b: np.ndarray, x: int, y: int, to_x: int, to_y: int, matched: np.ndarray) -> None:
    """Matches words between (x, y) and (to_x, to_y): first along the one's diagonal, from the best
    place on along the other's."""
    n = min(to_x - x, to_y - y)
    if n <= 0:
        return
    forth, back = a[x : x + n] == b[y : y + n], a[to_x - n : to_x] == b[to_y - n : to_y]
    score = np.concatenate([[0], np.cumsum(forth)]) + np.concatenate([np.cumsum(back[::-1])[::-1], [0]])
    cut = int(np.argmax(score))
    own = np.flatnonzero(forth[:cut])
    matched[x + own] = y + own
    own = cut + np.flatnonzero(back[cut:])
    matched[to_x - n + own] = to_y - n + own


def patience(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int, int] | None:
    """An alignment through words that are unique in both, as align() gives it; None if they are few."""
    matched = anchored(a, b)
    if matched is None:
        return None
    start, end = best_run(matched >= 0)
    inside = matched[start:end]
    inside = inside[inside >= 0]
    if not len(inside):
        return None
    first, last = int(inside[0]), int(inside[-1]) + 1
    return start, end, first, last, len(inside), max(end - start, last - first)


def anchored(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The place in b, or -1, of every word of that alignment."""
    ua, ia, na = np.unique(a, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(b, return_index=True, return_counts=True)
    _, p, q = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    x, y = ia[na == 1][p], ib[nb == 1][q]
    order = np.argsort(x)
    x, y = x[order], y[order]
    keep = ascending(y)
    if len(keep) < 8:
        return None
    x, y = x[keep], y[keep]
    matched = np.full(len(a), -1)
    head = np.flatnonzero(np.concatenate([[True], np.diff(x - y) != 0]))
    tail = np.concatenate([head[1:], [len(x)]]) - 1
    for h, t in zip(head.tolist(), tail.tolist()):
        x0, x1, y0 = int(x[h]), int(x[t]) + 1, int(y[h])
        own = np.flatnonzero(a[x0:x1] == b[y0 : y0 + x1 - x0])
        matched[x0 + own] = y0 + own
    for t, h in zip(tail[:-1].tolist(), head[1:].tolist()):
        bridge(a, b, int(x[t]) + 1, int(y[t]) + 1, int(x[h]), int(y[h]), matched)
    n = min(int(x[0]), int(y[0]))
    own = np.flatnonzero(a[x[0] - n : x[0]] == b[y[0] - n : y[0]])
    matched[x[0] - n + own] = y[0] - n + own
    n = min(len(a) - int(x[-1]), len(b) - int(y[-1]))
    own = np.flatnonzero(a[x[-1] : x[-1] + n] == b[y[-1] : y[-1] + n])
    matched[x[-1] + own] = y[-1] + own
    return matched


def _rows(docs: DataFrame) -> DataFrame:
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _word_rows(column):
    data, offs = tb.buffers(column)
    for i, j in tb.row_slices(offs):
        _, _, row, h = tb.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tb.NOT_WORD)
        yield i, j, row, h


def passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """doc_id, first_word, last_word (behind the passage), ref_doc_id, ref_first_word, ref_last_word,
    n_same, identity: one row for each passage of a document that an earlier document has as well."""
    shared.ship(docs.sparkSession)

    def find(batches):
        for batch in batches:
            for i, j, row, h in _word_rows(batch.column(2)):
                g, at = seeds(h, row)
                r = row[at]
                take = pa.array(i + r)
                place = at - np.searchsorted(row, r)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place, pa.int32())], ["seed", "doc", "th", "place"])

    def meet(batches):
        for got in _earliest(batches, "seed", ["seed", *AT]):
            yield _arrow(got)

    def extend(batches):
        for cols in _whole(batches, ["doc", "th"], ["seed", *AT, *REF]):
            yield from map(_arrow, _split_runs(cols, min_words))

    def meet_runs(batches):
        for got in _earliest(batches, "run", ["run", *AT, "length"]):
            got = {n: v[(got["doc"] != got["ref"]) | (got["th"] != got["ref_th"])] for n, v in got.items()}
            ends = {n: np.concatenate([got[n], got[n] + (got["length"] if n in ("place", "ref_place") else 0)]) for n in (*AT, *REF)}
            yield _arrow(ends)

    found = _rows(docs).mapInArrow(find, "seed long, doc long, th long, place int")
    shown = shared.stage(found.repartition("seed").sortWithinPartitions("seed", *AT).mapInArrow(meet, f"seed long, {PLACES}"))
    runs = shown.repartition("doc", "th").sortWithinPartitions(*AT).mapInArrow(extend, "run long, doc long, th long, place int, length int")
    longer = runs.repartition("run").sortWithinPartitions("run", *AT).mapInArrow(meet_runs, PLACES)
    matched = shown.where("doc != ref or th != ref_th").selectExpr(*AT, *REF, "0 by_run").unionByName(longer.selectExpr(*AT, *REF, "1 by_run"))
    kind = "doc long, th long, ref long, ref_th long, number int, a int, b int, c int, d int, diagonal boolean, by_run boolean"
    names = ["doc", "th", "ref", "ref_th"]

    def chain(batches):
        for cols in _whole(batches, names, [*names, "place", "ref_place", "by_run"]):
            yield _chained(cols, names, min_words)

    by = matched.repartition("doc", "th", "ref", "ref_th").sortWithinPartitions(*names)
    chained = shared.stage(by.mapInArrow(chain, kind))
    # one request for each side of a chain; the texts are looked at once for all
    side = lambda n, *cols: F.struct(F.lit(n).alias("side"), *(F.col(c).alias(x) for c, x in zip(cols, ("at", "at_th", "x", "y"))))
    sides = chained.select("*", F.explode(F.array(side(0, "doc", "th", "a", "b"), side(1, "ref", "ref_th", "c", "d"))).alias("s"))
    asked = sides.select("s.*", *names, "number", "diagonal", "by_run")
    texts = _rows(docs).join(asked.select(F.col("at").alias("doc"), F.col("at_th").alias("th")).distinct().hint("merge"), ["doc", "th"])

    def cut_words(batches):
        for batch in batches:
            packed = []
            for i, j, row, h in _word_rows(batch.column(batch.schema.get_field_index("text"))):
                at = tb.row_starts(row, j - i)
                packed += [h[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc")), batch.column(batch.schema.get_field_index("th")), pa.array(packed, pa.binary())], ["at", "at_th", "words"])

    words = texts.mapInArrow(cut_words, "at long, at_th long, words binary").dropDuplicates(["at", "at_th"])
    start = f"greatest(x - {EDGE}, 0)"
    parts = asked.join(words, ["at", "at_th"]).select(*names, "number", "side", "diagonal", "by_run", "x", F.expr(start).alias("start"), F.expr(f"substring(words, 8 * {start} + 1, 8 * (y + {EDGE} - {start}))").alias("words"))

    fields = ["doc", "th", "ref", "first_word", "last_word", "ref_first_word", "ref_last_word", "n_same", "by_run", "identity"]

    def verify(batches):
        for cols in _whole(batches, names, [*names, "number", "side", "diagonal", "by_run", "x", "start", "words"]):
            pair = np.flatnonzero((cols["side"][:-1] == 0) & (cols["side"][1:] == 1) & (cols["number"][:-1] == cols["number"][1:]))
            out, own, done = [], None, []
            for i in pair.tolist():
                key = tuple(cols[n][i] for n in names)
                if key != own:
                    own, done = key, []
                a, b = (np.frombuffer(cols["words"][k], np.uint64) for k in (i, i + 1))
                x, y, sa, sb = (int(cols[n][k]) for n in ("x", "start") for k in (i, i + 1))
                # a repeated line gives a chain for each copy; all that it could show is known by then
                if any(p <= sa and sa + len(a) <= q for p, q in done):
                    continue
                for got in all_passages(a, b, (x - sa) - (y - sb) if cols["diagonal"][i] else None, min_words, identity):
                    row = (*key[:3], sa + got[0], sa + got[1], sb + got[2], sb + got[3], got[4], int(cols["by_run"][i]), round(got[4] / got[5], 6))
                    done.append(row[3:5])
                    out.append(row)
            out = list(dict.fromkeys(out))
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "identity" else pa.int64()) for n, c in zip(fields, columns)], fields)

    both = parts.repartition(*names).sortWithinPartitions(*names, "number", "side")
    verified = both.mapInArrow(verify, ", ".join(f"{n} {'double' if n == 'identity' else 'long'}" for n in fields))

    def keep(batches):
        for cols in _whole(batches, ["doc", "th"], fields):
            take = _needed(cols)
            yield pa.RecordBatch.from_arrays([pa.array(v[take]) for v in cols.values()], fields)

    kept = verified.repartition("doc", "th").sortWithinPartitions("doc", "th").mapInArrow(keep, verified.schema)
    no = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return kept.select(no("doc").alias("doc_id"), "first_word", "last_word", no("ref").alias("ref_doc_id"), "ref_first_word", "ref_last_word", "n_same", "identity")


def _changes(cols: dict, names: list[str]) -> np.ndarray:
    """Where groups begin, and the length."""
    change = np.ones(len(cols[names[0]]), bool)
    change[1:] = False
    for n in names:
        change[1:] |= cols[n][1:] != cols[n][:-1]
    return np.concatenate([np.flatnonzero(change), [len(change)]])


def _whole(batches, keys: list[str], names: list[str]):
    """Columns by name, with whole groups of equal keys, from batches sorted by them."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
        held.append(cols)
        if all(held[0][n][0] == cols[n][-1] for n in keys):
            continue  # one group so far
        cols = {n: np.concatenate([x[n] for x in held]) for n in names}
        last = _changes(cols, keys)[-2]
        yield {n: v[:last] for n, v in cols.items()}
        held = [{n: v[last:] for n, v in cols.items()}]
    if held:
        yield {n: np.concatenate([x[n] for x in held]) for n in names}


def _arrow(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32) if n in ("place", "ref_place", "length") else v) for n, v in cols.items()], list(cols))


def _earliest(batches, key: str, names: list[str]):
    """The rows of every key that more than one document has, each with the key's first, from batches sorted
    by key and place; equal rows count once.  Of a key that goes on over many batches only its first and
    last row are held, once it has a second document."""
    held, given = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
        if held is not None:
            cols = {n: np.concatenate([held[n], cols[n]]) for n in names}
        once = _changes(cols, names)[:-1]
        cols, new = {n: v[once] for n, v in cols.items()}, once >= given
        cut = _changes(cols, [key])
        first = np.repeat(cut[:-1], np.diff(cut))
        other = (cols["doc"] != cols["doc"][first]) | (cols["th"] != cols["th"][first])
        many = np.repeat(np.logical_or.reduceat(other, cut[:-1]), np.diff(cut))
        take = many & new
        yield {n: v[take] for n, v in (cols | {r: cols[n][first] for n, r in zip(AT, REF)}).items()}
        rest = np.unique([cut[-2], cut[-1] - 1]) if many[-1] else np.arange(cut[-2], cut[-1])
        held, given = {n: v[rest] for n, v in cols.items()}, len(rest) if many[-1] else 0


def _split_runs(cols: dict, min_words: int):
    """Runs of successive seeds of a document that are not first in one place together; the seeds of any
    other run have been joined with a document that has it whole."""
    place, seed = cols["place"].astype(np.int64), cols["seed"].view(np.uint64)
    gap = np.diff(place)
    near = (cols["doc"][1:] == cols["doc"][:-1]) & (cols["th"][1:] == cols["th"][:-1]) & (gap <= WINDOW)
    one = (cols["ref"][1:] == cols["ref"][:-1]) & (cols["ref_th"][1:] == cols["ref_th"][:-1]) & (np.diff(cols["ref_place"].astype(np.int64)) == gap)
    at, hash_, split, n = np.arange(len(place)), seed.copy(), np.zeros(len(place), bool), 0
    least, before = min_words - 2 * (WINDOW - 1), np.full(len(place), K)
    while True:
        go = at + n < len(near)
        go[go] = near[at[go] + n]
        at, hash_, split, before = at[go], hash_[go], split[go], before[go]
        if not len(at):
            return
        split = split | ~one[at + n]
        hash_ = tb.mix(hash_ * U64(0xD6E8FEB86659FD93) + seed[at + n + 1] + tb.mix(gap[at + n].astype(np.uint64)))
        n += 1
        length = place[at + n] - place[at]
        short = length + K < min_words
        take = split & (~short | ((length + K >= least) & (before < least)))
        yield {"run": hash_[take].view(np.int64), **{c: cols[c][at[take]] for c in AT}, "length": length[take]}
        at, hash_, split, before = at[short], hash_[short], split[short], length[short] + K


def _enough(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether a and b have that many words in common, however placed."""
    u, n = np.unique(a, return_counts=True)
    at = np.searchsorted(u, b)
    at = at[(at < len(u)) & (u[np.minimum(at, len(u) - 1)] == b)]
    return len(at) >= least and int(np.minimum(n, np.bincount(at, minlength=len(u))).sum()) >= least


def _needed(cols: dict) -> np.ndarray:
    """All passages but those found by a run's earliest document inside another passage of the document."""
    cut, take = _changes(cols, ["doc", "th"]), np.ones(len(cols["doc"]), bool)
    for a, b in zip(cut, cut[1:]):
        if b - a > 1 and cols["by_run"][a:b].any():
            first, last, late = cols["first_word"][a:b], cols["last_word"][a:b], cols["by_run"][a:b]
            order = np.lexsort((cols["ref_first_word"][a:b], cols["ref"][a:b], late, -last, first))
            end = np.maximum.accumulate(np.concatenate([[-1], last[order]]))[:-1]
            take[a + order] = (late[order] == 0) | (last[order] > end)
    return take


def _joined(boxes: list[tuple]) -> list[tuple]:
    """Chains (from, to in both, diagonal, by_run), where those that only runs gave are put together if they
    are close in both documents, as the copies of a repeated line are."""
    out = []
    for box in sorted(boxes, key=lambda v: (v[5], v[0], v[2], v[1], v[3])):
        a, b, p, q, _, by_run = box
        if by_run and out and out[-1][5]:
            k, m, r, t = out[-1][:4]
            if a <= m + EDGE and max(b, m) - k <= PART and p <= t + EDGE and r <= q + EDGE and max(q, t) - min(p, r) <= PART:
                out[-1] = (k, max(b, m), min(p, r), max(q, t), out[-1][4] and k - r == a - p, True)
                continue
        out.append(box)
    return out


def _parts(c: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """A chain, or parts of one that is off one diagonal and long in either document; in verification they
    overlap by EDGE words on both sides of a cut."""
    d = x[c] - y[c]
    if (d == d[0]).all():
        return [c]
    out, start = [], 0
    for i in range(1, len(c)):
        if max(x[c[i]] - x[c[start]], y[c[i]] - y[c[start]]) > PART:
            out.append(c[start:i])
            start = i
    return [*out, c[start:]]


def _chained(cols: dict, names: list[str], min_words: int) -> pa.RecordBatch:
    cut = _changes(cols, names)
    size = np.diff(cut)
    out: list[list] = [[] for _ in range(7)]
    at = []
    for g in np.flatnonzero(size > 1).tolist():
        own = slice(int(cut[g]), int(cut[g + 1]))
        x, y, by_run = np.unique(np.stack([cols[n][own] for n in ("place", "ref_place", "by_run")]).astype(np.int64), axis=1)
        once = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])
        x, y, by_run = x[once], y[once], by_run[once]
        if x.max() - x.min() + K + 2 * EDGE < min_words:
            continue
        boxes = []
        for c in (part for c in chains(x, y) if len(c) > 1 for part in _parts(c, x, y)):
            a, b, p, q = int(x[c[0]]), int(x[c[-1]]) + K, int(y[c[0]]), int(y[c[-1]]) + K
            if b - a + 2 * EDGE < min_words:
                continue
            d = x[c] - y[c]
            boxes.append((a, b, p, q, bool((d == d[0]).all()), int((by_run[c] == 0).sum()) < 2))
        for number, box in enumerate(_joined(boxes)):
            at.append(own.start)
            for column, value in zip(out, (number, *box)):
                column.append(value)
    take = np.array(at, np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(cols[n][take]) for n in names), *(pa.array(v, pa.int32()) for v in out[:5]), *(pa.array(v, pa.bool_()) for v in out[5:])], [*names, "number", "a", "b", "c", "d", "diagonal", "by_run"])


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    return passages(shared.documents(spark, sf_dir))
