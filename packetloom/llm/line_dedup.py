"""Fuzzy line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

A line goes when a line that comes earlier in the corpus (by doc_id, then place in the text) is equal or
within one edit (insertion, deletion or substitution of a code point).  The earliest of its kind stays.
Lines are judged on the input: an earlier line counts whether or not it goes itself.  Lines of fewer
than MIN_CHARS code points go only if they equal an earlier one: within one edit, such short lines are
mostly different words.  Where `min_chars` is given, it takes the place of MIN_CHARS, and shorter lines
stay and remove nothing.  Lines of white space alone always stay.

1. Equal lines become one class, with its earliest place.
2. Two lines within one edit, cut into blocks, agree in all but one of them.  Classes that share no half
   with another of nearly the same length can't have a partner and go no further.  The others are cut
   into FINE_BLOCKS blocks, or as many as keep a block within BLOCK_CHARS code points; a key is the hash of
   all blocks but one, so lines that share a key can differ in that one block only.
3. For each key that it shares, a line emits the deletion neighbourhood of the block left out: every
   variant with one code point deleted, and the block itself, hashed with the key.  Blocks of equal length
   are one substitution apart exactly if they share a variant with the deletion in the same place; blocks
   of lengths n and n + 1 are one deletion apart exactly if a variant of the longer is the shorter.  So
   all that share a variant are within one edit of each other (or of the line itself), and a minimum per
   variant finds the earliest partner; groups are never paired up.  A line's variants take memory in
   proportion to its shared blocks, however long it is.
4. The edit distance to that partner is verified.

Nulls: a null text stays null; a null doc_id comes before all others.  Rows with equal doc_id and text
are told apart by nothing, so both keep or lose the same lines, and equal rows count as one earliest
place.  Empty tables give empty tables.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import shared

#: Code points of a line that an earlier one within one edit removes.
MIN_CHARS = 20
#: Blocks of the second, finer look at which lines may have a partner.
FINE_BLOCKS = 24
#: Code points of a block, at most, in that look.
BLOCK_CHARS = 256
#: What a line is to a key: it was cut at a given place; it was cut anywhere; it is the shorter line itself.
SAME_PLACE, LONGER, ITSELF = 0, 1, 2


def _rows(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null first), th (hash of the text), text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, th, no (place from 0), line of every line that counts."""
    lines = _rows(docs).select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.where((F.length("line") >= min_chars) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _half_keys():
    """What a line of n code points shares with every other of n or n + 1 (n or n - 1) that is one edit
    away: for the smaller length m, the first or the last half."""
    n, line = F.length("line"), F.col("line")

    def half(m, j):
        before, behind = F.floor(m * j / 2).cast("int"), (m - F.floor(m * (j + 1) / 2)).cast("int")
        return F.xxhash64(F.lit(j), m, F.substring(line, F.lit(1), before), F.substring(line, n - behind + 1, behind))

    return F.array(*(half(m, j) for m in (n, n - 1) for j in range(2)))


#: Code points of the lines that are cut into FINE_BLOCKS blocks; longer ones have blocks of BLOCK_CHARS.
FINE_CHARS = FINE_BLOCKS * BLOCK_CHARS


def _chunks(text):
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))


def _edge(m, j):
    """Where block j of m code points begins."""
    return F.when(m <= FINE_CHARS, F.floor(m * j / FINE_BLOCKS).cast("int")).otherwise(F.least(j * BLOCK_CHARS, m))


def _fine_keys():
    """(key, shorter, block) for every block of both cuts of a line of n code points: its own length's and,
    with shorter = 1, that of one code point less.  The blocks before are taken from the line's start,
    those behind from its end."""
    n, line = F.col("n"), F.col("line")

    def whole(m):  # hashes of all before and all behind
        def key(j):
            return F.xxhash64(j, m, F.substring(line, F.lit(1), _edge(m, j)), F.substring(line, n - m + _edge(m, j + 1) + 1, m))

        return F.transform(F.sequence(F.lit(0), F.lit(FINE_BLOCKS - 1)), key)

    def by_block(m):  # the same for long lines: each block is hashed once from both ends
        hashed = lambda start: F.transform(_chunks(F.substring(line, start, m)), lambda c: F.xxhash64(c))
        both = F.array(F.struct(hashed(F.lit(1)).alias("x"), hashed(n - m + 1).alias("y")))  # made once for all keys
        return F.flatten(F.transform(both, lambda b: F.transform(b["x"], lambda _, j: F.xxhash64(j, m, F.slice(b["x"], F.lit(1), j), F.slice(b["y"], j + 2, m)))))

    def keys(m, shorter):
        got = F.when(m <= FINE_CHARS, whole(m)).otherwise(by_block(m))
        return F.transform(got, lambda k, j: F.struct(k.alias("key"), F.lit(shorter).alias("shorter"), j.alias("block")))

    return F.concat(keys(n, 0), keys(n - 1, 1))


def _sharing(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (key, h1, ...) whose key another h1 has too; dealt once by key."""
    keys = keyed.where("key is not null and h1 is not null").repartition("key")
    shown = keys.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("key")
    return keys.join(shown, "key", "left_semi")


def _variants():
    """(key, role) of the deletion neighbourhood of all blocks in `asked`."""
    n, line = F.col("n"), F.col("line")

    def of(a):
        m, shorter = n - a["shorter"], a["shorter"]
        start = _edge(m, a["block"])
        size = _edge(m, a["block"] + 1) - start + shorter
        tag = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))

        def made(b):
            text, key = b["text"], b["key"]
            places = F.filter(F.sequence(F.lit(1), F.greatest(b["size"], F.lit(1))), lambda i: i <= b["size"])
            cut = F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, b["size"])))
            same = F.transform(cut, lambda v, i: tag(F.xxhash64(F.lit(1), key, i, v), SAME_PLACE))
            longer = F.transform(F.array_distinct(cut), lambda v: tag(F.xxhash64(F.lit(2), key, v), LONGER))
            itself = F.array(tag(F.xxhash64(F.lit(2), key, text), ITSELF))
            return F.when(b["shorter"] == 1, longer).otherwise(F.concat(same, itself))

        block = F.struct(F.substring(line, start + 1, size).alias("text"), size.alias("size"), a["key"].alias("key"), shorter.alias("shorter"))
        return F.flatten(F.transform(F.array(block), made))  # the block is cut out once

    return F.flatten(F.transform("asked", of))


def _within_one(checked: DataFrame) -> DataFrame:
    """The rows whose `line` and `before` are one edit apart or less.  Of long lines, what is equal before
    and behind is taken off first, in whole chunks, as the distance of long texts is slow to compute."""

    def equal(x, y):  # how many leading chunks are
        same = F.zip_with(_chunks(x), _chunks(y), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int") * BLOCK_CHARS

    line, before = F.col("line"), F.col("before")
    long = F.least(F.length(line), F.length(before)) > 4 * BLOCK_CHARS
    rows = checked.withColumn("head", F.when(long, equal(line, before)).otherwise(0)).withColumn("tail", F.when(long, equal(F.reverse(line), F.reverse(before))).otherwise(0))
    rows = rows.withColumn("head", F.least(F.col("head"), F.length(line), F.length(before)))
    rows = rows.withColumn("tail", F.least(F.col("tail"), F.length(line) - F.col("head"), F.length(before) - F.col("head")))
    rest = lambda c: F.substring(c, F.col("head") + 1, F.length(c) - F.col("head") - F.col("tail"))
    return rows.where(F.levenshtein(rest(line), rest(before), 1) >= 0)


def verdicts(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """doc, th, drop: the places of the lines that go, for every document that loses some."""
    place = F.struct("doc", "no", "th")
    # lines without keys meet equal ones only
    keys = F.when(F.length("line") >= (MIN_CHARS if min_chars is None else min_chars), _half_keys())
    seen = _lines(docs, min_chars or 1).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "no", "th", keys.alias("keys"))
    seen = shared.stage(seen)
    classes = shared.stage(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("keys").alias("keys"), F.max(place).alias("last")))
    able = _sharing(classes.select(F.explode("keys").alias("key"), "h1")).select("h1").distinct()
    able = classes.join(able, "h1", "left_semi").select("first.doc", "first.no", "first.th", "first", "h1", "h2")
    # the lines themselves, from the documents they come first in
    asked = able.groupBy("doc", "th").agg(F.collect_list(F.struct("no", "h1", "h2", "first")).alias("asked"))
    lines = _rows(docs).join(asked, ["doc", "th"]).withColumn("parts", F.split("text", "\n", -1)).select("parts", F.explode("asked").alias("a"))
    lines = shared.stage(lines.select(F.expr("parts[a.no]").alias("line"), "a.h1", "a.h2", "a.first").dropDuplicates(["h1", "h2"]).withColumn("n", F.length("line")))
    fine = _sharing(lines.select("h1", F.explode(_fine_keys()).alias("k")).select("k.*", "h1"))
    fine = fine.groupBy("h1").agg(F.collect_list(F.struct("key", "shorter", "block")).alias("asked"))
    lines = shared.stage(lines.join(fine, "h1"))
    emitted = lines.select(F.explode(_variants()).alias("e"), "h1", "h2", "first").select("e.key", "e.role", "h1", "h2", "first")
    w = Window.partitionBy("key")
    met = emitted.withColumn("itself", F.min(F.when(F.col("role") == ITSELF, F.col("first"))).over(w)).withColumn("least", F.min(F.when(F.col("role") != ITSELF, F.col("first"))).over(w))
    partner = F.when(F.col("role") == LONGER, F.col("itself")).otherwise(F.col("least"))
    found = met.select("h1", "h2", "first", partner.alias("partner")).where("partner < first").distinct()
    at = lines.select(F.col("first").alias("partner"), F.col("line").alias("before"))
    checked = _within_one(found.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(at, "partner"))
    late = shared.stage(checked.select("h1", "h2").distinct().withColumn("late", F.lit(True)))
    # equal lines after the first, and all of a class that comes after its partner
    gone = classes.where("first < last").select("h1", "h2", "first").join(late, ["h1", "h2"], "full").select("h1", "h2", "first", "late")
    out = seen.select("h1", "h2", "doc", "no", "th").join(gone, ["h1", "h2"]).where(F.coalesce("late", F.lit(False)) | (F.struct("doc", "no", "th") > F.col("first")))
    return out.groupBy("doc", "th").agg(F.sort_array(F.collect_set("no")).alias("drop"))


def dedup(docs: DataFrame, min_chars: int | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns of docs, with the lines that go taken out of text; and the number of lines with
    a word before that, and of lines taken out, under `names` (none of them a column of docs), or else
    _n_lines and _n_removed with as many underscores behind as make them new."""
    text = F.col("text").cast("string")
    lines, removed = names or shared.fresh(docs, "n_lines", "n_removed")
    doc, th, drop = shared.fresh(docs, "doc", "th", "drop")
    own = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), th: F.xxhash64(text)})
    gone = verdicts(docs, min_chars).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("drop").alias(drop))
    parts = F.split(text, "\n", -1)
    worded = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))

    def left(b):  # the runs of lines between those that go
        def run(k):
            start = F.coalesce(F.get(b["drop"], k - 1) + 1, F.lit(0))
            return F.slice(b["parts"], start + 1, F.coalesce(F.get(b["drop"], k), F.size(b["parts"])) - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b["drop"])), run)), "\n")

    out = own.join(gone, [doc, th], "left").withColumns({
        lines: F.when(text.isNull(), 0).otherwise(worded).cast("long"),
        removed: F.coalesce(F.size(drop), F.lit(0)).cast("long"),
        "text": F.when(F.col(drop).isNull(), text).otherwise(F.get(F.transform(F.array(F.struct(parts.alias("parts"), F.col(drop).alias("drop"))), left), F.lit(0))),
    })
    return out.select(*shared.columns(docs), lines, removed)


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    return dedup(shared.documents(spark, sf_dir), names=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", "text")


#: Lines within one edit share their first or their last half; the edit is found behind their common beginning.
OP9_SQL = r"""
WITH l AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS doc, doc_id, no, parts[no + 1] AS line
  FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), w AS (
  SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), c AS (
  SELECT line, min((doc, no)) AS first, length(line) AS n FROM w GROUP BY line
), k AS (
  SELECT line, first, n, m, m // 2 AS h FROM (SELECT *, unnest([n, n - 1]) AS m FROM c WHERE n >= %d)
), keyed AS (
  SELECT line, first, n, m, 0 AS side, substr(line, 1, h) AS half FROM k
  UNION ALL SELECT line, first, n, m, 1, right(line, m - h) FROM k
), pair AS (
  SELECT DISTINCT a.line AS line, a.first, b.line AS other, b.first AS before
  FROM keyed a JOIN keyed b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND b.first < a.first AND (a.n = b.n AND a.n = a.m OR abs(a.n - b.n) = 1)
), far AS (
  SELECT *, list_position(list_transform(range(1, least(length(line), length(other)) + 1), lambda i: line[i] = other[i]), false) AS p FROM pair
), near AS (
  SELECT DISTINCT line FROM far WHERE p IS NULL OR p = 0 OR substr(line, p + CASE WHEN length(line) >= length(other) THEN 1 ELSE 0 END) = substr(other, p + CASE WHEN length(other) >= length(line) THEN 1 ELSE 0 END)
), v AS (
  SELECT l.doc_id, l.no, l.line, w.line IS NOT NULL AS worded, w.line IS NOT NULL AND ((l.doc, l.no) > c.first OR near.line IS NOT NULL) AS gone
  FROM l LEFT JOIN w ON w.doc = l.doc AND w.no = l.no LEFT JOIN c ON c.line = w.line LEFT JOIN near ON near.line = w.line
), t AS (
  SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text FROM v GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, t.text FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
""" % MIN_CHARS
